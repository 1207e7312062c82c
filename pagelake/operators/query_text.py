"""Query texts as people type them, translated to query objects.

Words and "quoted phrases" may be marked by ``+`` (must), ``-`` or ``NOT`` (must not), joined
by ``AND`` and ``OR``, led by ``field:``, followed by ``^boost``, and grouped in round
brackets. ``"a b"~3`` is a phrase whose words may be moved by three places in all, ``ab*`` and
``a?b`` are patterns, ``word~`` or ``word~1`` a fuzzy word (``word~0.8``: edits in at most a
fifth of its letters), ``[low TO high]`` a range of terms with its bounds, ``{low TO high}``
one without them, and ``*`` an open bound. A backslash takes the next character as it is.
What is none of these is malformed.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelake.functions import analysis
from pagelake.operators.search import (
    FUZZY_EDITS, MUST, MUST_NOT, SHOULD, Boolean, Fuzzy, Phrase, Prefix, Query, Term, TermRange,
    Wildcard,
)

_BOUND = r"(?:\\.|[^\s\]}\\])+"
_PART = re.compile(
    r"""\s*(?:(?P<mark>[-+!](?=\S)|AND\b|OR\b|NOT\b|&&|\|\|)|(?P<field>[\w.]+):(?=\S)"""
    r"""|"(?P<phrase>(?:\\.|[^"\\])*)"(?:~(?P<slop>\d+)(?![\w.~]))?"""
    rf"""|(?P<left>[\[{{])\s*(?P<low>{_BOUND})\s+TO\s+(?P<high>{_BOUND})\s*(?P<right>[\]}}])"""
    r"""|(?P<open>\()|(?P<close>\))|(?P<boost>\^\d+(?:\.\d+)?)"""
    r"""|(?P<word>(?![-+!](?:\s|$))(?:\\.|[^\s"()\[\]{}^:\\])+))""",
    re.DOTALL,
)
_FUZZY = re.compile(r"((?:\\.|[^~\\])+)~(\d*(?:\.\d+)?)", re.DOTALL)
_OCCURS = {"+": MUST, "-": MUST_NOT, "!": MUST_NOT, "NOT": MUST_NOT}


class _Malformed(Exception):
    pass


def _unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _bare(text: str) -> str:
    """The text without what is escaped in it."""
    return re.sub(r"\\.", "", text, flags=re.DOTALL)


def _parts(text: str) -> list[tuple[str, object]]:
    """The text as (kind, value) parts; anything else makes it malformed."""
    found, at = [], 0
    # A blank at the end may be escaped.
    while at < len(text) and text[at:].strip():
        match = _PART.match(text, at)
        if not match:
            raise _Malformed
        if match["left"]:
            found.append(("range", (match["left"], match["low"], match["high"], match["right"])))
        elif match["phrase"] is not None:
            found.append(("phrase", (_unescaped(match["phrase"]), int(match["slop"] or 0))))
        else:
            found.append((match.lastgroup, match[match.lastgroup]))
        at = match.end()
    return found


def _plain_text(kind: str, value) -> str:
    """The text of a word or phrase that is analysed."""
    return value[0] if kind == "phrase" else _unescaped(value)


def _analysed(spark: SparkSession, texts: list[str]) -> dict[str, list[tuple[str, int]]]:
    """(term, position) of each text, analysed like documents; one row per part of a query."""
    if not texts:
        return {}
    rows = spark.createDataFrame([(text,) for text in sorted(set(texts))], "text string").select(
        "text", analysis.positioned_terms(F.col("text")).alias("terms")
    ).collect()
    return {row["text"]: [(e["term"], e["position"]) for e in row["terms"]] for row in rows}


def _edits(similarity: str, word: str) -> int:
    """Edits of a fuzzy word: a number of them, or what a similarity below one leaves."""
    if not similarity:
        return FUZZY_EDITS
    value = float(similarity)
    if value >= 1 and value == int(value):
        return min(int(value), FUZZY_EDITS)
    if value > 1:
        raise _Malformed
    return 0 if similarity == "0" else min(int((1 - value) * len(word)), FUZZY_EDITS)


def _range(value: tuple[str, str, str, str], field: str) -> TermRange:
    left, low, high, right = value
    bounds = [None if text == "*" else _unescaped(text).lower() for text in (low, high)]
    return TermRange(field, *bounds, with_low=left == "[", with_high=right == "]")


def _leaf(kind: str, value, field: str, terms: dict) -> Query | None:
    if kind == "range":
        return _range(value, field)
    slop = value[1] if kind == "phrase" else 0
    if kind == "word" and re.search(r"[*?]", _bare(value)):
        if value[0] in "*?" or "~" in _bare(value):
            raise _Malformed
        if value.endswith("*") and not re.search(r"[*?]", _bare(value)[:-1]):
            return Prefix(field, _unescaped(value[:-1]).lower())
        return Wildcard(field, value.lower())
    if kind == "word" and "~" in _bare(value):
        fuzzy = _FUZZY.fullmatch(value)
        if not fuzzy:
            raise _Malformed
        word = _unescaped(fuzzy[1]).lower()
        return Fuzzy(field, word, _edits(fuzzy[2], word))
    found = terms.get(_plain_text(kind, value), [])
    if len(found) > 1:
        first = found[0][1]
        words = tuple(term for term, _ in found)
        if slop and len(set(words)) < len(words):
            # Two places of one word that may both move are not told apart.
            raise _Malformed
        return Phrase(field, words, tuple(at - first for _, at in found), slop=slop)
    return Term(field, found[0][0]) if found else None


def _group(parts: list, field: str, terms: dict, closing: bool) -> Query | None:
    """Clauses up to the end or the closing bracket; the parts are used up."""
    clauses: list[tuple[Query | None, str]] = []
    while parts and parts[0][0] != "close":
        occur, joined = SHOULD, None
        while parts and parts[0][0] == "mark":
            mark = parts.pop(0)[1]
            if mark in _OCCURS:
                occur = _OCCURS[mark]
            else:
                if joined or not clauses:
                    raise _Malformed
                joined = "AND" if mark in ("AND", "&&") else "OR"
        own = parts.pop(0)[1] if parts and parts[0][0] == "field" else field
        if not parts or parts[0][0] not in ("word", "phrase", "range", "open"):
            raise _Malformed
        kind, value = parts.pop(0)
        query = _group(parts, own, terms, True) if kind == "open" else _leaf(kind, value, own, terms)
        if parts and parts[0][0] == "boost":
            boost = float(parts.pop(0)[1][1:])
            query = query and replace(query, boost=boost)
        if joined == "AND":
            if occur == SHOULD:
                occur = MUST
            if clauses[-1][1] == SHOULD:
                clauses[-1] = (clauses[-1][0], MUST)
        clauses.append((query, occur))
    if closing:
        if not parts:
            raise _Malformed
        parts.pop(0)
    elif parts:
        raise _Malformed
    known = tuple((query, occur) for query, occur in clauses if query is not None)
    if len(known) == 1 and known[0][1] != MUST_NOT:
        return known[0][0]
    return Boolean(known) if known else None


def query_from_text(
    spark: SparkSession, field: str, text: str
) -> tuple[bool, Query | None]:
    """Whether the text is well formed, and its query (None if it has nothing to look for).

    Words are analysed like documents: stop words vanish, and a word that the analysis
    splits becomes a phrase. Patterns, ranges and fuzzy words are only put in lower case.
    """
    try:
        parts = _parts(text)
        words = [_plain_text(kind, value) for kind, value in parts if kind in ("word", "phrase")]
        return True, _group(parts, field, _analysed(spark, words), False)
    except _Malformed:
        return False, None
