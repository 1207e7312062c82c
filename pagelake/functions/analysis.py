"""Text to index terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list: the 33 English words left out of the index.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
]

# Words by Unicode text segmentation: runs of letters, digits, marks and underscores,
# continued across an inner apostrophe, dot, colon or middle dot between letters and
# across an inner apostrophe, dot, comma or semicolon between digits. The loops are
# possessive, which keeps the matcher iterative however long a token is.
WORD = (
    r"[\p{L}\p{N}\p{M}_]++"
    r"(?:['’.:·,;](?:(?<=\p{L}['’.:·])(?=\p{L})|(?<=\p{N}['’.,;])(?=\p{N}))"
    r"[\p{L}\p{N}\p{M}_]++)*+"
)

# Scripts written without spaces: every Hiragana or Han character is its own word.
UNSPACED = r"[぀-ゟ㐀-䶿一-鿿豈-﫿]"

def tokens(text: Column) -> Column:
    """Lower-cased words in order, stop words included."""
    spaced = F.when(
        text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")
    ).otherwise(text)
    return F.regexp_extract_all(F.lower(spaced), F.lit(WORD), 0)


def _indexable(token: Column, max_length: int | None) -> Column:
    kept = ~token.isin(STOP_WORDS)
    return kept if max_length is None else kept & (F.length(token) <= max_length)


def terms(text: Column, max_length: int | None = None) -> Column:
    """Index terms in order; ``max_length`` leaves out longer tokens, by default none."""
    return F.filter(tokens(text), lambda token: _indexable(token, max_length))


def positioned_terms(text: Column, max_length: int | None = None) -> Column:
    """Index terms with their word position; skipped words leave a gap."""
    numbered = F.transform(
        tokens(text), lambda token, at: F.struct(token.alias("term"), at.alias("position"))
    )
    return F.filter(numbered, lambda entry: _indexable(entry["term"], max_length))
