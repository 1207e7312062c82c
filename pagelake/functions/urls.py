"""URL expressions. Everything here is a Column built from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: scheme with its slashes, authority with its port, path with its query.
SEGMENTS = r"^([^/]+//)([^/]+)(/.*)"

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HIERARCHICAL = r"^(?i:https?|ftp)://[^/?#]+"
# Characters a URI may not hold unescaped; a link with one is unresolvable.
ILLEGAL = r"""[\s<>"{}|\\^`]"""


def segment(uri: Column, index: int) -> Column:
    """One of the three parts of ``SEGMENTS``; null where the URI has no path."""
    return F.nullif(F.regexp_extract(uri, SEGMENTS, index), F.lit(""))


def host(uri: Column) -> Column:
    return segment(uri, 2)


def path(uri: Column) -> Column:
    return segment(uri, 3)


def uri_segments(uri: Column) -> Column:
    return F.struct(
        segment(uri, 1).alias("scheme"),
        host(uri).alias("host"),
        path(uri).alias("path"),
    )


def same_host(first: Column, *others: Column) -> Column:
    """True when all URIs have equal hosts; two URIs without a path count as equal."""
    expected = host(first)
    verdict = F.lit(True)
    for other in others:
        verdict = verdict & expected.eqNullSafe(host(other))
    return verdict


def _drop_dot_segments(raw: Column) -> Column:
    """RFC 3986 section 5.2.4 as a fold over the parts of a rooted path."""
    parts = F.split(raw, "/")
    folded = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.lit(""),
        lambda kept, part: F.when(part == "..", F.regexp_replace(kept, "/[^/]*$", ""))
        .when(part == ".", kept)
        .otherwise(F.concat(kept, F.lit("/"), part)),
    )
    closes_folder = raw.rlike(r"/\.\.?$")
    return F.concat(folded, F.when(closes_folder, F.lit("/")).otherwise(F.lit("")))


def base_parts(base: Column) -> Column:
    """The parts of a base URI that resolution needs, worth computing once per page."""
    clean = without_fragment(base)
    origin = F.regexp_extract(clean, HIERARCHICAL, 0)
    rest = F.substring(clean, F.length(origin) + 1, F.length(clean))
    raw_path = F.regexp_extract(rest, r"^[^?]*", 0)
    return F.struct(
        F.nullif(origin, F.lit("")).alias("origin"),
        F.regexp_extract(clean, SCHEME, 0).alias("scheme"),
        raw_path.alias("path"),
        rest.alias("rest"),
        F.when(raw_path == "", F.lit("/"))
        .otherwise(F.regexp_extract(raw_path, r"^.*/", 0))
        .alias("folder"),
    )


def resolve_all(parts: Column, links: Column) -> Column:
    """Absolute forms of an array of links, without fragments.

    A link that cannot be resolved becomes null. The work is staged over the array, so
    that every intermediate value is computed once per link.
    """
    targets = F.transform(
        links, lambda link: F.regexp_replace(F.trim(link), r"(?s)#.*$", "")
    )
    split = F.transform(targets, lambda target: _origin_and_rest(parts, target))
    return F.transform(split, _joined)


def _origin_and_rest(parts: Column, target: Column) -> Column:
    """Where a link points: (origin, path with query), before dots are resolved."""
    full = F.when(target.startswith("//"), F.concat(parts["scheme"], target)).otherwise(target)
    own_origin = F.regexp_extract(full, HIERARCHICAL, 0)

    def at(origin: Column, rest: Column) -> Column:
        return F.struct(origin.alias("origin"), rest.alias("rest"))

    return (
        F.when(parts["origin"].isNull() | target.rlike(ILLEGAL), F.lit(None))
        .when(
            target.startswith("//") | target.rlike(SCHEME),
            at(F.nullif(own_origin, F.lit("")), F.regexp_replace(full, HIERARCHICAL, "")),
        )
        .when(target.startswith("/"), at(parts["origin"], target))
        .when(target == "", at(parts["origin"], parts["rest"]))
        .when(target.startswith("?"), at(parts["origin"], F.concat(parts["path"], target)))
        .otherwise(at(parts["origin"], F.concat(parts["folder"], target)))
    )


def _joined(place: Column) -> Column:
    dotted = F.concat(
        place["origin"],
        _drop_dot_segments(F.regexp_extract(place["rest"], r"^[^?]*", 0)),
        F.regexp_extract(place["rest"], r"\?.*$", 0),
    )
    plain = F.concat(place["origin"], place["rest"])
    return F.when(F.instr(place["rest"], "/.") > 0, dotted).otherwise(plain)


def resolve_against(parts: Column, link: Column) -> Column:
    """Absolute form of ``link`` without fragment; null where it cannot be resolved."""
    return F.get(resolve_all(parts, F.array(link)), F.lit(0))


def resolve_link(base: Column, link: Column) -> Column:
    return resolve_against(base_parts(base), link)


def without_fragment(uri: Column) -> Column:
    return F.regexp_replace(uri, r"#.*$", "")


def full_match(value: Column, pattern: str) -> Column:
    """Whole-string match; ``rlike`` alone would accept a partial one."""
    return F.coalesce(value.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def is_html(headers: Column) -> Column:
    """Whether the ``content-type`` header announces HTML."""
    content_type = F.try_element_at(headers, F.lit("content-type"))
    return F.coalesce(content_type.rlike("^text/html"), F.lit(False))
