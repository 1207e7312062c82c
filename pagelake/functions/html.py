"""HTML expressions that need no parse tree: anchors and visible text."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import urls

# Markup that holds no links and no visible text.
INVISIBLE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)

# An anchor up to its href value. Attributes before href are skipped possessively,
# so a quoted value that itself mentions href cannot be mistaken for the attribute.
ANCHOR_HREF = (
    r"""(?is)<a(?:\s+(?!href\s*=)[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*+"""
    r"""\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
)

# Fixed list: elements whose boundaries separate words; any other tag does not.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption",
    "center", "col", "colgroup", "dd", "details", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "input", "legend", "li",
    "link", "main", "menu", "meta", "nav", "noframes", "noscript", "ol", "option", "p",
    "pre", "section", "select", "table", "tbody", "td", "textarea", "tfoot", "th",
    "thead", "title", "tr", "ul",
]
BLOCK_BOUNDARY = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"
ANY_TAG = r"<[/!?a-zA-Z][^>]*>"
WHITE_SPACE = " \t\n\x0b\x0c\r\u00a0"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"

_ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)"


def _entity_map(table: dict[str, str]) -> Column:
    """A literal map; it is folded to a constant when the query is planned."""
    listed = "\n".join(f"{name}\t{character}" for name, character in table.items())
    return F.str_to_map(F.lit(listed), F.lit("\n"), F.lit("\t"))


def _named_entities() -> Column:
    """Entity names and characters, generated from the standard library's HTML 4 table."""
    table = {name: chr(point) for name, point in name2codepoint.items()}
    return _entity_map(table | {"apos": "'"})


def _unclosed_entities() -> Column:
    """The names that HTML also accepts without their semicolon."""
    return _entity_map({
        name: character for name, character in html5.items() if not name.endswith(";")
    })


def _code_point(number: Column) -> Column:
    padded = F.unhex(F.lpad(F.hex(number), 8, "0"))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(padded, "UTF-32"))


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Replace character references once, left to right; unknown ones stay as written.

    In attribute values a name without semicolon before ``=`` is a query parameter.
    """
    closed, unclosed = _named_entities(), _unclosed_entities()

    def piece_parts(piece: Column, at: Column) -> Column:
        # Every piece but the first follows an ampersand, and may open with a reference.
        return F.struct(
            piece.alias("text"),
            at.alias("at"),
            F.regexp_extract(piece, _ENTITY, 1).alias("name"),
            F.regexp_extract(piece, _ENTITY, 2).alias("end"),
        )

    def character(piece: Column) -> Column:
        name = piece["name"]
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        # Longer numbers are beyond the last code point in any case.
        number = F.when(F.length(digits) <= 8, F.when(
            name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("bigint")
        ).otherwise(digits.try_cast("bigint")))
        bare = F.try_element_at(unclosed, name)
        if in_attribute:
            parameter = F.substring(piece["text"], F.length(name) + 1, F.lit(1)) == "="
            bare = F.when(~parameter, bare)
        return (
            F.when(name.startswith("#"), _code_point(number))
            .when(piece["end"] == ";", F.try_element_at(closed, name))
            .otherwise(bare)
        )

    def decoded(piece: Column) -> Column:
        used = F.length(piece["name"]) + F.length(piece["end"])
        rest = F.substring(piece["text"], used + 1, F.length(piece["text"]))
        return (
            F.when(piece["at"] == 0, piece["text"])
            .when(piece["name"] == "", F.concat(F.lit("&"), piece["text"]))
            .otherwise(
                F.coalesce(
                    F.concat(character(piece), rest), F.concat(F.lit("&"), piece["text"])
                )
            )
        )

    return F.array_join(F.transform(F.transform(F.split(text, "&"), piece_parts), decoded), "")


def without_invisible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, "")


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(quoted, inner).otherwise(value)


def anchor_hrefs(html: Column) -> Column:
    """Raw href values of all anchors, in page order."""
    found = F.regexp_extract_all(without_invisible(html), F.lit(ANCHOR_HREF), 1)
    return F.transform(found, lambda value: decode_entities(_unquoted(value), True))


def absolute_links(parts: Column, hrefs: Column) -> Column:
    """Distinct absolute links; unresolvable ones are dropped."""
    return F.array_distinct(F.array_compact(urls.resolve_all(parts, hrefs)))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def plaintext(html: Column) -> Column:
    """Visible text on one line: no markup, attributes, scripts or styles."""
    visible = F.regexp_replace(without_invisible(html), BLOCK_BOUNDARY, " ")
    return collapse_whitespace(decode_entities(F.regexp_replace(visible, ANY_TAG, "")))


def title(html: Column) -> Column:
    """Trimmed text of the first title element; null where there is none.

    Titles inside comments, scripts and styles do not count.
    """
    found = F.regexp_extract_all(without_invisible(html), F.lit(TITLE), 1)
    return F.btrim(decode_entities(F.get(found, F.lit(0))), F.lit(WHITE_SPACE))
