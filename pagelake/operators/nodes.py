"""Pages to element tables: a tolerant HTML parse per Arrow batch of pages."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagelake.schemas import NODES

# The parser travels with its tasks, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed lists from the HTML standard: elements without content, and for each element
# the open elements its start tag implicitly closes.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


class _TreeBuilder(HTMLParser):
    """Collects elements with their pre/post order numbers and direct text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self._open: list[dict] = []
        self._sibling_counts: list[dict[str, int]] = [{}]
        self._closed = 0

    def _close_down_to(self, depth: int) -> None:
        while len(self._open) > depth:
            node = self._open.pop()
            self._sibling_counts.pop()
            node["post"] = self._closed
            node["own_text"] = "".join(node["own_text"])
            self._closed += 1

    def _close_implied(self, targets: set[str], scope: set[str]) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth]["tag"]
            if tag in scope:
                return
            if tag in targets:
                self._close_down_to(depth)
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH:
            self._close_implied({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED_END:
            targets, scope = IMPLIED_END[tag]
            if tag == "tr":
                self._close_implied({"td", "th"}, {"tr", "table"})
                targets = {"tr"}
            self._close_implied(targets, scope)
        counts = self._sibling_counts[-1]
        counts[tag] = counts.get(tag, 0) + 1
        node = {
            "pre": len(self.nodes),
            "post": 0,
            "depth": len(self._open),
            "tag": tag,
            "attrs": list({name: value or "" for name, value in reversed(attrs)}.items()),
            "own_text": [],
            "nth_of_type": counts[tag],
        }
        self.nodes.append(node)
        self._open.append(node)
        self._sibling_counts.append({})
        if tag in VOID_TAGS:
            self._close_down_to(len(self._open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_down_to(len(self._open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth]["tag"] == tag:
                self._close_down_to(depth)
                return

    def handle_data(self, data):
        if self._open:
            self._open[-1]["own_text"].append(data)

    def finish(self) -> list[dict]:
        self.close()
        self._close_down_to(0)
        return self.nodes


def _parse(html: str | None) -> list[dict]:
    if not html:
        return []
    builder = _TreeBuilder()
    builder.feed(html)
    return builder.finish()


def with_nodes(pages: DataFrame, html: str = "html", name: str = "nodes") -> DataFrame:
    """Replace the ``html`` column by the array of its elements, in document order.

    The other columns pass through as Arrow, so select only what is needed first.
    """
    kept = [field for field in pages.schema.fields if field.name != html]
    schema = T.StructType(kept + [T.StructField(name, NODES)])
    arrow_type = to_arrow_type(NODES)

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few pages at a time keep the Python objects of a batch small.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = part.column(part.schema.get_field_index(html)).to_pylist()
                nodes = pa.array([_parse(text) for text in texts], type=arrow_type)
                columns = [
                    part.column(part.schema.get_field_index(field.name)) for field in kept
                ]
                names = [field.name for field in kept] + [name]
                yield pa.RecordBatch.from_arrays(columns + [nodes], names=names)

    return pages.mapInArrow(parse_batches, schema)


def node_rows(parsed: DataFrame, *keys: str, name: str = "nodes") -> DataFrame:
    """One row per element: the exploded form of :func:`with_nodes`."""
    return parsed.select(*keys, F.inline(name))
