"""Element selection on node arrays.

A selector is a chain of element tests separated by spaces, each a descendant of the
one before: ``ul#menu a``, ``#content div span:nth-of-type(2)``, ``li.block``.
Descendants are found by their places in document order, inside the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEST = re.compile(
    r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<marks>(?:[#.][\w-]+)*)(?::nth-of-type\((?P<nth>\d+)\))?"
)


@dataclass(frozen=True)
class ElementTest:
    tag: str | None = None
    ids: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    nth_of_type: int | None = None

    def holds(self, node: Column) -> Column:
        checks = []
        if self.tag:
            checks.append(node["tag"] == self.tag)
        for name in self.ids:
            checks.append(F.try_element_at(node["attrs"], F.lit("id")) == name)
        for name in self.classes:
            listed = F.split(F.try_element_at(node["attrs"], F.lit("class")), r"\s+")
            checks.append(F.array_contains(listed, name))
        if self.nth_of_type is not None:
            checks.append(node["nth_of_type"] == self.nth_of_type)
        verdict = F.lit(True)
        for check in checks:
            verdict = verdict & F.coalesce(check, F.lit(False))
        return verdict


def chain(selector: str) -> list[ElementTest]:
    tests = []
    for part in selector.split():
        found = _TEST.fullmatch(part)
        if not found:
            raise ValueError(f"unsupported selector: {selector!r}")
        marks = re.findall(r"([#.])([\w-]+)", found["marks"])
        tests.append(
            ElementTest(
                tag=None if found["tag"] in (None, "*") else found["tag"].lower(),
                ids=tuple(name for mark, name in marks if mark == "#"),
                classes=tuple(name for mark, name in marks if mark == "."),
                nth_of_type=int(found["nth"]) if found["nth"] else None,
            )
        )
    if not tests:
        raise ValueError("empty selector")
    return tests


def select_nodes(nodes: Column, selector: str) -> Column:
    """The nodes of the array that match, in document order."""
    first, *rest = chain(selector)
    matched = F.filter(nodes, first.holds)
    for test in rest:
        matched = _descendants(nodes, matched, test)
    return matched


def _descendants(nodes: Column, ancestors: Column, test: ElementTest) -> Column:
    """Matching nodes below any of ``ancestors``, in document order.

    ``pre`` is a node's place in the array and its descendants follow it there, so each
    ancestor stands for a run of places. Runs lie one in another or apart, and an ancestor
    inside another one's run adds nothing. Where ancestors are nested so deep that their runs
    are several times the page, only the outermost are followed.
    """
    def end(node: Column) -> Column:
        return node["post"] + node["depth"]

    total = F.aggregate(
        ancestors, F.lit(0).cast("bigint"), lambda sum_, node: sum_ + (end(node) - node["pre"])
    )

    # Ancestors come in document order; one is outermost if it lies behind all ends so far.
    reached = F.aggregate(
        ancestors, F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("kept")),
        lambda seen, node: F.when(node["pre"] <= seen["end"], seen).otherwise(F.struct(
            end(node).alias("end"), F.concat(seen["kept"], F.array(node["pre"])).alias("kept"),
        )),
    )
    outermost = F.transform(reached["kept"], lambda at: F.get(nodes, at))

    def below(node: Column) -> Column:
        size = node["post"] - node["pre"] + node["depth"]
        return F.when(
            size > 0, F.sequence(node["pre"] + 1, node["pre"] + size)
        ).otherwise(F.array().cast("array<int>"))

    followed = F.when(total <= 4 * F.size(nodes), ancestors).otherwise(outermost)
    places = F.array_distinct(F.flatten(F.transform(followed, below)))
    return F.filter(F.transform(places, lambda at: F.get(nodes, at)), test.holds)


def trimmed_content(nodes: Column, selector: str) -> Column:
    """Trimmed direct text of every match; an empty array where nothing matches."""
    return F.transform(
        select_nodes(nodes, selector),
        lambda node: F.regexp_replace(node["own_text"], r"^\s+|\s+$", ""),
    )


def first_or_null(values: Column) -> Column:
    return F.get(values, F.lit(0))


def hrefs(nodes: Column, selector: str) -> Column:
    """href values of the matching elements that have one."""
    values = F.transform(
        select_nodes(nodes, selector),
        lambda node: F.try_element_at(node["attrs"], F.lit("href")),
    )
    return F.filter(values, lambda value: value.isNotNull())
