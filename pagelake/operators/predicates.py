"""Row predicates in the vocabulary of searches: terms, ranges, dates, combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import times

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"


def exact_term(column: Column, value: str) -> Column:
    return column == value


def numeric_range(column: Column, low, high) -> Column | None:
    """Both bounds included; None for a missing bound, mixed types or high below low."""
    if low is None or high is None or type(low) is not type(high) or high < low:
        return None
    return column.between(low, high)


def date_range(column: Column, start: str | None, end: str | None) -> Column | None:
    """Instants between two RFC 3339 texts, both included.

    The bounds are folded to constants, so the comparison reaches the Parquet scan.
    """
    if not start or not end:
        return None
    low, high = times.parse(F.lit(start)), times.parse(F.lit(end))
    return column.between(low, high)


def combine(*pairs) -> Column | None:
    """Alternating predicates and occurs to one predicate; None when unpaired or empty.

    All musts hold, no must-not does, and without a must at least one should does.
    """
    if not pairs or len(pairs) % 2:
        return None
    groups: dict[str, list[Column]] = {MUST: [], SHOULD: [], MUST_NOT: []}
    for predicate, occur in zip(pairs[0::2], pairs[1::2]):
        if occur not in groups:
            raise ValueError(f"unknown occur: {occur!r}")
        groups[occur].append(F.coalesce(predicate, F.lit(False)))
    required = groups[MUST] or (
        [reduce(Column.__or__, groups[SHOULD])] if groups[SHOULD] else [F.lit(False)]
    )
    return reduce(Column.__and__, required + [~column for column in groups[MUST_NOT]])


def link_allowed(uri: Column, check: Column | None) -> Column:
    """An optional check on a URI; absent allows everything, null counts as false."""
    return F.lit(True) if check is None else F.coalesce(check, F.lit(False))
