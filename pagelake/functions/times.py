"""RFC 3339 timestamps. The session time zone is expected to be UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats: what the text form looks like, and which texts count as timestamps.
TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

RECRAWL_WINDOW_MINUTES = 60


def instant(value: Column | str | datetime) -> Column:
    """A Column for an instant given as one, as RFC 3339 text, or as a datetime."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def to_text(instant: Column) -> Column:
    """Millisecond text form, e.g. ``2012-05-13T21:52:58.114Z`` in a UTC session."""
    return F.date_format(instant, TEXT_FORMAT)


def parse(text: Column) -> Column:
    """Instant for an RFC 3339 text; null for null, empty or malformed text."""
    as_text = text.cast("string")
    return F.when(as_text.rlike(RFC3339), as_text.try_cast("timestamp"))


def to_millis(text: Column) -> Column:
    return F.unix_millis(parse(text))


def in_zone(text: Column, zone: str) -> Column:
    """Wall-clock time of the instant in ``zone``."""
    return F.from_utc_timestamp(parse(text), zone)


def recently_crawled(
    crawled_at: Column, now: Column, minutes: int = RECRAWL_WINDOW_MINUTES
) -> Column:
    """Strictly less than ``minutes`` ago; never crawled is false."""
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    return F.coalesce(crawled_at > cutoff, F.lit(False))
