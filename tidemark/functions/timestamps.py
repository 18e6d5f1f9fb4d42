"""Reading RFC3339 instants and plain dates; anything else is unreadable and becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2}))?$"


def parse_instant(col: Column | str) -> Column:
    """Microsecond timestamp of an RFC3339 instant or of 00:00:00 UTC of a ``yyyy-MM-dd`` date. Dates that don't exist,
    blanks, nulls and other forms give null. Independent of the session's time zone."""
    c = F.col(col) if isinstance(col, str) else col
    full = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.upper(c))
    return F.when(c.rlike(INSTANT), full.try_cast("timestamp"))


def utc_text(col: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` in UTC."""
    return F.date_format(to_utc_wall(col), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_month(col: Column | str) -> Column:
    return F.date_format(to_utc_wall(col), "yyyy-MM")


def to_utc_wall(col: Column | str) -> Column:
    """The wall clock in UTC of a timestamp, as a timestamp without zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
