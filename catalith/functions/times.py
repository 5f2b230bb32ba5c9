"""Times in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def day_number(at: Column) -> Column:
    """Days from 1970-01-01 to the UTC day of a TIMESTAMP."""
    return F.floor(F.unix_micros(at) / _DAY).cast("int")


def utc_day(at: Column) -> Column:
    return F.date_from_unix_date(day_number(at))


def utc_month(at: Column) -> Column:
    """The UTC month of a TIMESTAMP as yyyy-MM."""
    return F.substring(utc_day(at).cast("string"), 1, 7)
