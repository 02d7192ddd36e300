"""Dates as fractional days counted from year one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of dates that are read.
UNIX_DAY = 719163  # the ordinal of 1970-01-01
PATTERN = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
CLOCK = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\([^)]+\))?\s+(\d{1,2}):(\d{2})"


def ordinal_days(ts: Column) -> Column:
    """Days with the time of day as a fraction; seconds do not count."""
    return (F.unix_date(F.to_date(ts)) + F.lit(UNIX_DAY)).cast("double") + F.hour(ts) / 24.0 + F.minute(ts) / 1440.0


def parse_days(text: Column) -> Column:
    """The first year-month-day in a text, with the clock time if the text begins with the date; else null.

    A month or day that does not exist gives null.
    """
    part = lambda i: F.regexp_extract(text, PATTERN, i)
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    hour, minute = (F.regexp_extract(text, CLOCK, i) for i in (1, 2))
    clock = F.when(hour != "", hour.cast("int") / 24.0 + minute.cast("int") / 1440.0).otherwise(F.lit(0.0))
    return F.when(part(1) != "", (F.unix_date(day) + F.lit(UNIX_DAY)).cast("double") + clock)
