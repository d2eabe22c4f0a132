"""Text to numbers and times, without failing on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_long(text: Column, default: int = 1) -> Column:
    """A whole number, or the default where the text is none."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(default))


def service_time(text: Column) -> Column:
    """A monitoring service's time, `2020-01-31T23:59:59.123GMT`; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "GMT$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)
