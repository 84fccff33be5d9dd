"""Comparison keys and clock values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(c: Column | str) -> Column:
    """Lower case, every run of other than letters and digits made one '_', none at the ends; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def micros_of_text(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of an ISO text; without offset it means UTC whatever the session's zone; unreadable: null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d:\d"), c).otherwise(F.concat(c, F.lit("Z")))
    zoned = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.unix_micros(zoned.try_cast("timestamp"))


def micros_of_ntz(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (meaning UTC), independent of the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
