"""Time columns, with and without a zone, as numbers that don't depend on the session's zone where the column has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def seconds(ts: Column | str) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")
