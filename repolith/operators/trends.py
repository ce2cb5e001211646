"""Trend snapshots: rows that say nothing new overwrite the one before."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.lineage import with_next

#: A row can only overwrite one of less than so many seconds before; other numbers may move by this share.
SECONDS, SHARE = 300, 0.01
#: A snapshot's numbers: (name, whole number, may be null). Whole ones may not move at all.
SNAPSHOT = (("total_files", True, False), ("total_edges", True, False), ("dead_files", True, False), ("avg_bus_factor", False, True), ("high_risk_files", True, True), ("churn_recent", False, True))


def nothing_new(last: Column, row: Column, numbers=SNAPSHOT, ts: str = "ts", seconds: int = SECONDS) -> Column:
    """Whether a row overwrites the last one: soon behind it, null where it is null, whole numbers equal, others within a hundredth of the last one's."""

    def same(name: str, whole: bool) -> Column:
        a, b = last[name].cast("double"), row[name].cast("double")
        near = F.when(a == 0, b == 0).otherwise(F.abs((b - a) / a) <= SHARE)
        return (a.isNull() & b.isNull()) | F.coalesce(near & (F.abs(b - a) < 1 if whole else F.lit(True)), F.lit(False))

    return reduce(and_, [row[ts] - last[ts] < seconds, *(same(n, whole) for n, whole, _ in numbers)])


def says_nothing_new(last: dict, row: dict, numbers=SNAPSHOT, ts: str = "ts", seconds: int = SECONDS) -> bool:
    """The same of plain values, for a stream's state."""
    if row[ts] - last[ts] >= seconds:
        return False
    for name, whole, _ in numbers:
        a, b = last[name], row[name]
        if (a is None) != (b is None):
            return False
        if a is not None and ((whole and abs(b - a) >= 1) or (b != 0 if a == 0 else abs((b - a) / a) > SHARE)):
            return False
    return True


def collapse(rows: DataFrame, key: str, numbers=SNAPSHOT, ts: str = "ts", seconds: int = SECONDS) -> DataFrame:
    """The rows that stand once each that says nothing new overwrote the last one. What overwrites and what is added behind is the
    last row alike, so that a row stands unless the next one overwrites it."""
    columns = [ts, *(n for n, *_ in numbers)]
    x = with_next(rows, [key], [F.col(ts), *(F.col(n) for n, *_ in numbers)], columns, "__next")
    over = nothing_new(F.struct(*columns), F.col("__next"), numbers, ts, seconds)
    return x.where(F.col("__next").isNull() | ~over).drop("__next")
