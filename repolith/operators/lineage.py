"""Cutting lineage by tables in the shared folder, and small helpers that all operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Without that setting, a session on one machine
    gets a folder of its own; on a cluster it is an error, as executors don't see each other's folders."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="repolith-")
    return _own_dir


def cut(df: DataFrame, name: str, after: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: an iteration's plan starts anew, and a lost executor costs nothing. after:
    the iteration's table before, which cut() wrote and nothing reads any more once this one is there; it is deleted."""
    at = f"{shared_dir(df.sparkSession)}/repolith-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._repolith_path = at  # type: ignore[attr-defined]
    if after is not None:
        drop_cut(after)
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote."""
    at = getattr(df, "_repolith_path", None)
    if at:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows over tasks by a hash of keys, some tasks a core. For small tables of which much is made: they lie in few row groups, and
    AQE would join small shuffle partitions again, so that one task would do all that comes after."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def round6(x: Column) -> Column:
    """Half-up rounding to six places, in the way of the SQL twins."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def count() -> Column:
    return F.count(F.lit(1))


def numbered(df: DataFrame, order: list[Column], name: str = "rk") -> DataFrame:
    """Adds the row number in a total order without sorting in one task: rows are dealt by ranges of the order, numbered within
    a range, and shifted by the number of rows before it."""
    part = "__range"
    dealt = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = dealt.groupBy(part).agg(count().alias("__n"))
    before = before.select(part, (F.sum("__n").over(Window.orderBy(part)) - F.col("__n")).alias("__before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(before), part).withColumn(name, within + F.col("__before")).drop(part, "__before")


def with_next(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], name: str) -> DataFrame:
    """Adds the next row of the same keys in an order, as a struct of columns; null at the end. Rows are dealt by ranges of keys and
    order, and a range's last row of a key takes the first one of the next range that has the key: a key's rows needn't meet in one
    task. What is looked up by key are rows a key and range."""
    part, at = "__range", Window.partitionBy("__range", *keys)
    by = [F.col(k) for k in keys]
    dealt = cut(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    row = F.struct(*columns)
    inside = dealt.withColumn("__place", F.row_number().over(at.orderBy(*order))).withColumn(name, F.lead(row).over(at.orderBy(*order)))
    first = inside.where("__place = 1").select(part, *keys, row.alias("__first"))
    carried = first.select(part, *keys, F.lead("__first").over(Window.partitionBy(*keys).orderBy(part)).alias("__carried")).where("__carried IS NOT NULL")
    named = [part, *keys]
    carried = carried.toDF(*(f"__{k}_of" for k in range(len(named))), "__carried")
    on = [F.col(c).eqNullSafe(F.col(f"__{k}_of")) for k, c in enumerate(named)]
    return inside.join(carried, on, "left").select(*df.columns, F.coalesce(name, "__carried").alias(name))


#: Tasks' worth of blocks on either side of joined_in_blocks().
_SIDES = 16


def joined_in_blocks(left: DataFrame, right: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """left and right by a key that may have many rows on both sides. Keys of up to size * size pairs are joined as they are. The rows of
    the others are dealt into blocks of some size, a row with an array each, and every two blocks of a key meet where both are read: blocks
    are shuffled once and not copied for each block of the other side, so that disk grows with the rows, no task makes all pairs of a key,
    and pairs aren't shuffled."""
    number = lambda df, name: df.groupBy(key).agg(count().alias(name))
    sizes = number(left, "__n").join(number(right, "__m"), key).withColumn("__wide", F.col("__n") * F.col("__m") > size * size)
    few, wide = sizes.where("NOT __wide").select(key), sizes.where("__wide")
    of = lambda df: [c for c in df.columns if c != key]
    columns = [key, *of(left), *of(right)]

    def blocks(df: DataFrame, n: str, name: str) -> DataFrame:
        dealt = df.join(wide.select(key, F.ceil(F.col(n) / size).cast("int").alias("__of")), key)
        dealt = dealt.select(key, F.pmod(F.xxhash64(*df.columns), F.col("__of")).cast("int").alias("__block"), F.struct(*of(df)).alias("__row"))
        return dealt.repartition(_SIDES, key, "__block").groupBy(key, "__block").agg(F.collect_list("__row").alias(name)).drop("__block")

    # The product is of blocks, a thousandth of the rows on each side; most pairs of them that share no key end there.
    a, b = blocks(left, "__n", "__a"), blocks(right, "__m", "__b")
    pairs = a.join(b.hint("shuffle_replicate_nl"), key).select(key, "__b", F.explode("__a").alias("__x")).select(key, "__x", F.explode("__b").alias("__y"))
    small = left.join(few, key, "left_semi").join(right, key).select(*columns)
    return small.union(pairs.select(key, *(F.col(f"__x.{c}") for c in of(left)), *(F.col(f"__y.{c}") for c in of(right))))
