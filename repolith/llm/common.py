"""What several of these operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators.lineage import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/repolith-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._repolith_path = at  # type: ignore[attr-defined]
    return back


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    at = getattr(df, "_repolith_path", None)
    if at:
        remove(df.sparkSession, at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cuts() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a cut() whose files are deleted at the end."""
    made: list[DataFrame] = []

    def mine(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    try:
        yield mine
    finally:
        for df in made:
            drop_cut(df)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean_batches(spark: SparkSession, most: str = "4m") -> None:
    """Smaller Arrow batches than Spark's 64 MB, unless the session has set a size: texts are held on both sides of the pipe to Python,
    and Spark keeps the buffers beside its heap for later batches."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)


def lean_memory() -> None:
    """Has this worker take memory for Arrow from the system's allocator, and that give freed blocks of 1 MB back at once, smaller ones when
    the next task begins. Workers live on from stage to stage; what they keep is missing in the next one. Without glibc only the first
    part holds."""
    import ctypes

    libc = None
    with suppress(OSError):
        libc = ctypes.CDLL("libc.so.6")
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
        with suppress(AttributeError):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    gc.collect()
    with suppress(AttributeError):
        libc.malloc_trim(0)


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for the queries that run inside; what was set before comes back. Dots in names are double underscores."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def arrow_bytes(spark: SparkSession, most: str):
    """Bounds the Arrow batches of the queries that run inside: wide rows then need less memory beside the heap."""
    return settings(spark, **{ARROW_BYTES.replace(".", "__"): most})


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing holds any more. It does so only once the driver's garbage is
    collected, which on a driver with little to do takes longer than many jobs."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that isn't among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Text of ASCII alone takes the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def map_rows(df: DataFrame, schema: str, on_batch: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """mapInArrow with a function from a batch to columns; the batch is as large as Spark makes it (64 MB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                out = on_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """An Arrow schema from 'name type, ...' of flat types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(","))])


class WordCache(dict):
    """Word -> what make(word) gave. Full, it starts anew and takes over from the one before what is asked for again: memory is
    bounded and frequent words stay. Very long words are never kept."""

    def __init__(self, make: Callable[[str], object], most: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, word: str):
        made = self.before.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= self.longest:
            self.keep(word, made)
        return made

    def keep(self, word: str, made: object) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[word] = made

    def empty(self) -> None:
        self.clear()
        self.before = {}


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with some MB of text each."""
    import pyarrow.compute as pc

    low = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield low, i
            low, size = i, 0
        size += n or 0
    if low < len(texts):
        yield low, len(texts)
