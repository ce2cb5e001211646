"""Token counts from an exact length histogram.

Documents are aggregated by encoded length: one row a distinct length, however
many documents. Suffix sums over that histogram then answer, for a context limit
of any length, how many documents reach it, the total of all documents cut to
it, and where quantiles lie.

A null text counts as empty (length 0). Repeated rows count each. An empty table
gives an empty histogram; quantiles over it are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.llm.common import cut, slices

#: Lengths in a block: prefix sums run within blocks, and over the blocks' totals.
BLOCK = 128


def lengths(documents: DataFrame, encoder: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """doc_id and n_tokens. encoder() makes a function from texts to their token counts, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder()
        for batch in batches:
            texts, n = batch.column(1), []
            for low, high in slices(texts):
                n += count([t or "" for t in texts[low:high].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def byte_bpe(path: str | None = None) -> Callable[[], Callable[[list[str]], list[int]]]:
    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(lib.encode_ordinary(t)) for t in texts]

    return make


def histogram(counted: DataFrame) -> DataFrame:
    """Of n_tokens, a row for each distinct length L: documents of it and suffix and prefix sums, exact.

    docs, tokens: of length L. docs_ge, tokens_ge: of length L or more.
    docs_le: of length L or less. truncated_tokens: all documents' tokens when each is cut to L.
    """
    h = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = h.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # One row a block of lengths: some thousand rows for documents of a million tokens.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("block", F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("above_docs"), F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("above_tokens"))
    all_docs = totals.agg(F.sum("block_docs").alias("all_docs"), F.sum("block_tokens").alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        h.join(above, "block")
        .withColumn("docs_ge", F.sum("docs").over(within) + F.col("above_docs"))
        .withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("above_tokens"))
        .crossJoin(F.broadcast(all_docs))  # one row
    )
    return out.select(
        "n_tokens", "docs", "tokens", "docs_ge", "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge") + F.col("docs")).alias("docs_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_tokens"),
        F.col("all_docs"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents beyond it, and the total of tokens when all are cut to it.

    Each limit is looked up in the histogram's sums: the row of the greatest
    length up to it says how many documents are no longer and what they hold.
    One pass over the rows answers all limits.
    """
    found = F.array(*(F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "docs_le", "truncated_tokens"))).alias("at"), F.max("all_docs").alias("all_docs")) for x in limits))
    x = hist.agg(found.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    over = F.coalesce("all_docs", F.lit(0)) - F.coalesce("at.docs_le", F.lit(0))
    held = F.coalesce(F.col("at.truncated_tokens") - (F.col("all_docs") - F.col("at.docs_le")) * F.col("at.n_tokens"), F.lit(0))
    return x.select("context_limit", over.alias("docs_over"), (held + over * F.col("context_limit")).alias("truncated_tokens"))


def quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """The least length with at least a share p of all documents at or below it, in one pass over the rows."""
    found = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.min(F.when(F.col("docs_le") >= F.col("all_docs") * p, F.col("n_tokens"))).alias("n_tokens")) for p in probabilities))
    return hist.agg(found.alias("x")).select(F.explode("x").alias("x")).select("x.*")


#: Context limits and quantiles that the query answers besides the histogram.
LIMITS = [128 << k for k in range(14)]
QUANTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram (part length), and out of it what context limits (part limit: docs_ge counts the documents that go over it) and
    quantiles (part quantile) say."""
    counted = lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())
    hist = cut(histogram(cut(counted, "lengths")), "histogram")
    columns = ["part", "n_tokens", "share", *(c for c in hist.columns if c not in ("n_tokens", "all_docs"))]
    at = at_limits(hist, LIMITS).select(F.lit("limit").alias("part"), F.col("context_limit").alias("n_tokens"), F.col("docs_over").alias("docs_ge"), "truncated_tokens")
    shares = quantiles(hist, QUANTILES).select(F.lit("quantile").alias("part"), "n_tokens", F.col("p").alias("share"))
    whole = hist.select(F.lit("length").alias("part"), "*").drop("all_docs").withColumn("share", F.lit(None).cast("double"))
    return whole.unionByName(at, allowMissingColumns=True).unionByName(shares, allowMissingColumns=True).select(*columns)
