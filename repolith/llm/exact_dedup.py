"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest: one row for each distinct
text ever added. Its files lie in the shared folder, never in a machine's own warehouse. A batch is pre-aggregated to one row a digest, an anti-join by
sort-merge against the index finds the digests that are new, and these are
appended. The index side of that join is neither shuffled nor sorted again.

Texts are equal when identical after lower-casing A-Z only; a null text counts
as empty. Of equal texts in a batch the row with the largest doc_id stays; a
text that the index held before the batch keeps the row it had. Null ids rank
below all others. Rows that repeat both id and text are one document: lookup()
marks each of them, dedup() returns one. An empty table leaves the index as it
was. group_size counts the rows of the batch that brought the text; later batches
don't change it. The index has one writer at a time, like any table of files: two
that append at once may both bring a text. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm.common import ascii_lower, free_name, remove, scratch

#: Rows of documents for each bucket of a new index: some 100 MB of digests.
BUCKET_ROWS = 1 << 20
DIGEST = "text_sha256"
SCHEMA = f"{DIGEST} string, keep_id long, group_size long"


def with_digest(documents: DataFrame, column: str = DIGEST) -> DataFrame:
    return documents.withColumn(column, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))


@dataclass
class DigestIndex:
    spark: SparkSession
    table: str
    #: Fixed when the table is made.
    buckets: int = 32

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = 32, rows: int = 0) -> DigestIndex:
        """An empty index, with more buckets if it is to hold many rows."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex[:12]}", max(buckets, -(-rows // BUCKET_ROWS))).create()

    def create(self) -> DigestIndex:
        """Makes the empty table if there is none."""
        if not self.spark.catalog.tableExists(self.table):
            self.append(self.spark.createDataFrame([], SCHEMA))
        return self

    def append(self, groups: DataFrame) -> None:
        writer = groups.write.bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").format("parquet")
        if not self.spark.catalog.tableExists(self.table):
            writer = writer.option("path", scratch(self.spark, self.table))
        writer.saveAsTable(self.table)

    def add(self, documents: DataFrame) -> None:
        """Appends the digests of documents that the index lacks, each with the id that stays and the number of rows in this batch."""
        groups = with_digest(documents.select("doc_id", "text")).groupBy(DIGEST).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.create().spark.table(self.table).select(DIGEST)
        fresh = groups.hint("merge").join(known.hint("merge"), DIGEST, "left_anti")
        self.append(fresh.select(DIGEST, F.col("keep_id").cast("long").alias("keep_id"), "group_size").repartition(self.buckets, DIGEST))

    def drop(self) -> None:
        if self.spark.catalog.tableExists(self.table):
            at = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Location'").first().data_type
            self.spark.sql(f"DROP TABLE {self.table}")
            remove(self.spark, at)

    def rows(self) -> DataFrame:
        """The index without its bucketing, so that a join with a hot digest can be split at run time."""
        files = self.spark.table(self.table).inputFiles()
        schema = self.spark.table(self.table).schema
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def lookup(self, documents: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept and digest for every row of documents."""
        mine = with_digest(documents.select("doc_id", "text")).select("doc_id", DIGEST)
        return mine.join(self.rows(), DIGEST).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), DIGEST)

    def dedup(self, documents: DataFrame) -> DataFrame:
        """The rows of documents that stay, with all their columns. Dealt by digest and id, so that a hot digest doesn't meet in one task."""
        digest = free_name(documents.columns, DIGEST)
        stay = self.rows().select(F.col(DIGEST).alias("stays"), F.col("keep_id").alias("kept_id"))
        mine = with_digest(documents, digest)
        joined = mine.join(stay, (mine[digest] == stay["stays"]) & mine["doc_id"].eqNullSafe(stay["kept_id"]), "left_semi")
        return joined.dropDuplicates([digest, "doc_id"]).drop(digest)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex.fresh(spark, rows=documents.count())
    index.add(documents)
    return index.lookup(documents)


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
