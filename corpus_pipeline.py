"""From documents to packed sequences: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage works on all rows its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import jaccard_join, packing, quality, toxicity
from repolith.llm.common import free_name, remove, scratch
from repolith.llm.entry import THRESHOLD, training_labels
from repolith.llm.exact_dedup import DigestIndex


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled rows of documents."""
    model = quality.train(docs, training_labels(spark, sf_dir, "quality", 5, 0))
    score = free_name(docs.columns, "score")
    return quality.score(docs, model, keep=docs.columns, into=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't mark."""
    model = toxicity.train(docs, training_labels(spark, sf_dir, "toxic", 4, 2))
    score = free_name(docs.columns, "score")
    return toxicity.score(docs, model, keep=docs.columns, into=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    index = DigestIndex.fresh(spark)
    index.add(docs)
    return index.dedup(docs)


#: Near duplicates: five words, similarity 0.8 or more.
NEAR = jaccard_join.Params(width=5, percent=80)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id. Documents without an id are in no group and stay."""
    linked = jaccard_join.jaccard_components(docs, NEAR)
    gone = linked.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack(docs, packing.word_encoder())


STAGES = [("quality classifier", quality_stage), ("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("best-fit packing", packing_stage)]

#: The classifiers and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, at = at, scratch(spark, f"stage{k}")
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)  # its rows that stay are in the next one's
    return docs
