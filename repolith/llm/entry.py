"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import chat_quotes, exact_dedup, jaccard_join, quality, source_divergence, toxicity, warc
from repolith.llm.chat_quotes import op5_chat_quotes
from repolith.llm.common import crc_mod
from repolith.llm.conversation_repair import op11_conversation_repair
from repolith.llm.exact_dedup import op9_exact_dedup
from repolith.llm.jaccard_join import op7_jaccard_join
from repolith.llm.license_scan import op13_license_scan
from repolith.llm.media import op3_media
from repolith.llm.packing import op10_packing
from repolith.llm.source_divergence import op12_source_divergence
from repolith.llm.sp_codec import op8_sentencepiece
from repolith.llm.token_counts import op4_token_counts
from repolith.llm.warc import op6_warc

THRESHOLD = 0.3


def training_labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, held: int) -> DataFrame:
    """Labels of the rows to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(crc_mod(F.col("doc_id"), modulus) != held).select("doc_id", F.col(column).alias("label"))


def judged(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(quality.score(documents, quality.train(documents, training_labels(spark, sf_dir, "quality", 5, 0))), 5, 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(toxicity.score(documents, toxicity.train(documents, training_labels(spark, sf_dir, "toxic", 4, 2))), 4, 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_quality, op2_toxicity, op3_media, op4_token_counts, op5_chat_quotes, op6_warc, op7_jaccard_join, op8_sentencepiece, op9_exact_dedup, op10_packing, op11_conversation_repair, op12_source_divergence, op13_license_scan]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_quotes": chat_quotes.SQL, "op6_warc": warc.SQL, "op7_jaccard_join": jaccard_join.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_source_divergence": source_divergence.SQL}
