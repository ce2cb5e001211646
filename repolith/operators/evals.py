"""Evaluation of predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.lineage import count


def prf(truth: DataFrame, predicted: DataFrame, key: list[str], group: str) -> DataFrame:
    """group, tp, n_truth, n_predicted, precision, recall, f1 over distinct keys. Without predictions precision is 1, without truth recall is 1; f1 of nothing is 0."""
    both = truth.select(*key, F.lit(1).alias("t"), F.lit(0).alias("p")).union(predicted.select(*key, F.lit(0), F.lit(1)))
    x = both.groupBy(*key).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    s = x.groupBy(group).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"))
    s = s.withColumn("precision", F.when(F.col("n_predicted") == 0, 1.0).otherwise(F.col("tp") / F.col("n_predicted"))).withColumn("recall", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("tp") / F.col("n_truth")))
    total = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def source_recall(truth: DataFrame, predicted: DataFrame, key: list[str], group: str, is_source: Column) -> DataFrame:
    """group, n_source_truth, source_tp, source_recall over distinct keys whose file is source; without any the recall is 1. Groups without truth have a row."""
    groups = truth.select(group).union(predicted.select(group)).distinct()
    hit = truth.where(is_source).select(*key).distinct().join(predicted.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    s = hit.groupBy(group).agg(count().alias("n_source_truth"), F.count("hit").alias("source_tp"))
    s = groups.join(s, group, "left").na.fill(0, ["n_source_truth", "source_tp"])
    return s.withColumn("source_recall", F.when(F.col("n_source_truth") == 0, 1.0).otherwise(F.col("source_tp") / F.col("n_source_truth")))


def coverage_by_group(expected: DataFrame, found: DataFrame, key: str, group: str) -> DataFrame:
    """group, n_expected, n_found, coverage (null without any)."""
    hit = found.select(key).distinct().withColumn("hit", F.lit(1))
    return expected.join(hit, key, "left").groupBy(group).agg(count().alias("n_expected"), F.count("hit").alias("n_found")).withColumn("coverage", F.col("n_found") / F.nullif(F.col("n_expected"), F.lit(0)))


def import_coverage(n_edges: DataFrame, n_specs: DataFrame, group: str) -> DataFrame:
    """min(1, edges / distinct relative specifiers), null without any."""
    x = n_specs.join(n_edges, group, "left").fillna(0, ["edges"])
    return x.withColumn("coverage", F.least(F.lit(1.0), F.col("edges") / F.nullif(F.col("specs"), F.lit(0))))
