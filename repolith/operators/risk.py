"""Percentiles, risk scores, bands and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.predicates import NON_SOURCE, TEST_FILE
from repolith.operators.lineage import count, cut, numbered

#: The order of bands and levels.
LEVELS = ("critical", "high", "medium", "low")


def ranked_value(values: DataFrame, column: str, at: Column) -> DataFrame:
    """The value at a 0-based place (a column over n) of the sorted column, exactly.

    Values are counted, the distinct ones dealt by ranges and summed within a
    range and over the ranges' totals: no task orders all of them.
    """
    h = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(count().alias("c"))
    dealt = cut(h.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("c").alias("k"))
    before = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("n"))  # a row for each range
    up = dealt.join(F.broadcast(before), "part").withColumn("cum", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return up.where(F.col("cum") > at).agg(F.min("v").alias("value"))


def pctl_floor_n(values: DataFrame, column: str, p: float) -> DataFrame:
    """Place min(n - 1, floor(n p))."""
    return ranked_value(values, column, F.least(F.col("n") - 1, F.floor(F.col("n") * p)))


def pctl_floor_nm1(values: DataFrame, column: str, p: float) -> DataFrame:
    """Place floor((n - 1) p)."""
    return ranked_value(values, column, F.floor((F.col("n") - 1) * p))


def risk_caps(metrics: DataFrame, p: float = 0.9) -> DataFrame:
    """churn_cap, coupling_cap: one row."""
    return pctl_floor_n(metrics, "churn_lines", p).select(F.coalesce("value", F.lit(0)).alias("churn_cap")).crossJoin(pctl_floor_n(metrics, "coupling", p).select(F.coalesce("value", F.lit(0)).alias("coupling_cap")))


def risk_scores(metrics: DataFrame) -> DataFrame:
    """metrics: path, churn_lines, bug_density, coupling. Adds score: 0.4 churn + 0.3 bugs + 0.3 coupling, each up to 1."""
    part = lambda x, cap: F.least(F.lit(1.0), F.col(x) / F.greatest(F.col(cap), F.lit(1)))
    x = metrics.crossJoin(F.broadcast(risk_caps(metrics)))
    return x.withColumn("score", 0.4 * part("churn_lines", "churn_cap") + 0.3 * F.least(F.lit(1.0), 2 * F.col("bug_density")) + 0.3 * part("coupling", "coupling_cap"))


def risk_bands(scored: DataFrame) -> DataFrame:
    """Adds rk and label. The first 5 % by score are critical (one at least), up to 15 % high, up to 35 % medium; scores under 0.05 are low.

    """
    n = scored.agg(count().alias("n"))
    c = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.05))
    h = F.greatest(c + 1, F.ceil(F.col("n") * 0.15))
    m = F.greatest(h + 1, F.ceil(F.col("n") * 0.35))
    x = numbered(scored, [F.desc("score"), F.col("path")]).crossJoin(F.broadcast(n))
    label = F.when(F.col("score") < 0.05, "low").when(F.col("rk") <= c, "critical").when(F.col("rk") <= h, "high").when(F.col("rk") <= m, "medium").otherwise("low")
    return x.withColumn("label", label).drop("n")


def band_counts(banded: DataFrame) -> DataFrame:
    return banded.groupBy("label").agg(count().alias("n"))


def risk_overlay(metrics: DataFrame) -> DataFrame:
    """metrics: path, churn_lines, bug_density, bus_factor, coupling. Adds score and level by the fixed-scale model."""
    owner = F.when(F.col("bus_factor") == 0, 0.0).when(F.col("bus_factor") == 1, 0.6).when(F.col("bus_factor") == 2, 0.3).otherwise(0.1)
    score = 0.35 * F.least(F.lit(1.0), F.col("churn_lines") / 1000) + 0.30 * F.least(F.lit(1.0), 2 * F.col("bug_density")) + 0.20 * owner + 0.15 * F.least(F.lit(1.0), F.col("coupling") / 5)
    return metrics.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"))


def change_level(importers: Column, covered: Column, aside: Column) -> Column:
    """aside: tests and files that aren't source."""
    hub = importers >= 5
    return (
        F.when(aside & hub, "high").when(aside, "low").when(hub & ~covered, "critical").when(hub | (~covered & (importers > 2)), "high")
        .when(~covered, "medium").when(importers > 2, "medium").otherwise("low")
    )


def containing(paths: DataFrame, stems: DataFrame, most: int = 2000) -> DataFrame:
    """The stems (stem) that some path holds. Up to a counted number of stems each path is held against all; more are joined to the paths' substrings of the stems' lengths."""
    if stems.count() <= most:
        return paths.join(F.broadcast(stems), F.contains("path", F.col("stem"))).select("stem").distinct()
    lengths = [r.n for r in stems.select(F.length("stem").alias("n")).distinct().collect()]  # as many as a path has characters
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - n + 1, F.lit(1))), lambda i: F.substring("path", i, F.lit(n)))
    cut_out = paths.select(F.explode(F.array_distinct(F.flatten(F.array(*(starts(n) for n in lengths))))).alias("stem"))
    return stems.join(cut_out.distinct(), "stem", "left_semi")


def change_risk(changed: DataFrame, edges: DataFrame, test_pattern: str = TEST_FILE, non_source: str = NON_SOURCE) -> DataFrame:
    """path, importers, covered, level of changed files. Covered: tests, files that aren't source, files that a test imports, and
    those whose name without its ending is part of a test file's path."""
    c = changed.select("path").distinct()
    imp = edges.join(c, edges["dst"] == c["path"]).groupBy("path").agg(F.countDistinct("src").alias("importers"), F.max(F.col("src").rlike(test_pattern)).alias("by_test"))
    stem = F.element_at(F.split(F.regexp_replace("path", "\\.[^.]+$", ""), "/"), -1)
    named = c.withColumn("stem", stem).where("stem != ''")
    tests = edges.select(F.explode(F.array("src", "dst")).alias("path")).where(F.col("path").rlike(test_pattern)).distinct()
    held = containing(tests, named.select("stem").distinct())
    x = c.join(imp, "path", "left").join(named.join(held, "stem", "left_semi").select("path", F.lit(True).alias("by_name")), "path", "left")
    x = x.withColumn("importers", F.coalesce("importers", F.lit(0))).withColumn("aside", F.col("path").rlike(test_pattern) | F.col("path").rlike(non_source))
    x = x.withColumn("covered", F.col("aside") | F.coalesce("by_test", F.lit(False)) | F.coalesce("by_name", F.lit(False)))
    return x.select("path", "importers", "covered", change_level(F.col("importers"), F.col("covered"), F.col("aside")).alias("level"))


def by_level(levels: DataFrame, column: str = "level") -> DataFrame:
    """Rows from the gravest level to the least, then by path."""
    return levels.orderBy(F.array_position(F.array(*map(F.lit, LEVELS)), F.col(column)), "path")


def churn_bucket_tool(lines: Column) -> Column:
    return F.when(lines < 100, "low").when(lines < 500, "medium").otherwise("high")


def churn_bucket_dashboard(lines: Column) -> Column:
    return F.when(lines > 500, "high").when(lines > 100, "medium").otherwise("low")


def pr_risk(levels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """score, label, passes over the levels of the changed files."""
    s = F.max(F.when(F.col("level") == "critical", 1.0).when(F.col("level") == "high", 0.8).when(F.col("level") == "medium", 0.5).otherwise(0.2))
    return levels.agg(s.alias("score")).select("score", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("label"), (F.col("score") < threshold).alias("passes"))


def trend_snapshot(all_nodes: DataFrame, edges: DataFrame, banded: DataFrame, factor: DataFrame, churn: DataFrame, now: int, entry_pattern: str, days: int = 7) -> DataFrame:
    """One row of totals; churn_recent_files is the lifetime churn of files touched in the last days."""
    used = edges.select(F.col("dst").alias("path")).distinct()
    dead = all_nodes.join(used, "path", "left_anti").where(~F.col("path").rlike(entry_pattern)).agg(count().alias("dead_files"))
    return (
        all_nodes.agg(count().alias("total_files")).crossJoin(edges.agg(count().alias("total_edges"))).crossJoin(dead)
        .crossJoin(factor.agg(F.avg("bus_factor").alias("avg_bus_factor")))
        .crossJoin(banded.agg(F.count(F.when(F.col("label").isin("critical", "high"), 1)).alias("high_risk_files")))
        .crossJoin(churn.agg(F.coalesce(F.sum(F.when(F.col("last_touch") >= now - days * 86400, F.col("churn_lines"))), F.lit(0)).alias("churn_recent_files")))
    )  # fmt: skip  # each side is one row
