"""JSON-line logs: trends, file risk, telemetry, review telemetry. Malformed lines are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREND = "timestamp string, unixSeconds long, totalFiles long, totalEdges long, deadFiles long, avgBusFactor double, highRiskFiles long, churnLinesLast7d long, source string, gitSha string"
POINT = "unixSeconds long, file string, score double, label string"
EVENT = "ts string, event string, tool string, original_tokens double, budget double, ratio double, mode string, fallback_reason string"
REVIEW = "pr long, title string, posted_at string, specialists struct<architecture:long,security:long,performance:long,tests:long>, verdict string, severity_counts map<string,long>, tier_distribution map<string,long>"
LABELS = ("critical", "high", "medium", "low")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    bad = "_malformed"
    return spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path).where(F.col(bad).isNull()).drop(bad)


def trends(spark: SparkSession, path: str, now: int, days: int = 30, newest: int = 500) -> DataFrame:
    """Complete rows since so many days, the newest ones, oldest first."""
    rows = _json(spark, path, TREND).where("unixSeconds IS NOT NULL AND totalFiles IS NOT NULL AND totalEdges IS NOT NULL AND deadFiles IS NOT NULL")
    return rows.where(F.col("unixSeconds") >= now - days * 86400).orderBy(F.desc("unixSeconds")).limit(newest).orderBy("unixSeconds")


def file_risk(spark: SparkSession, path: str, file: str, since: int | None = None, newest: int = 200) -> DataFrame:
    """A file's points; total_count counts them before since."""
    rows = _json(spark, path, POINT).where(F.col("label").isin(*LABELS) & (F.col("file") == file) & F.col("unixSeconds").isNotNull() & F.col("score").isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    kept = rows if since is None else rows.where(F.col("unixSeconds") >= since)
    return kept.orderBy(F.desc("unixSeconds")).limit(newest).crossJoin(F.broadcast(total)).orderBy("unixSeconds")


def telemetry(spark: SparkSession, path: str, since: str, until: str, tool: str | None = None) -> DataFrame:
    """Events within [since, until]. Logs lie in day=YYYY-MM-DD folders: other days aren't read."""
    rows = spark.read.schema(f"{EVENT}, _malformed string, day date").option("columnNameOfCorruptRecord", "_malformed").option("basePath", path).json(path)
    ts = F.try_to_timestamp("ts")
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    rows = rows.where((F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(hi))).where(F.col("_malformed").isNull() & ts.isNotNull() & (ts >= lo) & (ts <= hi)).drop("_malformed").withColumn("ts", ts)
    return rows.where(F.col("tool") == tool) if tool else rows


def append_telemetry(events: DataFrame, path: str) -> None:
    """Appends events (with ts as timestamp) to their days' folders."""
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").json(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, REVIEW)
