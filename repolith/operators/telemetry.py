"""Telemetry: sessions, transitions, budgets, quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.time import micros
from repolith.operators.lineage import count, with_next
from repolith.operators.risk import pctl_floor_nm1


def token_estimate(text: Column | str) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4)


#: Fixed value: observed tokens count up to this number.
MOST_TOKENS = 100_000


def tool_transitions(events: DataFrame, gap_seconds: float = 90, least: int = 3, k: int = 3, by: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """from_tool, to_tool, n, avg_tokens, rk: changes of tool within the gap, most frequent first. With a list of allowed tools only those lead or follow.

    Without by, order is global: events are dealt by ranges of time, and a range's last event takes its successor from the next one.
    """
    x = with_next(events.select("ts", "event_id", "tool", "original_tokens", *([by] if by else [])), [by] if by else [], [F.col("ts"), F.col("event_id")], ["ts", "tool", "original_tokens"], "next")
    gap = micros("next.ts") - micros("ts")
    x = x.where((gap <= int(gap_seconds * 1e6)) & (F.col("next.tool") != F.col("tool")))
    if allowed is not None:
        x = x.where(F.col("tool").isin(allowed) & F.col("next.tool").isin(allowed))
    tokens = F.least(F.greatest("next.original_tokens", F.lit(0.0)), F.lit(float(MOST_TOKENS)))
    n = x.groupBy(F.col("tool").alias("from_tool"), F.col("next.tool").alias("to_tool")).agg(count().alias("n"), F.avg(tokens).alias("avg_tokens"))
    rank = Window.partitionBy("from_tool").orderBy(F.desc("n"), "to_tool")
    return n.where(F.col("n") >= least).withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)


def sessions(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Adds session (by user, from 0) and place in it. A gap of exactly the limit still belongs to the session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((micros("ts") - micros(F.lag("ts").over(w)) > int(gap_seconds * 1e6)).cast("long"), F.lit(0))
    x = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "session").orderBy("ts", "event_id"))).drop("new")


def session_counts(events: DataFrame, gap_seconds: float) -> DataFrame:
    return sessions(events, gap_seconds).groupBy("user_id", "session").agg(count().alias("calls"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def budget_breaches(events: DataFrame, gap_seconds: float, limit: int = 8) -> DataFrame:
    """The call that first goes over the limit, once a session."""
    return sessions(events, gap_seconds).where(F.col("place") == limit + 1).select("user_id", "session", "event_id", "tool")


def fallback_split(events: DataFrame) -> DataFrame:
    """events: tool, mode. By tool: calls, breaches (all that fell back), and rounded shares by mode."""
    share = lambda m: F.floor(100 * F.count(F.when(F.col("mode") == m, 1)) / count() + 0.5)
    return events.groupBy("tool").agg(count().alias("calls"), F.count(F.when(F.col("mode") != "full", 1)).alias("breaches"), share("skeleton").alias("skeleton_pct"), share("truncate").alias("truncate_pct"), share("error").alias("error_pct"))


def token_quantiles(events: DataFrame, column: str = "original_tokens") -> DataFrame:
    """n, min, p50, p75, p95, max: one row."""
    out = events.where(F.col(column).isNotNull()).agg(count().alias("n"), F.min(column).alias("min"), F.max(column).alias("max"))
    for p in (50, 75, 95):
        out = out.crossJoin(pctl_floor_nm1(events, column, p / 100).select(F.col("value").alias(f"p{p}")))
    return out


def breaches_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(count().alias("breaches"))


def budget_ladder(rows: DataFrame) -> DataFrame:
    """rows: full, skeleton, budget (tokens, null: none). Adds mode (full, skeleton, truncate, error), data, tokens, ratio."""
    full, skel, budget = token_estimate("full"), token_estimate("skeleton"), F.col("budget")
    mode = F.when(budget.isNull() | (full <= budget), "full").when(F.col("skeleton").isNotNull() & (skel <= budget), "skeleton").when(budget > 0, "truncate").otherwise("error")
    data = F.when(F.col("mode") == "full", F.col("full")).when(F.col("mode") == "skeleton", F.col("skeleton")).when(F.col("mode") == "truncate", F.expr("substring(full, 1, CAST(budget * 4 AS INT))"))
    x = rows.withColumn("mode", mode).withColumn("data", data)
    return x.withColumn("tokens", token_estimate("data")).withColumn("ratio", F.col("tokens") / F.nullif(full, F.lit(0)))


def last_per_file(points: DataFrame) -> DataFrame:
    """Of each file the latest (path, ts, score)."""
    return points.groupBy("path").agg(F.max_by("score", F.struct("ts", "score")).alias("score"), F.max("ts").alias("ts"))


def change_filter(points: DataFrame, least: float = 0.02) -> DataFrame:
    """Points (path, ts, score, label) kept when first, of another label than the last kept one, or so far from its score. Series go by
    in order of time, with the last kept point alone in memory."""
    x = points.select("path", F.col("ts").cast("long").alias("ts"), F.col("score").cast("double").alias("score"), "label")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, label, score, begun = None, None, 0.0, False
        for pdf in frames:
            keep = []
            for i, (p, s, k) in enumerate(zip(pdf["path"], pdf["score"], pdf["label"], strict=True)):
                if not begun or p != path or k != label or not abs(score - s) < least:
                    begun, path, score, label = True, p, s, k
                    keep.append(i)
            yield pdf.iloc[keep]

    return x.repartition("path").sortWithinPartitions("path", "ts", "score", "label").mapInPandas(run, x.schema)


def token_savings(files: DataFrame) -> DataFrame:
    """n_files, full_tokens, skeleton_tokens, saved_pct: one row over files (content, skeleton; null skeletons save nothing)."""
    x = files.where("content IS NOT NULL").select(F.length("content").alias("a"), F.length(F.coalesce("skeleton", "content")).alias("b"))
    sums = x.agg(count().alias("n_files"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    tokens = lambda c: F.floor(F.col(c) / 4 + 0.5)
    return sums.select("n_files", tokens("a").alias("full_tokens"), tokens("b").alias("skeleton_tokens"), F.floor(100 * (F.col("a") - F.col("b")) / F.nullif(F.col("a"), F.lit(0)) + 0.5).alias("saved_pct"))


def review_summary(rows: DataFrame, specialists: list[str]) -> DataFrame:
    """specialist, n, total, min, max, p50, p75, p95 of nullable token columns, unpivoted. The windows see a row for each distinct count of tokens."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("specialist"), F.col(s).cast("long").alias("tokens")) for s in specialists))).alias("x")).select("x.*").where("tokens is not null")
    h = long.groupBy("specialist", "tokens").agg(count().alias("c"))
    w = Window.partitionBy("specialist")
    up = h.withColumn("cum", F.sum("c").over(w.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("cum") > F.floor((F.col("n") - 1) * p), F.col("tokens")))
    return up.groupBy("specialist").agg(F.max("n").alias("n"), F.sum(F.col("tokens") * F.col("c")).alias("total"), F.min("tokens").alias("min"), F.max("tokens").alias("max"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.95).alias("p95"))


def review_verdicts(rows: DataFrame, severities: list[str]) -> DataFrame:
    """tier, verdict, n and the sum of each severity's findings."""
    return rows.groupBy("tier", "verdict").agg(count().alias("n"), *(F.sum(c).alias(c) for c in severities))
