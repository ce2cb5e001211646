"""Structured Streaming twins: file changes, task budgets, trend collapse, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from repolith.operators import trends
from repolith.operators.lineage import count, cut
from repolith.sources import store

CHANGE = "path string, kind string, ts timestamp, content string"


def changes(spark: SparkSession, directory: str) -> DataFrame:
    """File-change records (add, change, unlink) as they arrive in a directory of JSON lines."""
    return spark.readStream.schema(CHANGE).json(directory)


def latest(batch: DataFrame) -> DataFrame:
    """Of a trigger's records the last of each path: what a debounce leaves."""
    return batch.groupBy("path").agg(F.max_by(F.struct("kind", "content", "ts"), "ts").alias("x")).select("path", "x.*")


def maintain_files(stream: DataFrame, root: str, checkpoint: str):
    """Keeps a versioned table of files: unlinked paths go, others are replaced. A batch that is run again gives the same table."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        last = latest(batch)
        old = store.load(spark, root, "files")
        fresh = last.where("kind != 'unlink'").select("path", "content")
        new = fresh if old is None else old.join(last.select("path"), "path", "left_anti").unionByName(fresh)
        store.save({"files": new}, root)
        store.compact(spark, root, 2)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def maintain_index(stream: DataFrame, root: str, checkpoint: str):
    """Keeps files, imports, symbols, calls, resolved edges and vectors together, as a base and deltas: a batch writes in proportion to
    what it changes, and is taken in once even if it is run again. store.load() and index.CodeIndex read it."""
    from repolith.sources.index import CodeIndex

    def step(batch: DataFrame, number: int) -> None:
        CodeIndex(batch.sparkSession, root).apply(latest(batch), number + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def maintain_overlay(stream: DataFrame, root: str, checkpoint: str, bug_pattern: str, quiet: str = "30 seconds"):
    """Merges new commits (sha, author, ts, message, is_merge, files array of path, added, deleted) into the history's measures, once a quiet time. Commits seen before count once."""
    from repolith.operators import overlay

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        seen = store.load(spark, root, "seen")
        fresh = batch.dropDuplicates(["sha"])
        fresh = cut(fresh if seen is None else overlay.new_commits(fresh, seen), "commits")
        files = fresh.select("sha", F.explode("files").alias("f")).select("sha", "f.*")
        new = overlay.measures(fresh.drop("files"), files, bug_pattern)
        old = None if seen is None else {name: store.load(spark, root, name) for name in new}
        shas = fresh.select("sha")
        store.save((new if old is None else overlay.merge(old, new)) | {"seen": shas if seen is None else seen.unionByName(shas)}, root)
        store.compact(spark, root, 2)

    return stream.writeStream.foreachBatch(step).trigger(processingTime=quiet).option("checkpointLocation", checkpoint)


def task_budget(events: DataFrame, gap_seconds: float = 90, limit: int = 8, idle: str = "1 day") -> DataFrame:
    """user_id, event_id, calls for the call that first goes over the limit in a session; events: user_id, event_id, ts.

    State: last event and calls of the session. It goes once the watermark has
    passed the session's end: users who are away take no memory.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, calls = state.get if state.exists else (None, 0)
        out = []
        # A user's events come in several frames, in no order; two numbers an event are held to sort them all.
        held = [(pdf["ts"].to_numpy("datetime64[us]").astype("int64"), pdf["event_id"].to_numpy("int64")) for pdf in batches]
        times, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        for k in np.lexsort((ids, times)):
            us = int(times[k])
            calls = 1 if last is None or us - last > gap_seconds * 1e6 else calls + 1
            last = us if last is None else max(last, us)
            if calls == limit + 1:
                out.append((key[0], int(ids[k]), calls))
        state.update((last, calls))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + int(gap_seconds * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "calls"])

    return events.select("user_id", "event_id", "ts").withWatermark("ts", idle).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, calls long", "last long, calls long", "append", GroupStateTimeout.EventTimeTimeout)


def sparse_points(points: DataFrame, least: float = 0.02) -> DataFrame:
    """File-risk points (path, ts, score, label) that differ from the last kept one."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        out = []
        # Points come in several frames, in no order.
        frames = list(batches)
        points = pd.concat(frames) if len(frames) > 1 else frames[0]
        for ts, score, label in sorted(zip(points["ts"], points["score"], points["label"], strict=True)):
            if kept is None or kept[1] != label or abs(kept[0] - score) >= least:
                kept = (float(score), label)
                out.append((key[0], int(ts), float(score), label))
        if kept is not None:
            state.update(kept)
        if out:
            yield pd.DataFrame(out, columns=["path", "ts", "score", "label"])

    return points.select("path", "ts", "score", "label").groupBy("path").applyInPandasWithState(step, "path string, ts long, score double, label string", "score double, label string", "append", GroupStateTimeout.NoTimeout)


#: The numbers of the small snapshots below.
_SMALL = (("files", True, False), ("edges", True, False), ("dead", True, False), ("bus", False, True))


def collapse_snapshots(rows: DataFrame, seconds: int = trends.SECONDS) -> DataFrame:
    """Of trend rows (repo, ts, files, edges, dead, bus nullable) those that stand after each that says nothing new overwrote the one before."""
    return trends.collapse(rows.select("repo", "ts", "files", "edges", "dead", "bus"), "repo", _SMALL, seconds=seconds)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastSnapshot(StatefulProcessor):
    """Holds a key's last row until the next one doesn't overwrite it, or none can any more; then the state goes."""

    def __init__(self, columns: list[str], numbers: tuple, seconds: int, schema: str):
        self.columns, self.numbers, self.seconds, self.schema = columns, numbers, seconds, schema

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _due(self, row: dict) -> int:
        return (row["ts"] + self.seconds) * 1000

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        held = dict(zip(self.columns, self.last.get(), strict=True)) if self.last.exists() else None
        before = held
        for row in sorted(({c: r[c] for c in self.columns} for r in rows), key=lambda r: r["ts"]):
            if held is not None and not trends.says_nothing_new(held, row, self.numbers, seconds=self.seconds):
                yield Row(**dict(zip(self.key_names, key, strict=True)), **held)
            held = row
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.handle.registerTimer(self._due(held))
        self.last.update(tuple(held[c] for c in self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        if self.last.exists():
            yield Row(**dict(zip(self.key_names, key, strict=True)), **dict(zip(self.columns, self.last.get(), strict=True)))
            self.last.clear()

    def close(self) -> None:
        pass

    key_names = ("repo",)


def collapse_stream(rows: DataFrame, numbers: tuple = trends.SNAPSHOT, seconds: int = trends.SECONDS, late: str = "1 minute") -> DataFrame:
    """trends.collapse() on a stream of rows (repo, ts in seconds, numbers): a row comes out once the next one of its key doesn't overwrite
    it, or once the watermark says that none can. Keys that fall silent hold no state. Needs the RocksDB state store (ROCKS) in
    spark.sql.streaming.stateStore.providerClass. Of rows that come later than the watermark allows nothing is kept."""
    columns = ["ts", *(n for n, *_ in numbers)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    state = ", ".join(f"{c} {kinds[c]}" for c in columns)
    timed = rows.select("repo", *columns, F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    made = _LastSnapshot(columns, numbers, seconds, state)
    return timed.groupBy("repo").transformWithState(made, f"repo {kinds['repo']}, {state}", "append", "eventTime")


def breaches_by_day(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Breaches in tumbling UTC days; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(count().alias("breaches")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "breaches")


def sliding(events: DataFrame, width: str = "14 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "tool").agg(count().alias("calls"))


def session_windows(events: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls by user and session; events exactly a gap apart are of one session."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(count().alias("calls"))
