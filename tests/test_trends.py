"""Collapse of trend rows: by the next row, on a stream, and as a fold over the last row."""

import json
import random

import pytest
from pyspark.sql import functions as F

from repolith.operators import telemetry, trends
from repolith.operators.lineage import with_next
from repolith.streaming import jobs

NUMBERS = (("files", True, False), ("bus", False, True), ("churn", False, True))
SCHEMA = "repo string, ts long, files long, bus double, churn double"


def made(seed, repos=4, count=60):
    rng, rows = random.Random(seed), []
    for r in range(repos):
        ts = 1000
        for _ in range(count):
            ts += rng.choice([1, 60, 299, 300, 301, 900])
            rows.append((f"r{r}", ts, rng.choice([5, 5, 5, 6]), rng.choice([None, 1.0, 1.005, 1.02, 0.0]), rng.choice([0.0, 0.0, 100.0, 100.9, 101.1])))
    return rows


def folded(rows, seconds=300):
    """What is left when each row that says nothing new overwrites the last line."""
    out = []
    for repo in sorted({r[0] for r in rows}):
        lines = []
        for r in sorted(x for x in rows if x[0] == repo):
            row = dict(zip(("repo", "ts", "files", "bus", "churn"), r))
            if lines and trends.says_nothing_new(lines[-1], row, NUMBERS, seconds=seconds):
                lines[-1] = row
            else:
                lines.append(row)
        out += [tuple(x.values()) for x in lines]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("repo", "ts", "files", "bus", "churn").collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_collapse_is_the_fold(spark, partitions):
    rows = made(1)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(trends.collapse(spark.createDataFrame(rows, SCHEMA), "repo", NUMBERS)) == folded(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("last,row,same", [
    ((0, 5, 1.0, 0.0), (299, 5, 1.005, 0.0), True), ((0, 5, 1.0, 0.0), (300, 5, 1.0, 0.0), False), ((0, 5, 1.0, 0.0), (1, 6, 1.0, 0.0), False), ((0, 5, None, 0.0), (1, 5, 1.0, 0.0), False),
    ((0, 5, None, 0.0), (1, 5, None, 0.0), True), ((0, 5, 1.0, 0.0), (1, 5, 1.0, 0.001), False), ((0, 5, 1.0, 100.0), (1, 5, 1.0, 101.0), True), ((0, 5, 1.0, 100.0), (1, 5, 1.0, 101.1), False),
])
def test_nothing_new(spark, last, row, same):
    names = ("ts", "files", "bus", "churn")
    assert trends.says_nothing_new(dict(zip(names, last)), dict(zip(names, row)), NUMBERS) is same
    df = spark.createDataFrame([(last, row)], "a struct<ts:long,files:long,bus:double,churn:double>, b struct<ts:long,files:long,bus:double,churn:double>")
    assert df.select(trends.nothing_new(F.col("a"), F.col("b"), NUMBERS).alias("x")).first().x is same


def test_next_rows_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "hot", "hot", "hot", None]), k, rng.random()) for k in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.k: r.n and r.n.k for r in with_next(spark.createDataFrame(rows, "key string, k long, v double"), ["key"], [F.col("k")], ["k"], "n").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in ("a", "hot", None):
        mine = [k for x, k, _ in rows if x == key]
        assert [got[k] for k in mine] == [*mine[1:], None]


def test_change_filter_carries_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rng = random.Random(5)
    rows = [(k % 5, k, round(rng.random(), 2), rng.choice("xy")) for k in range(200)]
    got = sorted(tuple(r) for r in telemetry.change_filter(spark.createDataFrame(rows, "path long, ts long, score double, label string"), 0.3).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for p in range(5):
        last = None
        for r in rows:
            if r[0] == p and (last is None or last[3] != r[3] or abs(last[2] - r[2]) >= 0.3):
                want.append(r)
                last = r
    assert got == sorted(want)


def test_the_stream_settles_rows_and_drops_silent_keys(spark, tmp_path):
    """Rows in any number of files give what the table gives; a replay from the checkpoint gives nothing twice; silent keys hold no state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    rows = sorted(made(2, 3, 20), key=lambda r: r[1])
    put = lambda name, some: (inbox / name).write_text("\n".join(json.dumps(dict(zip(("repo", "ts", "files", "bus", "churn"), r))) for r in some))

    def run():
        stream = jobs.collapse_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{inbox}"), NUMBERS, late="0 seconds")
        q = stream.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    try:
        put("1.json", rows[:25])
        run()
        put("2.json", rows[25:45])
        put("3.json", rows[45:])
        run()
        end = max(r[1] for r in rows) + 5000
        put("4.json", [("end", end, 1, None, 0.0)])
        put("5.json", [("end", end + 1000, 2, None, 0.0)])
        progress = run()
        run()  # nothing new
        got = rows_of(spark.read.schema(SCHEMA).json(str(out)).where("repo != 'end'"))
        assert got == folded(rows)
        assert progress.stateOperators[0].numRowsTotal <= 3  # the last key's row and timer alone
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
