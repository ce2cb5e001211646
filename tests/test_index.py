"""The index of source files: after any changes it is what a rebuild gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from repolith.sources import index as ix
from repolith.sources import store
from repolith.sources.index import CodeIndex
from repolith.streaming import jobs

CHANGE = "path string, kind string, content string"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


def assert_rebuilt(spark, index, files):
    want = ix.rebuilt(spark.createDataFrame(sorted(files.items()), "path string, content string"))
    for name in ("files", "imports", "symbols", "calls", "edges", "places"):
        assert rows_of(index.read(name)) == rows_of(want[name]), name


def text(rng, names):
    return "\n".join([f"import './{rng.choice(names)}';" for _ in range(rng.randrange(3))] + [f"function f{rng.randrange(5)}() {{ g{rng.randrange(5)}(); }}"])


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_end_as_a_rebuild(spark, tmp_path, seed):
    """Files that others import come, go and change; './a' may mean a.ts, a.js or a/index.ts."""
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    paths = [f"{n}{e}" for n in names for e in (".ts", ".js", "/index.ts")]
    index, files = CodeIndex(spark, f"file://{tmp_path}/i", buckets=3), {}
    for step in range(4):
        change = {p: (("unlink", None) if p in files and rng.random() < 0.5 else ("change", text(rng, names))) for p in rng.sample(paths, 4)}
        index.apply(spark.createDataFrame([(p, k, c) for p, (k, c) in change.items()], CHANGE))
        for p, (kind, content) in change.items():
            if kind == "unlink":
                files.pop(p, None)
            else:
                files[p] = content
        if step == 1:
            index.compact()
    assert_rebuilt(spark, index, files)
    assert index.state()[0] == 2 and index.state()[1] == [3, 4]


def test_a_change_writes_what_it_brings(spark, tmp_path):
    root = tmp_path / "i"
    index = CodeIndex(spark, f"file://{root}", buckets=2)
    index.apply(spark.createDataFrame([(f"d/f{k}.ts", "add", f"import './f{k + 1}';\nfunction f{k}() {{ g(); }}" + " " * 3000) for k in range(60)], CHANGE))
    index.compact()
    before = {p: p.stat().st_mtime_ns for p in root.glob("base-1/**/*.parquet")}
    index.apply(spark.createDataFrame([("d/f7.ts", "unlink", None)], CHANGE))
    assert {p: p.stat().st_mtime_ns for p in root.glob("base-1/**/*.parquet")} == before
    count = lambda t: spark.read.parquet(f"file://{root}/delta-2/{t}").count()
    assert [count(t) for t in ("files", "symbols", "calls", "edges")] == [0, 0, 0, 0]
    assert {(r.path, r.part) for r in spark.read.parquet(f"file://{root}/delta-2/keys").collect()} == {("d/f7.ts", "own"), ("d/f7.ts", "edges"), ("d/f6.ts", "edges")}
    assert index.read("edges").count() == 57 and index.read("files", near=spark.createDataFrame([("d/f8.ts",), ("d/f7.ts",)], "path string")).count() == 1


def test_a_change_counts_once(spark, tmp_path):
    index = CodeIndex(spark, f"file://{tmp_path}/i", buckets=2)
    assert index.read("files").count() == 0 and not ix.present(spark, index.root) and store.load(spark, index.root, "files") is None
    one = spark.createDataFrame([("a.ts", "add", "f()")], CHANGE)
    index.apply(one, 5)
    index.apply(spark.createDataFrame([("a.ts", "add", "other()")], CHANGE), 5)  # a replay
    assert [r.callee_symbol for r in store.load(spark, index.root, "calls").collect()] == ["f"]
    # A change that was cut off before its end doesn't count and is written anew.
    spark.createDataFrame([("b.ts", "x")], "path string, content string").write.parquet(f"file://{tmp_path}/i/delta-6/files")
    assert index.last() == 5 and index.read("files").count() == 1
    index.apply(spark.createDataFrame([("c.ts", "add", "h()")], CHANGE), 6)
    assert sorted(r.path for r in index.read("files").collect()) == ["a.ts", "c.ts"]
    index.most_deltas = 3
    index.apply(spark.createDataFrame([], CHANGE), 7)
    assert index.state() == (7, []) and index.read("files").count() == 2


def test_a_stream_keeps_symbols_calls_and_edges(spark, tmp_path):
    inbox, root = tmp_path / "in", f"file://{tmp_path}/index"
    inbox.mkdir()
    put = lambda name, *rows: (inbox / name).write_text("\n".join(json.dumps({"path": p, "kind": k, "ts": f"2024-01-01T00:00:{s:02d}Z", "content": c}) for p, k, s, c in rows))
    run = lambda: jobs.maintain_index(jobs.changes(spark, f"file://{inbox}"), root, f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    put("1.json", ("a.ts", "add", 1, "import './b'\nfunction f() { g() }"), ("a.ts", "change", 2, "import './b'\nfunction f2() { g2() }"), ("b/index.ts", "add", 1, "export class K {}"))
    run()
    put("2.json", ("b.ts", "add", 3, "const x = 1"))
    run()
    index = CodeIndex(spark, root)
    assert_rebuilt(spark, index, {"a.ts": "import './b'\nfunction f2() { g2() }", "b/index.ts": "export class K {}", "b.ts": "const x = 1"})
    assert [(r.path, r.dst) for r in index.read("edges").collect()] == [("a.ts", "b.ts")]
    assert store.load(spark, root, "symbols").where(F.col("name") == "f2").count() == 1
