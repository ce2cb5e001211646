import json
import subprocess

import pytest
from pyspark.sql import functions as F

from repolith.operators import extract
from repolith.sources import exports, files, git, logs, store
from repolith.streaming import jobs


def table(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in contents.items()], "path string, content string")


def test_imports_by_language(spark):
    f = spark.createDataFrame([
        ("a.ts", "import x from './b';\nexport * from \"./c\";\nconst y = require('fs');\nimport './side';"), ("b.py", "from .m import N as M\nimport os.path\n"), ("c.go", 'package x\nimport (\n\t"fmt"\n\tz "mod/pkg"\n)\n'),
        ("d.rs", "mod util;\nuse crate::a::b;\n"), ("e.java", "import static a.b.C;\n"), ("f.rb", "require_relative 'x/y'\n"), ("g.c", "#include \"h.h\"\n"), ("h.swift", "import Foundation\n"), ("i.txt", "import x"), ("j.py", None),
    ], "path string, content string")
    got = {}
    for r in extract.raw_imports(f).collect():
        got.setdefault(r.path, set()).add(r.specifier)
    assert got == {"a.ts": {"./b", "./c", "fs", "./side"}, "b.py": {".m", "os.path"}, "c.go": {"fmt", "mod/pkg"}, "d.rs": {"util", "crate::a::b"}, "e.java": {"a.b.C"}, "f.rb": {"x/y"}, "g.c": {"h.h"}}


def test_resolution_takes_the_first_candidate(spark):
    names = ["src/a.ts", "src/b.ts", "src/b/index.ts", "src/c/index.tsx", "pkg/m.py", "pkg/sub/n.py", "pkg/sub/__init__.py", "lib/x.rb", "lib/y.rb"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    imports = spark.createDataFrame([("src/a.ts", "ts", "./b", True), ("src/a.ts", "ts", "./c", True), ("src/a.ts", "ts", "./b.js", True), ("src/a.ts", "ts", "../../out", True), ("pkg/sub/n.py", "py", "..m", True), ("pkg/m.py", "py", ".sub", True), ("pkg/m.py", "py", "pkg.sub.n", False), ("lib/x.rb", "rb", "y", True)], "path string, family string, specifier string, is_relative boolean")
    got = {(r.src, r.specifier): r.dst for r in extract.resolve_imports(imports, paths).collect()}
    assert got == {("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "./c"): "src/c/index.tsx", ("src/a.ts", "./b.js"): "src/b.ts", ("pkg/sub/n.py", "..m"): "pkg/m.py", ("pkg/m.py", ".sub"): "pkg/sub/__init__.py", ("pkg/m.py", "pkg.sub.n"): "pkg/sub/n.py", ("lib/x.rb", "y"): "lib/y.rb"}


def test_go_tests_and_packages(spark):
    paths = spark.createDataFrame([("p/x.go",), ("p/x_test.go",), ("p/y.go",), ("p/z_test.go",), ("q/main.go",)], "path string")
    got = {(r.src, r.dst) for r in extract.go_test_links(paths).collect()}
    assert got == {("p/x_test.go", "p/x.go"), ("p/x.go", "p/x_test.go"), ("p/z_test.go", "p/x.go"), ("p/z_test.go", "p/y.go"), ("p/x.go", "p/z_test.go"), ("p/y.go", "p/z_test.go")}
    imp = spark.createDataFrame([("q/main.go", "go", "ex.org/m/p", False), ("q/main.go", "go", "fmt", False)], "path string, family string, specifier string, is_relative boolean")
    assert {(r.src, r.dst) for r in extract.go_edges(imp, paths, "ex.org/m").collect()} == {("q/main.go", "p/x.go"), ("q/main.go", "p/y.go")}


SOURCE = "import os\nfrom a import b as c\n\ndef top(x):\n    secret = os.getcwd()\n    return helper(x).go()\n\nclass K:\n    def m(self):\n        secret = 1\n        return top(2)\n"


def test_python_nodes_calls_and_skeleton(spark):
    f = spark.createDataFrame([("k.py", SOURCE), ("bad.py", "def ("), ("t.ts", "export class T {\n}\nfunction f(a: number) {\n  return g(a);\n}\nconst h = (x) => k.j(x);\n")], "path string, content string")
    nodes = extract.definitions(f).cache()
    got = sorted((r.path, r.type, r.name) for r in nodes.collect())
    assert got == [("k.py", "class", "K"), ("k.py", "function", "top"), ("k.py", "import", "a"), ("k.py", "import", "os"), ("t.ts", "arrow_function", "h"), ("t.ts", "class", "T"), ("t.ts", "function", "f")]
    calls = {(r.path, r.caller_symbol, r.callee_symbol) for r in extract.calls(f).collect()}
    assert calls == {("k.py", "top", "getcwd"), ("k.py", "top", "helper"), ("k.py", "top", "go"), ("k.py", "m", "top"), ("t.ts", "f", "g"), ("t.ts", "h", "j")}
    skeleton = {r.path: r.skeleton for r in extract.skeletons(f, nodes).collect()}
    assert "secret" not in skeleton["k.py"] and "def top(x);" in skeleton["k.py"] and "def m(self)" in skeleton["k.py"]
    assert {r.name for r in extract.symbols(nodes, True).where("path = 'k.py'").collect()} == {"K", "top", "m"}


def test_reexports_one_hop(spark):
    imports = spark.createDataFrame([("use.py", "pkg/__init__.py", "N"), ("pkg/n.py", "pkg/__init__.py", "N")], "src string, barrel string, symbol string")
    re = spark.createDataFrame([("pkg/__init__.py", "N", "pkg/n.py")], "barrel string, symbol string, source string")
    assert [tuple(r) for r in extract.reexport_edges(imports, re).collect()] == [("use.py", "pkg/n.py")]


def test_embeddings_have_unit_length(spark):
    f = spark.createDataFrame([("a", "x y z"), ("b", "")], "path string, content string")
    got = extract.hashed_embeddings(f, 16).collect()
    assert [r.path for r in got] == ["a"] and abs(sum(x * x for x in got[0].vector) - 1) < 1e-5


def test_notebooks(spark):
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "c = 3"}]})
    assert extract.notebook_code(spark.createDataFrame([("n.ipynb", nb)], "path string, content string")).first().content == "a = 1\nb = 2\nc = 3"


def test_scan_skips_ignored_directories(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1", "node_modules/b.js": "x", "src/p.egg-info/c.py": "x", "src/blank.py": "  ", "src/d.bin": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan(spark, str(tmp_path)).collect()
    assert [(r.path, r.ext, r.content) for r in got] == [("src/a.py", "py", "x = 1")]


def test_git_source(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=N", "-c", "user.email=n@x.org", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (repo / "a.txt").write_text("1\n2\n")
    run("add", "."), run("commit", "-qm", "first")
    (repo / "a.txt").write_text("1\n3\n")
    (repo / "node_modules").mkdir()
    (repo / "node_modules/x").write_text("x\n")
    run("add", "-f", "."), run("commit", "-qm", "fix: second")
    git.dump(str(repo), str(tmp_path / "log"), None)
    got = git.read(spark, str(tmp_path / "log")).orderBy("message").collect()
    assert [(r.message, r.author, r.is_merge, r.is_bulk, [tuple(f) for f in r.files]) for r in got] == [("first", "N", False, False, [("a.txt", 2, 0)]), ("fix: second", "N", False, False, [("a.txt", 1, 1)])]


def test_logs_leave_out_malformed_lines(spark, tmp_path):
    day = 86400
    rows = [{"unixSeconds": 10 * day, "totalFiles": 1, "totalEdges": 2, "deadFiles": 0}, {"unixSeconds": 40 * day, "totalFiles": 3, "totalEdges": 2, "deadFiles": 0}, {"unixSeconds": 41 * day}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    assert [r.totalFiles for r in logs.trends(spark, str(tmp_path / "t.jsonl"), 41 * day).collect()] == [3]


def test_store_versions(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert store.load(spark, root, "edges") is None
    for n in (1, 2):
        store.save({"edges": spark.range(n)}, root)
    assert store.load(spark, root, "edges").count() == 2 and store.compact(spark, root) == 1 and len(store.versions(spark, root)) == 1
    assert store.compare_versions("1.2.3", "1.10.0") == "older" and store.compare_versions(None, "1.0.0") == "unknown"
    repos = store.register_repo([], "/r/a", "one", 1)
    assert store.find_repo(repos, "one")["root"] == "/r/a"


def test_exports(spark):
    e = spark.createDataFrame([("a<b", "c")], "src string, dst string")
    n = spark.createDataFrame([("a<b",), ("c",)], "path string")
    assert any('source="a&lt;b"' in r.value for r in exports.graphml(n, e).collect())
    assert [r.value for r in exports.dot(e).orderBy("ord").collect()] == ["digraph imports {", '  "a<b" -> "c";', "}"]
    once = exports.spliced_codeowners("/x @me\n", [("/src/", "@a")])
    assert exports.spliced_codeowners(once, [("/src/", "@a")]) == once and once.startswith("/x @me\n")
    g = spark.createDataFrame([("a", "a", "lib")], "path string, community string, name string")
    pages = exports.wiki_pages(g, e)
    assert exports.changed_pages(pages, pages).count() == 0


def test_stream_of_changes_keeps_the_table(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/table"
    src.mkdir()
    put = lambda name, *rows: (src / name).write_text("\n".join(json.dumps(dict(zip(("path", "kind", "ts", "content"), r, strict=True))) for r in rows))
    put("1.json", ("a", "add", "2024-01-01T00:00:00Z", "1"), ("a", "change", "2024-01-01T00:00:01Z", "2"), ("b", "add", "2024-01-01T00:00:00Z", "x"))
    start = lambda: jobs.maintain_files(jobs.changes(spark, str(src)), root, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    start()
    put("2.json", ("b", "unlink", "2024-01-01T00:01:00Z", None), ("c", "add", "2024-01-01T00:01:00Z", "y"))
    start()
    assert sorted((r.path, r.content) for r in store.load(spark, root, "files").collect()) == [("a", "2"), ("c", "y")]


def test_collapse(spark):
    rows = spark.createDataFrame([("r", 0, 5, 5, 0, 1.0), ("r", 100, 5, 5, 0, 1.005), ("r", 200, 6, 5, 0, 1.0), ("r", 900, 6, 5, 0, 1.0)], "repo string, ts long, files long, edges long, dead long, bus double")
    assert sorted(r.ts for r in jobs.collapse_snapshots(rows).collect()) == [100, 200, 900]


def test_daily_window(spark):
    e = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 23:59:59",), ("2024-01-02 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert sorted(tuple(r) for r in jobs.breaches_by_day(e).collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_configuration_readers():
    text = """{ // paths
      "compilerOptions": { "baseUrl": "./src", "paths": { "~/*": ["lib/*", "./more/*"], /* one */ "exact": ["x.ts"], } }, }"""
    assert extract.tsconfig_aliases(text, "app") == [("~/", "app/src/lib/"), ("~/", "app/src/more/"), ("exact", "app/src/x.ts"), ("@/", "app/")]
    assert extract.tsconfig_aliases('{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}') == [("@/", "src/")]
    assert extract.go_module("// x\nmodule example.org/a/b // c\n\ngo 1.21") == "example.org/a/b" and extract.go_module("") is None
    assert store.author_map("authors:\n  A@b.c: handle") == {"a@b.c": "handle"}
    with pytest.raises(ValueError):
        store.author_map("authors: [1]")


def test_call_sites_of_a_symbol(spark):
    found = spark.createDataFrame([("a", "f", "g", 3), ("b", "", "g", 4), ("a", "f", "h", 5)], "path string, caller_symbol string, callee_symbol string, line long")
    assert [tuple(r) for r in extract.call_sites_of(found, "g", "a").collect()] == [("a", "f", 3)] and extract.call_sites_of(found, "g").count() == 2


def test_snapshots_are_checked(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    assert store.stale(spark, root, "1.0.0", 1) and store.load(spark, root, "t") is None
    store.save({"t": spark.range(1)}, root, {"writer": "1.2.0", "n_files": "1"})
    assert [store.stale(spark, root, w, n) for w, n in (("1.2.0", 1), ("1.1.0", 1), ("1.3.0", 1), (None, 1), ("1.2.0", 2))] == [False, False, True, True, True]
    monkeypatch.setattr(store, "FORMAT_VERSION", 2)
    assert store.load(spark, root, "t") is None and store.stale(spark, root, "1.2.0", 1)


def test_overlay_snapshot_and_registry(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    assert store.load_overlay(spark, root) is None
    store.save_overlay(spark.range(1), spark.range(2), spark.range(3), root, "abc")
    tables, last = store.load_overlay(spark, root)
    assert last == "abc" and [tables[n].count() for n in ("commits", "pairs", "owners")] == [1, 2, 3]
    repos = store.register_repo(store.register_repo([], "/a/x", "one", 5), "/a/y", None, 6)
    store.save_registry(spark, repos, f"file://{tmp_path}/r")
    back = store.load_registry(spark, f"file://{tmp_path}/r")
    assert back == repos and [r["root"] for r in store.unregister_repo(back, "one")] == ["/a/y"] and store.unregister_repo(back, "nobody") == repos


def test_vectors_by_path(spark):
    from repolith.operators import search

    t = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "path string, vector array<float>")
    assert search.vector_of(t, "b").first().vector == [2.0] and search.vector_of(t, "c").count() == 0
    left = search.remove_vectors(t, spark.createDataFrame([("a",), ("z",)], "path string"))
    assert search.count_vectors(left).first().n == 1


def test_streams_keep_index_and_overlay(spark, tmp_path):
    import json

    inbox = tmp_path / "in"
    inbox.mkdir()
    root = f"file://{tmp_path}/index"
    rows = [{"path": "a.ts", "kind": "add", "ts": "2024-01-01T00:00:00Z", "content": "import './b'"}, {"path": "b.ts", "kind": "add", "ts": "2024-01-01T00:00:00Z", "content": "x"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, rows)))
    run = lambda: jobs.maintain_index(jobs.changes(spark, f"file://{inbox}"), root, f"file://{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    run()
    assert store.load(spark, root, "files").count() == 2 and [r.specifier for r in store.load(spark, root, "imports").collect()] == ["./b"]
    (inbox / "2.json").write_text(json.dumps({"path": "a.ts", "kind": "unlink", "ts": "2024-01-02T00:00:00Z", "content": None}))
    run()
    assert [r.path for r in store.load(spark, root, "vectors").collect()] == ["b.ts"] and store.load(spark, root, "imports").count() == 0

    history, at = tmp_path / "commits", f"file://{tmp_path}/overlay"
    history.mkdir()
    schema = "sha string, author string, ts long, message string, is_merge boolean, files array<struct<path:string,added:long,deleted:long>>"
    for n, shas in ((1, "xy"), (2, "yz")):  # y comes twice
        (history / f"{n}.json").write_text("\n".join(json.dumps({"sha": s, "author": "u", "ts": ord(s), "message": "fix", "is_merge": False, "files": [{"path": p, "added": 1, "deleted": 0} for p in "ab"]}) for s in shas))
        jobs.maintain_overlay(spark.readStream.schema(schema).json(f"file://{history}"), at, f"file://{tmp_path}/c2", "fix").trigger(availableNow=True).start().awaitTermination()
    assert {(r.path, r.commits, r.churn_lines, r.bug_commits, r.last_touch) for r in store.load(spark, at, "churn").collect()} == {("a", 3, 3, 3, ord("z")), ("b", 3, 3, 3, ord("z"))}
    assert [(r.shared, r.last_ts) for r in store.load(spark, at, "pairs").collect()] == [(3, ord("z"))]


def test_task_budget_stream(spark, tmp_path):
    inbox = tmp_path / "ev"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(f'{{"user_id": 1, "event_id": {k}, "ts": "2024-01-01T00:00:{k:02d}Z"}}' for k in range(12)))
    events = spark.readStream.schema("user_id long, event_id long, ts timestamp").json(f"file://{inbox}")
    q = jobs.task_budget(events).writeStream.format("memory").queryName("over_budget").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.user_id, r.event_id, r.calls) for r in spark.table("over_budget").collect()] == [(1, 8, 9)]


def test_shared_dir_needs_a_setting_on_a_cluster():
    from types import SimpleNamespace

    from repolith.operators.lineage import shared_dir

    session = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: at), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://h:7077", "s3://b/x/")) == "s3://b/x" and shared_dir(session("local[4]")).startswith("file:")
    with pytest.raises(ValueError):
        shared_dir(session("spark://h:7077"))



def test_streams_keep_the_order_of_groups_in_several_frames(spark, tmp_path):
    from datetime import datetime, timedelta

    order = [(k * 7) % 40 for k in range(40)]
    when = [datetime(2026, 1, 1) + timedelta(seconds=60 * k + 500 * (k // 10)) for k in range(40)]
    spark.createDataFrame([(1, k, when[k]) for k in order], "user_id long, event_id long, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/events")
    spark.createDataFrame([("f", k, (k // 10) / 10, "low") for k in order], "path string, ts long, score double, label string").coalesce(1).write.parquet(f"file://{tmp_path}/points")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for name, schema, made in (("events", "user_id long, event_id long, ts timestamp", jobs.task_budget), ("points", "path string, ts long, score double, label string", jobs.sparse_points)):
            out = made(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}"))
            out.writeStream.format("memory").queryName(f"framed_{name}").option("checkpointLocation", f"file://{tmp_path}/{name}_c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(r.event_id for r in spark.table("framed_events").collect()) == [8, 18, 28, 38]
    assert sorted(r.ts for r in spark.table("framed_points").collect()) == [0, 10, 20, 30]


def test_go_edges_are_distinct_without_a_shuffle_of_pairs(spark):
    from repolith.operators.lineage import joined_in_blocks

    paths = spark.createDataFrame([(f"d{k % 2}/{k}{'_test' if k % 3 == 0 else ''}.go",) for k in range(60)] * 2, "path string")
    imports = spark.createDataFrame([(f"c{k}.go", "go", f"m/d{k % 2}") for k in range(40)] + [("c0.go", "go", "m//d0")] * 2, "path string, family string, specifier string")
    code = [f"d{k % 2}/{k}.go" for k in range(60) if k % 3]
    edges, links = extract.go_edges(imports, paths, "m"), extract.go_test_links(paths)
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted((f"c{k}.go", c) for k in range(40) for c in code if c.startswith(f"d{k % 2}/"))
    both = [(f"d{k % 2}/{k}_test.go", c) for k in range(0, 60, 3) for c in code if c.startswith(f"d{k % 2}/")]
    assert sorted((r.src, r.dst) for r in links.collect()) == sorted(both + [(b, a) for a, b in both])
    for made in (edges, links):
        assert not made._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    a, b = (spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias(n)) for n in "xy")
    assert joined_in_blocks(a, b, "k", 3).distinct().count() == joined_in_blocks(a, b, "k", 3).count() == 1250


def test_links_are_not_sent_through_the_driver(spark, monkeypatch):
    real, plans = files.cut, []

    def cut(df, name, after=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, after)

    monkeypatch.setattr(files, "cut", cut)
    links = spark.createDataFrame([("a/l", "m"), ("a/m", "/real"), ("r", "r"), ("o", "../x")], "path string, target string")
    given = spark.createDataFrame([("a/l/f",), ("r/f",), ("o/f",), ("p",)], "path string")
    got = sorted(map(tuple, files.resolved_links(given, links).collect()), key=str)
    assert got == [("a/l/f", "real/f", "ok"), ("o/f", None, "outside"), ("p", "p", "ok"), ("r/f", None, "loop")]
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_aliases_with_dots_at_the_end(spark):
    aliases = spark.createDataFrame([("@/", "src/x/"), ("~", "src/a/..")], "prefix string, base string")
    imports = spark.createDataFrame([("i.ts", "@/../b"), ("i.ts", "~"), ("i.ts", "@/.."), ("i.ts", "@/../../../no")], "path string, specifier string")
    there = spark.createDataFrame([("src/b.ts",), ("src/index.ts",), ("no.ts",)], "path string")
    got = sorted((r.specifier, r.dst) for r in extract.resolve_aliases(imports, aliases, there).collect())
    assert got == [("@/..", "src/index.ts"), ("@/../b", "src/b.ts"), ("~", "src/index.ts")]


def test_blocks_of_wide_keys_are_not_copied(spark):
    """Each row is shuffled once, however many blocks the other side has; narrow keys, null keys and repeated rows are as in a plain join."""
    from repolith.operators.lineage import joined_in_blocks

    a = spark.createDataFrame([("w", k, "x") for k in range(40)] + [("n", 1, "y"), ("n", 1, "y"), (None, 2, "z"), ("only", 3, "z")], "k string, a int, b string")
    b = spark.createDataFrame([("w", float(k)) for k in range(25)] + [("n", 0.5), ("n", None), (None, 1.0)], "k string, c double")
    made = joined_in_blocks(a, b, "k", 4)
    assert sorted(map(str, made.collect())) == sorted(map(str, a.join(b, "k").collect())) and made.count() == 40 * 25 + 4
    paths = spark.createDataFrame([(f"d/{k}{'_test' if k % 3 == 0 else ''}.go",) for k in range(60)], "path string")
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (made, extract.go_test_links(paths))):
        assert "CartesianProduct" in plan and "sequence(" not in plan


def test_package_edges_copy_no_file(spark):
    """A package of 1,100 files with as many importers: blocks are read where they meet, no row is made once for each block of the other side."""
    paths = spark.range(1100).select(F.concat(F.lit("d/"), "id", F.lit(".go")).alias("path"))
    imports = spark.range(1100).select(F.concat(F.lit("c/"), "id", F.lit(".go")).alias("path"), F.lit("go").alias("family"), F.lit("m/d").alias("specifier"))
    made = extract.go_edges(imports, paths, "m")
    assert made.count() == 1100 * 1100 and made.agg(F.countDistinct("src"), F.countDistinct("dst")).first() == (1100, 1100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(" not in plan
