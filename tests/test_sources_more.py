"""The git data source, links, embeddings by a model, pictures, confidence, and orders of words."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.functions import predicates
from repolith.functions.text import locale_order
from repolith.operators import evals, extract, graph, search, telemetry
from repolith.sources import exports, files, git


def commit(repo, name, text, day, message="m"):
    (repo / name).write_text(text)
    env = {"GIT_AUTHOR_NAME": "A b", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@d", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(repo)}
    at = f"{1_700_000_000 + day * 86400} +0000"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})
    if not (repo / ".git").exists():
        run("init", "-q")
    run("add", ".")
    run("commit", "-qm", message)
    return subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()


@pytest.fixture
def repos(tmp_path):
    made = []
    for r in ("one", "two"):
        (tmp_path / r).mkdir()
        made.append((str(tmp_path / r), [commit(tmp_path / r, f"f{k}.txt", "x\n" * (k + 1), k * 20, f"fix {k} é") for k in range(5)]))
    (tmp_path / "none").mkdir()
    subprocess.run(["git", "-C", str(tmp_path / "none"), "init", "-q"], check=True)
    return made, str(tmp_path / "none")


def test_ranges_of_dates_give_the_whole_log(spark, repos, tmp_path):
    (one, shas), (two, others) = repos[0]
    now = 1_700_000_000 + 90 * 86400
    c = git.log(spark, [one, two, repos[1]], now=str(now), since_days="", range_days="7").cache()
    assert sorted(r.sha for r in c.collect()) == sorted(shas + others) and c.rdd.getNumPartitions() > 10
    assert {r.repo for r in c.collect()} == {one, two}
    last = c.where(F.col("sha") == shas[4]).first()
    assert (last.author, last.email, last.message, last.is_merge, [tuple(f) for f in last.files]) == ("A b", "a@b", "fix 4 é", False, [("f4.txt", 5, 0)])
    git.dump(one, str(tmp_path / "dump"), None)
    assert {r.sha for r in git.read(spark, str(tmp_path / "dump")).collect()} == set(shas)
    assert [r.sha for r in git.log(spark, [one], now=str(now), since_days="15").collect()] == [shas[4]]


def test_only_what_came_after_a_commit(spark, repos):
    (one, shas), _ = repos[0]
    assert {r.sha for r in git.log(spark, [one], since={one: shas[2]}, range_days="10").collect()} == set(shas[3:])
    assert git.log(spark, [one], since={one: shas[4]}).count() == 0
    for bad in ("0" * 40, "abc", "g" * 40):
        with pytest.raises(Exception, match="no commit|40 hex"):
            git.log(spark, [one], since={one: bad}).count()
    with pytest.raises(Exception):
        git.log(spark, ["/nowhere"]).count()


def test_a_stream_of_commits(spark, repos, tmp_path):
    (one, shas), (two, others) = repos[0]

    def run():
        q = git.log_stream(spark, [one, two], since={two: others[3]}).select("repo", "sha").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.sha for r in spark.read.schema("repo string, sha string").json(str(tmp_path / "out")).collect())

    assert run() == sorted(shas + others[4:])
    from pathlib import Path

    more = [commit(Path(two), "new.txt", "y", 200), commit(Path(two), "newer.txt", "y", 201)]
    assert run() == sorted(shas + others[4:] + more) == run()


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d/x", "../c/y"), ("c/y", "/z"), ("r1", "r2"), ("r2", "r1"), ("up", "../../out"), ("self", "self/x")] + [(f"l{k}", f"l{k + 1}") for k in range(50)], "path string, target string")
    paths = spark.createDataFrame([("a/f",), ("d/x/g",), ("r1",), ("up/f",), ("plain",), ("./a/../a",), ("self",), ("l20",), ("l0",), ("../a",)], "path string")
    got = {r.path: (r.real, r.state) for r in files.resolved_links(paths, links).collect()}
    assert got == {"a/f": ("c/f", "ok"), "d/x/g": ("z/g", "ok"), "r1": (None, "loop"), "up/f": (None, "outside"), "plain": ("plain", "ok"), "./a/../a": ("c", "ok"), "self": (None, "loop"), "l20": ("l50", "ok"), "l0": (None, "loop"), "../a": (None, "outside")}
    assert [tuple(r) for r in files.resolved_links(paths.where("path = 'plain'"), links.limit(0)).collect()] == [("plain", "plain", "ok")]


def fussy():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in texts])

    return encode


def test_a_model_gets_failed_texts_by_halves(spark):
    rows = [(f"p{k}", "bad" if k in (3, 7) else "x" * k) for k in range(12)]
    got = {r.path: r.vector for r in extract.embeddings(spark.createDataFrame(rows, "path string, content string"), fussy, at_once=5).collect()}
    assert [p for p, v in got.items() if v is None] == ["p3", "p7"] and len(got) == 12
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values() if v is not None)
    assert got["p4"] == pytest.approx([4 / 17**0.5, 1 / 17**0.5])
    long = extract.embeddings(spark.createDataFrame([("a", "y" * 9000), ("b", None)], "path string, content string"), fussy).collect()
    assert long[0].vector[0] / long[0].vector[1] == pytest.approx(4096) and long[1].vector == [0.0, 1.0]
    wrong = extract.embeddings(spark.createDataFrame([("a", "y")], "path string, content string"), lambda: lambda texts: np.zeros(3)).collect()
    assert wrong[0].vector is None


def test_pictures(spark, tmp_path):
    e = spark.createDataFrame([(f"d/{k}.ts", "d/<hub>.ts") for k in range(6)], "src string, dst string")
    n = graph.nodes(e)
    exports.write_lines(exports.html(n, e), str(tmp_path / "page"))
    (part,) = (tmp_path / "page").glob("part-*")
    lines = part.read_text().split("\n")
    assert lines[0].startswith("<!DOCTYPE html>") and lines[1].startswith("<svg") and lines[-2] == "</body></html>" and lines[-3] == "</svg>"
    assert sum("<line" in x for x in lines) == 6 and sum("<circle" in x for x in lines) == 7 and sum('class="hub"' in x for x in lines) == 1
    assert any("d/&lt;hub&gt;.ts: 6 importers" in x for x in lines) and any(">&lt;hub&gt;.ts</text>" in x for x in lines)
    assert exports.svg(n.limit(0), e.limit(0)).where("ord BETWEEN 1 AND 3").count() == 0


def test_the_last_confidence_counts(spark):
    rows = [("a", "f", "g", "inferred", 1), ("a", "f", "g", None, 2), ("b", "", "g", "ambiguous", 1), ("b", "h", "x", "inferred", 1)]
    index = graph.call_index(spark.createDataFrame(rows, "caller_file string, caller_symbol string, callee_symbol string, confidence string, at long"), "at")
    names = spark.createDataFrame([("g",), ("g",)], "name string")
    ask = lambda c=None: sorted((r.caller_file, r.caller_symbol, r.confidence) for r in graph.callers_of(index, names, c).collect())
    assert ask() == [("a", "f", "extracted"), ("b", "", "ambiguous")] and ask("extracted") == [("a", "f", "extracted")] and ask("inferred") == []
    with pytest.raises(ValueError):
        graph.callers_of(index, names, "sure")


def test_source_recall(spark):
    truth = spark.createDataFrame([(1, "a.ts"), (1, "b.md"), (1, "c.py"), (1, "c.py"), (2, "d.md")], "pr long, file string")
    said = spark.createDataFrame([(1, "a.ts"), (1, "b.md"), (3, "x.ts")], "pr long, file string")
    got = sorted(tuple(r) for r in evals.source_recall(truth, said, ["pr", "file"], "pr", predicates.is_source("file")).collect())
    assert got == [(1, 2, 1, 0.5), (2, 0, 0, 1.0), (3, 0, 0, 1.0)]


def test_locale_order_and_extensions(spark):
    words = ["b", "a", "É", "e", "E", "é", "f", "Z", "z"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in df.orderBy(locale_order("w"), "w").collect()] == ["a", "b", "e", "E", "é", "É", "f", "z", "Z"]
    x = spark.createDataFrame([("a.TS",), ("b.tar.GZ",), ("noext",), ("c.md",), ("d.svg",)], "p string").select("p", predicates.is_source("p").alias("s"), predicates.is_binary("p").alias("b")).collect()
    assert [(r.s, r.b) for r in x] == [(True, False), (False, True), (False, False), (False, False), (False, True)]


def test_transitions_of_allowed_tools(spark):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", t, 200_000.0 if t == "b" else 1.0) for k, t in enumerate("abababacacacbcbc")]
    e = spark.createDataFrame(rows, "event_id long, t string, tool string, original_tokens double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "tool", "original_tokens")
    got = {(r.from_tool, r.to_tool): (r.n, r.avg_tokens) for r in telemetry.tool_transitions(e, least=2).collect()}
    assert got[("a", "b")] == (3, 100_000.0) and ("a", "c") in got and ("c", "b") in got
    assert {(r.from_tool, r.to_tool) for r in telemetry.tool_transitions(e, least=2, allowed=["a", "b"]).collect()} == {("a", "b"), ("b", "a")}


def test_repositories_without_vectors_are_skipped_and_few_rows_move(spark):
    v = spark.createDataFrame([(k % 2, k, [float(k), 0.0]) for k in range(50)], "repo long, path long, vector array<float>")
    q = spark.createDataFrame([([3.0, 0.0],)], "q array<float>")
    near = search.cross_repo(v, q, 3)
    assert [r.path for r in near.collect()] == [3, 2, 4]
    assert "WindowGroupLimit" in near._jdf.queryExecution().executedPlan().toString()
    repos = spark.createDataFrame([(0,), (1,), (9,), (9,)], "repo long")
    assert sorted(tuple(r) for r in search.searched_repos(v, repos).collect()) == [(0, 25, False), (1, 25, False), (9, 0, True)]
