import math

import pytest
from pyspark.sql import functions as F

from repolith.operators import history, risk

DAY = 86400


def commits(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], "sha long, author long, ts long, message string, is_merge boolean")


def files(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], "sha long, path string, added long, deleted long")


def history_of(spark):
    c = commits(spark, (1, 1, 100, "add", False), (2, 1, 200, "fix: x", False), (3, 2, 300, "more", False), (4, 2, 400, "Revert y", False), (5, 1, 500, "merge", True))
    f = files(spark, (1, "A", 10, 0), (1, "B", 1, 1), (2, "A", 2, 0), (2, "C", 0, 0), (3, "B", 5, 0), (3, "D", 1, 0), (4, "A", 0, 3), (4, "B", 1, 0), (5, "A", 1, 1), (5, "B", 1, 1))
    return c, f


def test_churn_counts_merges_and_finds_fixes(spark):
    got = {r.path: r for r in history.churn(*history_of(spark)).collect()}
    assert (got["A"].commits, got["A"].churn_lines, got["A"].bug_commits, got["A"].last_touch) == (4, 17, 2, 500)
    assert got["A"].bug_density == 0.5 and got["D"].bug_commits == 0


def test_entropy(spark):
    got = {r.path: r.author_entropy for r in history.author_entropy(*history_of(spark)).collect()}
    assert abs(got["B"] - 1.0) < 1e-12 and got["C"] == 0
    assert abs(got["A"] - -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))) < 1e-12


def test_pairs_skip_merges_and_bulk(spark):
    got = {(r.node_a, r.node_b): (r.shared, r.count_a, r.count_b, r.last_ts) for r in history.cochange_pairs(*history_of(spark)).collect()}
    assert got == {("A", "B"): (2, 3, 3, 400), ("A", "C"): (1, 3, 1, 200), ("B", "D"): (1, 3, 1, 300)}
    assert history.cochange_pairs(*history_of(spark), bulk=1).count() == 0


def test_pairs_as_ingested_are_those_of_the_oldest_meeting(spark):
    got = {(r.node_a, r.node_b): (r.shared, r.count_a, r.count_b) for r in history.cochange_as_ingested(*history_of(spark)).collect()}
    assert got == {("A", "B"): (2, 3, 3), ("A", "C"): (1, 2, 1), ("B", "D"): (1, 2, 1)}


def test_confidence_halves_with_age(spark):
    p = spark.createDataFrame([("A", "B", 4, 4, 4, 1000, 1.0)], "node_a string, node_b string, shared long, count_a long, count_b long, last_ts long, jaccard double")
    now = 1000 + 90 * DAY
    got = history.coupling(p, now).collect()
    assert {(r.path, r.partner) for r in got} == {("A", "B"), ("B", "A")}
    assert all(abs(r.confidence - math.log1p(4) / 2) < 1e-12 for r in got)
    assert history.coupling(p, 1000, least_shared=5).count() == 0


def test_bus_factor(spark):
    c = commits(spark, *((i, i, 100, "m", False) for i in range(1, 5)), (5, 5, 1, "m", False), (6, 6, 1, "m", False))
    f = files(spark, *((i, "even", 25, 0) for i in range(1, 5)), (5, "uneven", 60, 0), (6, "uneven", 40, 0))
    own = history.ownership(c, f)
    assert {r.path: r.bus_factor for r in history.bus_factor(own).collect()} == {"even": 2, "uneven": 1}
    assert history.ownership(c, files(spark, (1, "zero", 0, 0))).count() == 0


def test_quantile_places(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert risk.pctl_floor_n(v, "v", 0.9).first().value == 10
    assert risk.pctl_floor_nm1(v, "v", 0.9).first().value == 9
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert risk.pctl_floor_n(one, "v", 0.5).first().value == 5
    assert risk.pctl_floor_nm1(v.limit(0), "v", 0.5).first().value is None


def test_bands_at_small_sizes(spark):
    def bands(n):
        df = spark.createDataFrame([(f"p{i:03d}", 1.0 - i / 200) for i in range(n)], "path string, score double")
        got = {}
        for r in risk.risk_bands(df).collect():
            got[r.label] = got.get(r.label, 0) + 1
        return got

    assert bands(2) == {"critical": 1, "high": 1}
    assert bands(100) == {"critical": 5, "high": 10, "medium": 20, "low": 65}
    low = spark.createDataFrame([("a", 0.01)], "path string, score double")
    assert risk.risk_bands(low).first().label == "low"


def test_change_levels(spark):
    e = spark.createDataFrame([(f"i{k}", "hub.ts") for k in range(5)] + [("a", "mid.ts"), ("b", "mid.ts"), ("c", "mid.ts"), ("x/tests/m.test.ts", "mid.ts")], "src string, dst string")
    c = spark.createDataFrame([("hub.ts",), ("mid.ts",), ("new.ts",)], "path string")
    from repolith.functions.predicates import TEST_FILE

    assert {r.path: r.level for r in risk.change_risk(c, e, TEST_FILE).collect()} == {"hub.ts": "critical", "mid.ts": "medium", "new.ts": "medium"}


def test_coverage_by_a_name_that_a_test_path_contains(spark):
    from repolith.operators.graph import nodes

    e = spark.createDataFrame([("src/user_service.ts", "src/db.ts"), ("src/tests/user_service.test.ts", "src/other.ts"), ("a", "README.md")], "src string, dst string")
    c = spark.createDataFrame([("src/user_service.ts",), ("src/db.ts",), ("README.md",), ("yarn.lock",), ("src/tests/user_service.test.ts",), ("src/.env",)], "path string")
    got = {r.path: (r.covered, r.level) for r in risk.change_risk(c, e).collect()}
    assert got == {"src/user_service.ts": (True, "low"), "src/db.ts": (False, "medium"), "README.md": (True, "low"), "yarn.lock": (True, "low"), "src/tests/user_service.test.ts": (True, "low"), "src/.env": (False, "medium")}
    paths, stems = nodes(e), spark.createDataFrame([("user_service",), ("nothing",), ("s",), ("README.md and more",)], "stem string")
    few, many = (sorted(r.stem for r in risk.containing(paths, stems, most).collect()) for most in (100, 0))
    assert few == many == ["s", "user_service"]
    assert [r.level for r in risk.by_level(spark.createDataFrame([("a", "low"), ("b", "critical"), ("c", "medium"), ("d", "high")], "path string, level string")).collect()] == ["critical", "high", "medium", "low"]


def test_ranked_values_by_ranges(spark):
    import random

    values = [random.Random(3).randrange(50) / 10 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for p in (0.0, 0.5, 0.9, 0.95, 1.0):
        assert risk.pctl_floor_nm1(df, "v", p).first().value == sorted(values)[int(499 * p)]
    assert risk.pctl_floor_n(df.where("v IS NULL"), "v", 0.5).first().value is None


def test_overlay_merges_are_the_whole(spark):
    from repolith.operators import overlay

    commits = spark.createDataFrame([(k, k % 3, 1000 + 10 * k, "fix" if k % 2 else "add", k == 5) for k in range(8)], "sha long, author long, ts long, message string, is_merge boolean")
    files = spark.createDataFrame([(k, p, k + 1, 1) for k in range(8) for p in "abcd"[: k % 4 + 1]], "sha long, path string, added long, deleted long")
    made = lambda where: overlay.measures(commits.where(where), files, "fix")
    merged, whole = overlay.merge(made("sha < 3"), made("sha >= 3")), made("true")
    for name in whole:
        rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        assert rows(merged[name]) == rows(whole[name]) and whole[name].count()
    assert sorted(r.sha for r in overlay.new_commits(commits, commits.where("sha < 6")).collect()) == [6, 7]


def test_ownership_list(spark):
    from repolith.operators import history

    owners = spark.createDataFrame([("a", 7, 60, 1), ("a", 8, 30, 2), ("a", 9, 10, 3), ("b", 8, 5, 1)], "path string, author long, weight long, rk int")
    factor = spark.createDataFrame([("a", 2), ("b", 1)], "path string, bus_factor int")
    assert [tuple(r) for r in history.ownership_list(owners, factor).collect()] == [("b", 1, 8, "", 1), ("a", 2, 7, "8,9", 3)]


def test_buckets_at_the_bounds(spark):
    df = spark.createDataFrame([(99,), (100,), (101,), (500,), (501,)], "n long")
    from pyspark.sql import functions as F

    got = df.select(risk.churn_bucket_tool(F.col("n")), risk.churn_bucket_dashboard(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("low", "low"), ("medium", "low"), ("medium", "medium"), ("high", "medium"), ("high", "high")]


def test_pairs_are_shuffled_as_numbers_and_files_with_commits_are_not_joined_again(spark):
    commits = spark.createDataFrame([(k, k % 3, 1000 * k, "fix", k == 4) for k in range(6)], "sha long, author long, ts long, message string, is_merge boolean")
    files = spark.createDataFrame([(k, p, 1, 1) for k in range(6) for p in ("b/x", "a/y", "a/z")[: 3 if k % 2 else 2]], "sha long, path string, added long, deleted long")
    touched = history.touches(commits, files)
    assert history.touches(commits, touched) is touched
    found = [sorted(map(tuple, history.cochange_pairs(commits, f).collect())) for f in (files, touched)]
    # found is node_a, node_b, shared, count_a, count_b, last_ts, jaccard; the merge (4) doesn't count.
    assert found[0] == found[1] == [("a/y", "a/z", 3, 5, 3, 5000, 0.6), ("a/y", "b/x", 5, 5, 5, 5000, 1.0), ("a/z", "b/x", 3, 3, 5, 5000, 0.6)]


def test_gathered_commits_give_the_same_pairs(spark):
    commits = spark.createDataFrame([(k, k % 3, 100 + k, "m", k % 4 == 3) for k in range(12)], "sha long, author long, ts long, message string, is_merge boolean")
    files = spark.createDataFrame([(k, f"f{j}", j, k) for k in range(12) for j in range(9 if k == 5 else 2 + k % 3)], "sha long, path string, added long, deleted long")
    names = spark.createDataFrame([(f"f{j}", j) for j in range(9)], "path string, node int")
    numbers = files.join(names, "path").select("sha", F.col("node").alias("path"), "added", "deleted")
    made = history.gathered(commits, numbers.repartition("sha"), 4)
    of = {r.sha: r.n for r in made.collect()}
    assert of[5] == 9 and max(len(r.files) for r in made.where("n <= 4").collect()) == 4 and made.where("sha = 5").count() > 1
    flat = made.select("sha", F.explode("files").alias("f")).select("sha", "f.*")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, numbers.collect()))
    lists = made.where("NOT is_merge AND n <= 4").select("ts", F.array_sort(F.col("files.path")).alias("p"))
    got, want = history.pairs_of(lists, names, 4, 2), history.cochange_pairs(commits, files, 4, 2)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_impact_reads_lines_once_for_edges_and_calls(spark, monkeypatch):
    """The graph of the flagship is a written table: hops don't order all lines again, and the history has no paths in it."""
    from repolith.operators import graph
    from repolith.plans import catalog
    from repolith.sources.adapters import Tables

    seen, real = [], Tables.next_parts
    monkeypatch.setattr(Tables, "next_parts", lambda t: seen.append("lines") or real(t))

    class Seen(Exception):
        pass

    def radius(edges, *more, **named):
        seen.append(edges._jdf.queryExecution().optimizedPlan().toString())
        raise Seen

    monkeypatch.setattr(graph, "impact_radius", radius)
    with pytest.raises(Seen):
        catalog.queries()["impact_union"](spark, "/root/testdata/sf0.001")
    assert seen[:-1] == ["lines"] and "Window" not in seen[-1] and "lineitem" not in seen[-1]
