import datetime as dt

from repolith.operators import evals, search, telemetry


def test_knn_both_metrics_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.6, 0.8])], "path long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query long, q array<float>")
    assert [(r.path, round(r.distance, 4)) for r in search.knn(v, q, 3).orderBy("rk").collect()] == [(1, 0.0), (3, 0.0), (4, 0.8)]
    assert [r.path for r in search.knn(v, q, 2, "cosine").orderBy("rk").collect()] == [1, 3]
    assert search.knn(v.limit(0), q, 3).count() == 0


def test_hybrid_adds_neighbours_once(spark):
    hits = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "path string, distance double")
    e = spark.createDataFrame([("a", "c"), ("c", "b"), ("a", "b")], "src string, dst string")
    assert [(r.path, round(r.score, 3), r.via) for r in search.hybrid_search(hits, e).collect()] == [("a", 0.1, "vector"), ("c", 0.2, "graph"), ("b", 0.3, "vector")]


def test_fulltext(spark):
    f = spark.createDataFrame([("a", "one\nTODO x\ntwo\ntodo y"), ("b", "nothing"), ("c", None), ("d", "a.b\naxb")], "path string, content string")
    got = search.fulltext(f, "todo").collect()
    assert [(r.path, r.matches, r.snippet) for r in got] == [("a", 2, "one\nTODO x\ntwo\n--\ntwo\ntodo y")]
    assert search.fulltext(f, "a.b").first().matches == 1
    assert search.fulltext(f, "a.b", regex=True).first().matches == 2


def test_rename_is_by_whole_words(spark):
    f = spark.createDataFrame([("a", "foo foobar\nfoo(foo)")], "path string, content string")
    assert [(r.line, r.after) for r in search.rename_preview(f, "foo", "baz").orderBy("line").collect()] == [(1, "baz foobar"), (2, "baz(baz)")]
    assert search.apply_rename(f, "foo", "baz").first().occurrences == 3


def test_budget_ladder(spark):
    rows = spark.createDataFrame([("x" * 100, "s", None), ("x" * 100, "s" * 4, 1), ("x" * 100, None, 2), ("x" * 100, None, 0), ("", None, 0), ("x" * 5, None, 2)], "full string, skeleton string, budget long")
    assert [(r.mode, r.tokens) for r in telemetry.budget_ladder(rows).collect()] == [("full", 25), ("skeleton", 1), ("truncate", 2), ("error", None), ("full", 0), ("full", 2)]


def at(seconds):
    return dt.datetime(2024, 1, 1, 23, 59) + dt.timedelta(seconds=seconds)


def test_transitions_cross_midnight(spark):
    e = spark.createDataFrame([(1, at(0), 1, "A", 5.0), (2, at(90), 1, "B", -4.0), (3, at(100), 2, "A", 6.0), (4, at(190), 1, "B", 8.0), (5, at(281), 1, "A", 1.0)], "event_id long, ts timestamp, user_id long, tool string, original_tokens double")
    got = {(r.from_tool, r.to_tool): (r.n, r.avg_tokens) for r in telemetry.tool_transitions(e, 90, 1).collect()}
    assert got == {("A", "B"): (2, 4.0), ("B", "A"): (1, 6.0)}
    assert telemetry.tool_transitions(e, 90).count() == 0


def test_sessions_and_breach_once(spark):
    e = spark.createDataFrame([(i, at(10 * i), 1, "t", 1.0) for i in range(12)] + [(99, at(1000), 1, "t", 1.0)], "event_id long, ts timestamp, user_id long, tool string, original_tokens double")
    assert sorted(r.calls for r in telemetry.session_counts(e, 90).collect()) == [1, 12]
    assert [r.event_id for r in telemetry.budget_breaches(e, 90).collect()] == [8]


def test_change_filter_compares_with_the_last_kept(spark):
    p = spark.createDataFrame([("f", t, s, lab) for t, s, lab in [(1, 0.5, "low"), (2, 0.51, "low"), (3, 0.52, "low"), (4, 0.53, "high"), (5, 0.535, "high")]], "path string, ts long, score double, label string")
    assert [r.ts for r in telemetry.change_filter(p).orderBy("ts").collect()] == [1, 3, 4]


def test_prf_conventions(spark):
    t = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "x")], "g string, k string")
    p = spark.createDataFrame([("p", "a"), ("p", "c"), ("r", "z")], "g string, k string")
    got = {r.g: (r.precision, r.recall, r.f1) for r in evals.prf(t, p, ["g", "k"], "g").collect()}
    assert got == {"p": (0.5, 0.5, 0.5), "q": (1.0, 0.0, 0.0), "r": (0.0, 1.0, 0.0)}
