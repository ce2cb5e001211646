from repolith.functions.predicates import glob_to_regex
from repolith.operators import community, graph
from repolith.plans import catalog
from repolith.operators.lineage import numbered

import re

import pytest
from pyspark.sql import functions as F


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


CHAIN = [("server", "api"), ("api", "user"), ("user", "auth")]


def test_impact_of_a_chain(spark):
    e = edges(spark, *CHAIN)
    assert rows(graph.impact_radius(e, paths(spark, "auth"), 3)) == [("api", 2, "transitive"), ("server", 3, "transitive"), ("user", 1, "direct")]
    assert rows(graph.impact_radius(e, paths(spark, "auth"), 1)) == [("user", 1, "direct")]
    assert rows(graph.impact_radius(e, paths(spark, "nowhere"), 3)) == []


def test_bfs_takes_the_shortest_way_and_ends_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"))
    assert rows(graph.bfs(e, paths(spark, "a"), 10)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(graph.bfs(e, paths(spark, "c"), 10, "in")) == [("a", 1), ("b", 1), ("c", 0)]


def test_degrees_and_hubs(spark):
    e = edges(spark, ("a", "x"), ("b", "x"), ("x", "c"))
    assert rows(graph.degrees(e)) == [("a", 0, 1, 1), ("b", 0, 1, 1), ("c", 1, 0, 1), ("x", 2, 1, 3)]
    assert [r.path for r in graph.hub_nodes(e).collect()] == ["x"]
    assert graph.minimal_context_hubs(e).first().reason == "fan_in"


def test_gaps(spark):
    e = edges(spark, ("src/a.ts", "src/hub.ts"), ("src/b.ts", "src/hub.ts"), ("src/index.ts", "src/hub.ts"), ("src/a.ts", "src/ok.ts"), ("src/b.ts", "src/ok.ts"), ("src/index.ts", "src/ok.ts"))
    n = paths(spark, "src/a.ts", "src/b.ts", "src/hub.ts", "src/index.ts", "src/lone.ts", "src/ok.ts", "x/tests/ok.test.ts")
    assert rows(graph.knowledge_gaps(n, e)) == [("src/a.ts", "dead_code"), ("src/b.ts", "dead_code"), ("src/hub.ts", "untested_hub"), ("src/lone.ts", "isolated")]


def test_cycles_once_each(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"))
    assert [(list(r.cycle), r.length) for r in graph.import_cycles(e).collect()] == [(["a", "b"], 2), (["a", "b", "c"], 3)]


def test_diff_and_update(spark):
    old, new = edges(spark, ("a", "b"), ("a", "c")), edges(spark, ("a", "b"), ("d", "a"))
    assert rows(graph.diff(old, new, ["src", "dst"])) == [("a", "c", "removed"), ("d", "a", "added")]
    changed = spark.createDataFrame([("a", False), ("c", True)], "path string, removed boolean")
    full = edges(spark, ("a", "b"), ("x", "a"), ("x", "c"))
    assert rows(graph.update_edges(full, changed, edges(spark, ("a", "z")))) == [("a", "z"), ("x", "a")]


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/domain/**", "src/domain/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/x.ts", "x.ts", True), ("{a,b}/c", "b/c", True), ("a.ts", "aXts", False), ("[!a]b", "cb", True)])
def test_globs(glob, path, hit):
    assert bool(re.match(glob_to_regex(glob), path)) == hit


def test_rules(spark):
    rules = spark.createDataFrame([("layers", "error", glob_to_regex("src/domain/**"), glob_to_regex("src/infra/**")), ("dead", "warn", glob_to_regex("nothing/**"), glob_to_regex("src/**"))], "name string, severity string, from_re string, to_re string")
    e = edges(spark, ("src/domain/user.ts", "src/infra/db.ts"), ("src/infra/db.ts", "src/domain/user.ts"))
    assert rows(graph.rule_violations(e, rules)) == [("layers", "error", "src/domain/user.ts", "src/infra/db.ts")]
    assert [r.name for r in graph.dead_rules(graph.nodes(e), rules).collect()] == ["dead"]


def test_two_triangles_are_two_communities(spark):
    e = edges(spark, ("a/1", "a/2"), ("a/2", "a/3"), ("a/3", "a/1"), ("b/1", "b/2"), ("b/2", "b/3"), ("b/3", "b/1"), ("a/1", "b/1"), ("lone/1", "lone/2"))
    found = community.communities(e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.path)
    assert {frozenset(g) for g in groups.values()} == {frozenset({"a/1", "a/2", "a/3"}), frozenset({"b/1", "b/2", "b/3"}), frozenset({"lone/1", "lone/2"})}
    assert rows(community.community_names(found).select("name", "size")) == [("a", 3), ("b", 3), ("lone", 2)]
    whole = found.withColumn("community", F.lit("all"))
    assert community.modularity(e, found).first().q > community.modularity(e, whole).first().q


def test_large_graphs_are_made_smaller_by_rounds_first(spark):
    """Rings of cliques: rounds over joins, with or without the kernel behind them, find them as the kernel does."""
    pairs = [(f"c{c:02d}/{a}", f"c{c:02d}/{b}") for c in range(12) for a in range(6) for b in range(a)] + [(f"c{c:02d}/0", f"c{(c + 1) % 12:02d}/5") for c in range(12)]
    e = edges(spark, *pairs)
    q = lambda found: community.modularity(e, found).first().q
    best = community.communities(e)
    for kernel_edges in (60, 0):
        found = community.communities(e, kernel_edges, 10, 2)
        assert found.count() == found.select("path").distinct().count() == 72
        assert q(found) > 0.9 * q(best) and all(r.community <= r.path for r in found.collect())


def brandes(pairs):
    nodes = sorted({x for p in pairs for x in p})
    near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in nodes}

    def ways(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return found

    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            if s != t and (w := ways(s, t)):
                for n in nodes:
                    if n not in (s, t):
                        score[n] += sum(n in p for p in w) / len(w)
    return {n: v for n, v in score.items() if v > 0}


def test_betweenness(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "a"), ("b", "a")]
    got = {r.path: round(r.score, 6) for r in community.betweenness(edges(spark, *pairs), limit=None).collect()}
    assert got == {n: round(v, 6) for n, v in brandes(pairs).items()}


def test_betweenness_of_random_graphs(spark):
    rng = __import__("random").Random(2)
    pairs = [(f"n{a}", f"n{b}") for a in range(14) for b in range(14) if a != b and rng.random() < 0.13] + [("x", "y")]
    got = {r.path: round(r.score, 6) for r in community.betweenness(edges(spark, *pairs), limit=None).collect()}
    assert got == {n: round(v, 6) for n, v in brandes(pairs).items()}
    assert community.betweenness(edges(spark, ("a", "a"))).count() == 0


def walked(table, start, depth, steps):
    rows, seen, stack = [], set(), [(start, 0, ())]
    while stack and len(rows) < steps:
        at, d, path = stack.pop()
        rows.append((len(rows), d, at, at in seen, at in path))
        if at not in seen and d < depth:
            seen.add(at)
            stack.extend((x, d + 1, (*path, at)) for x in reversed(sorted(table.get(at, []))))
    return rows


@pytest.mark.parametrize("depth,steps", [(10, 50), (2, 7), (0, 5), (10, 1)])
def test_flows_are_walks_in_pre_order(spark, depth, steps):
    rng = __import__("random").Random(depth)
    table = {}
    for a in range(25):
        table[f"s{a:02d}"] = {f"s{rng.randrange(30):02d}" for _ in range(rng.choice([0, 1, 2, 3, 9]))}
    rows_ = [("f", a, b, "f") for a, bs in table.items() for b in bs]
    got = {}
    starts = [("f", f"s{a:02d}") for a in range(0, 30, 3)]
    for r in community.flows(spark.createDataFrame(rows_, "caller_file string, caller_symbol string, callee_symbol string, callee_file string"), spark.createDataFrame(starts, "file string, symbol string"), depth, steps).orderBy("step").collect():
        got.setdefault(r.entry_symbol, []).append((r.step, r.depth, r.symbol, r.revisit, r.is_cycle))
    assert got == {s: walked(table, s, depth, steps) for _, s in starts}


def test_flows_mark_revisits_and_cycles(spark):
    calls = spark.createDataFrame([("f", "main", "a", "f"), ("f", "main", "b", "f"), ("f", "a", "c", "f"), ("f", "b", "c", "f"), ("f", "c", "a", "f")], "caller_file string, caller_symbol string, callee_symbol string, callee_file string")
    got = community.flows(calls, spark.createDataFrame([("f", "main")], "file string, symbol string")).orderBy("step").collect()
    assert [(r.symbol, r.depth, r.revisit, r.is_cycle) for r in got] == [("main", 0, False, False), ("a", 1, False, False), ("c", 2, False, False), ("a", 3, True, True), ("b", 1, False, False), ("c", 2, True, False)]


def test_numbering_is_total(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = {r.id: r.rk for r in numbered(df, [F.desc("k"), F.col("id")]).collect()}
    want = {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    assert got == want


def test_betweenness_moves_blocks_and_not_single_numbers(spark, monkeypatch):
    real, rows_of = community.cut, []

    def cut(df, name, after=None):
        out = real(df, name, after)
        rows_of.extend([out.count()] if name == "level" else [])
        return out

    monkeypatch.setattr(community, "cut", cut)
    pairs = [(f"n{k:03}", f"n{(k * m + 1) % 90:03}") for k in range(90) for m in (1, 7)]
    assert community.betweenness(edges(spark, *pairs), limit=None).count() > 50
    assert len(rows_of) > 3 and max(rows_of) <= 4


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_symbol_callers_meet_classes_of_seeds(spark):
    names = [(f"a/mod{k % 7}_{k}.py", n, "function") for k in range(21) for n in (("run", "stop") if k % 3 else ("run",))] + [("x/caller.py", "other", "function"), ("mod3", "run", "function")]
    symbols = spark.createDataFrame(names, "path string, name string, type string")
    callers = ["b/Mod3_3/main.py", "b/mod3.py", "c.py", "a/mod0_0.py", "mod3"]
    calls = spark.createDataFrame([(c, "f", n) for c in callers for n in ("run", "stop", "none")], "caller_file string, caller_symbol string, callee_symbol string")
    seeds = symbols.select("path").where("path != 'x/caller.py'").distinct()
    out = graph.symbol_callers(symbols, calls, seeds, 100, 0.0)
    defs = {n: sum(x[1] == n for x in names) for n in ("run", "stop")}
    want = {}
    for c in callers:
        for p in {x[0] for x in names if x[1] != "other" and x[0] != c}:
            words = [w for w in re.split("[^a-z0-9]+", re.sub(r"\.[^.]*$", "", p.split("/")[-1]).lower()) if len(w) >= 3]
            score = sum(1 / defs[x[1]] for x in names if x[0] == p) + any(w in c.lower() for w in words)
            want[c] = max(want.get(c, 0), score)
    assert {r.caller_file: round(r.score, 9) for r in out.collect()} == {c: round(v, 9) for c, v in want.items()}
    assert not re.search(r"Aggregate \[path#\d+, caller_file", _plan(out))


def test_affected_flows_do_not_pair_callers_with_files(spark, monkeypatch):
    calls = spark.createDataFrame([("m", "f", "run", "a"), ("n", "g", "run", "a")], "caller_file string, caller_symbol string, callee_symbol string, callee_file string")
    symbols = spark.createDataFrame([("a", "run"), ("b", "run"), ("a", "idle")], "path string, name string")
    got = []
    monkeypatch.setattr(community, "flows", lambda calls, entries, depth, steps: got.append(entries) or entries)
    community.affected_flows(calls, symbols, paths(spark, "a", "b"))
    assert rows(got[0]) == [("a", "idle"), ("m", "f"), ("n", "g")]
    assert "LeftOuter" not in _plan(got[0])


def test_affected_flows_are_of_all_callers(spark):
    calls = spark.createDataFrame([(f"m{k:02}", f"f{k % 3}", "run", "a") for k in range(45)], "caller_file string, caller_symbol string, callee_symbol string, callee_file string")
    symbols = spark.createDataFrame([("a", "run"), ("a", "idle")], "path string, name string")
    flows = community.affected_flows(calls, symbols, paths(spark, "a")).collect()
    assert sorted((r.entry_file, r.entry_symbol) for r in flows if r.step == 0) == [("a", "idle"), *((f"m{k:02}", f"f{k % 3}") for k in range(45))]
    assert len(flows) == 1 + 2 * 45
    first = community.affected_flows(calls, symbols, paths(spark, "a"), most=2).where("step = 0").collect()
    assert sorted(r.entry_file for r in first) == ["a", "m00"]


def test_community_rounds_move_blocks_and_not_edges(spark, monkeypatch):
    """A round writes a row for each range of nodes, not one for each node."""
    real, rows_of = community.cut, []

    def cut(df, name, after=None):
        out = real(df, name, after)
        rows_of.extend([out.count()] if name == "labels" else [])
        return out

    monkeypatch.setattr(community, "cut", cut)
    pairs = [(f"n{k:03}", f"n{(k * m + 1) % 90:03}") for k in range(90) for m in (1, 7)]
    assert community.communities(edges(spark, *pairs), 0, 3, 1).count() == 90
    assert len(rows_of) > 1 and max(rows_of) == 1


def test_diff_of_views_aggregates_no_paths(spark):
    e = edges(spark, ("a", "b"), ("c", "b"), ("a", "d"), ("c", "d"))
    old, new = F.col("src") != "a", F.col("dst") != "d"
    assert rows(graph.diff_of_views(e, old, new, ["src", "dst"])) == rows(graph.diff(e.where(old), e.where(new), ["src", "dst"])) == [("a", "b", "added"), ("c", "d", "removed")]
    plan = _plan(catalog.queries()["graph_diff_edges"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Aggregate \[(src|path)#\d+, (dst|path)#\d+", plan) and plan.count("lineitem.parquet") + plan.count("Window [") <= 2


def test_flows_go_through_arrow_columns(spark, monkeypatch):
    """No frame of Rows is made of what flows know; odd strings and places without callees pass."""
    monkeypatch.setattr(community.DataFrame, "mapInPandas", None)
    calls = spark.createDataFrame([("f", "main", "é", "g/ü"), ("f", "main", "", "f"), ("g/ü", "é", "main", "f"), ("f", "", None, None)], "caller_file string, caller_symbol string, callee_symbol string, callee_file string")
    got = community.flows(calls, spark.createDataFrame([("f", "main"), ("x", "none")], "file string, symbol string")).orderBy("entry_file", "step").collect()
    assert [(r.entry_symbol, r.file, r.symbol, r.depth, r.is_cycle) for r in got] == [("main", "f", "main", 0, False), ("main", "f", "", 1, False), ("main", None, None, 2, False), ("main", "g/ü", "é", 1, False), ("main", "f", "main", 2, True), ("none", "x", "none", 0, False)]
