"""Operators over the import graph, edges(src, dst), and the call graph, calls(caller_file, caller_symbol, callee_symbol)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.predicates import ENTRY_POINT, TEST_FILE
from repolith.operators.lineage import count, cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """path, fan_in, fan_out, total: one aggregation over both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    d = ends.groupBy("e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return d.withColumn("total", F.col("fan_in") + F.col("fan_out"))


def hub_nodes(edges: DataFrame, min_degree: int = 2, limit: int = 20) -> DataFrame:
    return degrees(edges).where(F.col("total") >= min_degree).orderBy(F.desc("total"), "path").limit(min(limit, 100))


def minimal_context_hubs(edges: DataFrame, limit: int = 5) -> DataFrame:
    reason = F.when(F.col("fan_in") > F.col("fan_out"), "fan_in").when(F.col("fan_in") < F.col("fan_out"), "fan_out").otherwise("bridge")
    return hub_nodes(edges, 2, limit).withColumn("reason", reason)


def knowledge_gaps(all_nodes: DataFrame, edges: DataFrame, hub_degree: int = 3, test_pattern: str = TEST_FILE, entry_pattern: str = ENTRY_POINT) -> DataFrame:
    """path, gap: isolated, dead_code or untested_hub. Test files are skipped; isolated files are in no other class."""
    d = all_nodes.join(degrees(edges), "path", "left").fillna(0, ["fan_in", "fan_out"])
    code = d.where(~F.col("path").rlike(test_pattern))
    isolated = (F.col("fan_in") == 0) & (F.col("fan_out") == 0)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    tests = d.where(F.col("path").rlike(test_pattern)).select(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", ""), "[._](test|spec)$", "").alias("stem")).distinct()
    hubs = code.where(F.col("fan_in") >= hub_degree).withColumn("stem", stem).join(tests, "stem", "left_anti")
    return (
        code.where(isolated).select("path", F.lit("isolated").alias("gap"))
        .unionByName(code.where(~isolated & (F.col("fan_in") == 0) & ~F.col("path").rlike(entry_pattern)).select("path", F.lit("dead_code").alias("gap")))
        .unionByName(hubs.where(~isolated).select("path", F.lit("untested_hub").alias("gap")))
    )


def production_imports_test(edges: DataFrame, test_pattern: str = TEST_FILE) -> DataFrame:
    return edges.where(~F.col("src").rlike(test_pattern) & F.col("dst").rlike(test_pattern))


def rule_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: name, severity, from_re, to_re. A row for each edge that a rule forbids. Rules are a handful: the join streams the edges."""
    return edges.join(F.broadcast(rules), F.expr("src rlike from_re AND dst rlike to_re")).select("name", "severity", "src", "dst")


def dead_rules(all_nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of which a side matches no file."""
    hits = all_nodes.crossJoin(F.broadcast(rules)).groupBy("name").agg(F.max(F.expr("path rlike from_re")).alias("from_hit"), F.max(F.expr("path rlike to_re")).alias("to_hit"))
    return hits.where("NOT from_hit OR NOT to_hit")


def diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """columns and change: added or removed. One aggregation instead of two anti-joins."""
    both = old.select(*columns, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(*columns, F.lit(0), F.lit(1)))
    seen = both.groupBy(*columns).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o != n")
    return seen.select(*columns, F.when(F.col("n") == 1, "added").otherwise("removed").alias("change"))


def diff_of_views(rows: DataFrame, old: Column, new: Column, columns: list[str]) -> DataFrame:
    """The same of two views of one table: of its distinct rows, those that only one of the conditions holds for. Nothing is aggregated twice."""
    o, n = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return rows.where(o != n).select(*columns, F.when(n, "added").otherwise("removed").alias("change"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 10, direction: str = "out") -> DataFrame:
    """path, hop of what the seeds (path) reach within depth hops; seeds have hop 0. direction: out follows imports, in follows importers, both either.

    Each hop joins the frontier to the edges and drops what was seen. A hop's
    result is written: the plan doesn't double from hop to hop. It ends early on
    an empty frontier.
    """
    fwd, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"out": fwd, "in": back, "both": fwd.union(back)}[direction]
    seen = frontier = cut(seeds.select("path").distinct().withColumn("hop", F.lit(0)), "bfs")
    for hop in range(1, min(depth, 10) + 1):
        reached = frontier.join(step, frontier["path"] == step["src"]).select(F.col("dst").alias("path")).distinct().join(seen, "path", "left_anti")
        frontier = cut(reached.withColumn("hop", F.lit(hop)), "bfs")
        if hop < depth and frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def impact_radius(edges: DataFrame, seeds: DataFrame, depth: int = 3, with_importees: bool = False) -> DataFrame:
    """path, hop, signal (direct, transitive, importee) of files that a change of the seeds may reach."""
    hit = bfs(edges, seeds, depth, "in").where("hop > 0").withColumn("signal", F.when(F.col("hop") == 1, "direct").otherwise("transitive"))
    return hit.unionByName(importees(edges, seeds).withColumns({"hop": F.lit(1), "signal": F.lit("importee")})) if with_importees else hit


def importees(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    s = seeds.select("path")
    return edges.join(s, edges["src"] == s["path"], "left_semi").select(F.col("dst").alias("path")).distinct().join(s, "path", "left_anti")


def reachability(edges: DataFrame, entries: DataFrame, truth: DataFrame, depth: int = 4) -> DataFrame:
    """Of the true files, the share within depth undirected hops of an entry; null without any."""
    near = bfs(edges, entries, depth, "both").select("path", F.lit(1).alias("hit"))
    return truth.select("path").distinct().join(near, "path", "left").agg(count().alias("n_truth"), F.count("hit").alias("n_reached"), (F.count("hit") / F.nullif(count(), F.lit(0))).alias("ratio"))


def call_sites(symbols: DataFrame, calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """All callers of each symbol that a seed file defines."""
    defined = symbols.join(seeds.select("path"), "path", "left_semi").select("name").distinct()
    return calls.join(defined, calls["callee_symbol"] == defined["name"], "left_semi").select("caller_file", "caller_symbol", "callee_symbol")


def call_index(calls: DataFrame, *order: str) -> DataFrame:
    """caller_file, caller_symbol, callee_symbol, confidence: of repeated edges the last one's confidence, in the order of some columns; without one it is 'extracted'."""
    known = calls.withColumn("confidence", F.coalesce("confidence", F.lit("extracted")))
    return known.groupBy("caller_file", "caller_symbol", "callee_symbol").agg(F.max_by("confidence", F.struct(*order)).alias("confidence"))


def callers_of(index: DataFrame, symbols: DataFrame, confidence: str | None = None) -> DataFrame:
    """name, caller_file, caller_symbol, confidence: who calls the symbols (name), with one confidence or any."""
    if confidence not in (None, "extracted", "inferred", "ambiguous"):
        raise ValueError(f"no such confidence: {confidence}")
    hit = index if confidence is None else index.where(F.col("confidence") == confidence)
    return hit.withColumnRenamed("callee_symbol", "name").join(symbols.select("name").distinct(), "name", "left_semi").select("name", "caller_file", "caller_symbol", "confidence")


def symbol_callers(symbols: DataFrame, calls: DataFrame, seeds: DataFrame, limit: int = 25, least: float = 1.0) -> DataFrame:
    """caller_file, score: a symbol that n files define adds 1 / n, once a caller, symbol and seed; 1 more where the caller's path holds a word of a seed's stem."""
    mine = symbols.where(F.col("type") != "import").join(seeds.select("path"), "path", "left_semi").select("path", "name").distinct()
    n = symbols.groupBy("name").agg(count().alias("n_defs"))
    # Seeds that define the same names have the same callers and weights: callers meet such classes, not each seed. A class's least and
    # greatest path tell whether a caller is all there is of it.
    classes = mine.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumn("class", F.sha2(F.to_json("names"), 256))
    ends = lambda low, high: [F.min("path").alias(low), F.max("path").alias(high)]
    other = lambda low, high: (F.col(low) != F.col("caller_file")) | (F.col(high) != F.col("caller_file"))
    of = classes.groupBy("class").agg(F.first("names").alias("names"), *ends("low", "high")).select("class", "low", "high", F.explode("names").alias("name"))
    sites = calls.select("caller_file", F.col("callee_symbol").alias("name")).distinct()
    per = of.join(n, "name").join(sites, "name").where(other("low", "high")).groupBy("class", "caller_file").agg(F.sum(1.0 / F.col("n_defs")).alias("specific"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    words = F.filter(F.split(F.lower(stem), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    held = classes.select("class", "path", F.explode(F.array_distinct(words)).alias("word")).groupBy("class", "word").agg(*ends("near_low", "near_high"))
    # A word lies in a caller's path if one of the path's own parts of its length is it.
    runs = F.filter(F.split(F.lower("caller_file"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    tails = F.flatten(F.transform(runs, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.length(w)))))
    parts = F.flatten(F.transform(tails, lambda w: F.transform(F.sequence(F.lit(3), F.length(w)), lambda k: F.substring(w, F.lit(1), k))))
    inside = sites.select("caller_file").distinct().select("caller_file", F.explode(F.array_distinct(parts)).alias("word"))
    near = inside.join(held, "word").where(other("near_low", "near_high")).select("class", "caller_file").distinct().withColumn("near", F.lit(1.0))
    scored = per.join(near, ["class", "caller_file"], "left").withColumn("score", F.col("specific") + F.coalesce("near", F.lit(0.0)))
    return scored.groupBy("caller_file").agg(F.max("score").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "caller_file").limit(limit)


def callee_file(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with the file its callee is in: the first definition, else the first file where it calls, else the caller's own."""
    first = symbols.groupBy(F.col("name").alias("callee_symbol")).agg(F.min("path").alias("def_file"))
    as_caller = calls.groupBy(F.col("caller_symbol").alias("callee_symbol")).agg(F.min("caller_file").alias("call_file"))
    joined = calls.join(first, "callee_symbol", "left").join(as_caller, "callee_symbol", "left")
    return joined.select("caller_file", "caller_symbol", "callee_symbol", F.coalesce("def_file", "call_file", "caller_file").alias("callee_file"))


def import_cycles(edges: DataFrame, longest: int = 5, limit: int = 20, rounds: int = 12) -> DataFrame:
    """cycle (path array from its least file), length. Paths grow only through files above their start, so each cycle is found once.

    Files that nothing imports, or that import nothing, are in no cycle: they are peeled off first, for some rounds. What longer chains
    leave behind only makes paths that don't close.
    """
    e = cut(edges.where("src != dst").select("src", "dst").distinct(), "cyclic")
    n = e.count()
    for _ in range(rounds):
        left = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = cut(left, "cyclic", e)
        before, n = n, e.count()
        if n == before:
            break
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("cycle"))
    found = None
    for length in range(2, longest + 1):
        closing = paths.join(e, (paths["last"] == e["src"]) & (paths["start"] == e["dst"]), "left_semi").select("cycle", F.lit(length).alias("length"))
        found = closing if found is None else found.union(closing)
        if length < longest:
            paths = cut(paths.join(e, (paths["last"] == e["src"]) & (e["dst"] > paths["start"]) & ~F.array_contains("cycle", F.col("dst"))).select("start", F.col("dst").alias("last"), F.concat("cycle", F.array("dst")).alias("cycle")), "paths")
    return found.orderBy("length", "cycle").limit(limit)


def cross_group_imports(edges: DataFrame, groups: DataFrame, limit: int | None = 50) -> DataFrame:
    """src, dst, from_name, to_name of edges between groups (path, name) of other names."""
    a, b = groups.select(F.col("path").alias("src"), F.col("name").alias("from_name")), groups.select(F.col("path").alias("dst"), F.col("name").alias("to_name"))
    out = edges.join(a, "src").join(b, "dst").where("from_name != to_name").select("src", "dst", "from_name", "to_name")
    return out.orderBy("src", "dst").limit(limit) if limit else out


def group_hubs(edges: DataFrame, groups: DataFrame, k: int = 3) -> DataFrame:
    """Of each group the k files with the most edges inside it."""
    a, b = groups.select(F.col("path").alias("src"), F.col("name").alias("g")), groups.select(F.col("path").alias("dst"), F.col("name").alias("h"))
    inner = edges.join(a, "src").join(b, "dst").where("g = h").select("src", "dst", F.col("g").alias("name"))
    d = inner.select("name", F.explode(F.array("src", "dst")).alias("path")).groupBy("name", "path").agg(count().alias("degree"))
    w = Window.partitionBy("name").orderBy(F.desc("degree"), "path")
    return d.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def group_coupling(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """from_name, to_name, n: imports from one group to another."""
    return cross_group_imports(edges, groups, None).groupBy("from_name", "to_name").agg(count().alias("n"))


def refactor_candidates(symbol: str | Column, symbols: DataFrame, edges: DataFrame, calls: DataFrame, most: int = 50) -> DataFrame:
    """Files that define a symbol, import such a file, or call it; the first by path."""
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    defs = symbols.where(F.col("name") == name).select("path").distinct()
    importers = edges.join(defs, edges["dst"] == defs["path"], "left_semi").select(F.col("src").alias("path"))
    callers = calls.where(F.col("callee_symbol") == name).select(F.col("caller_file").alias("path"))
    return defs.union(importers).union(callers).distinct().orderBy("path").limit(most)


def callers_in_importers(symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """name, file, caller_file, caller_symbol: the calls of each symbol in files that import the file that defines it."""
    importers = symbols.select("name", F.col("path").alias("file")).distinct().join(edges.select(F.col("src").alias("caller_file"), F.col("dst").alias("file")).distinct(), "file")
    sites = calls.select(F.col("callee_symbol").alias("name"), "caller_file", "caller_symbol").distinct()
    return importers.join(sites, ["name", "caller_file"]).select("name", "file", "caller_file", "caller_symbol")


#: The order in which a file's signals count.
SIGNALS = ("direct", "transitive", "importee", "symbol_caller", "historical", "semantic")


def impact_union(arms: DataFrame) -> DataFrame:
    """path, signal, signals: of each file that some arm (path, signal) names, the first signal and all of them in their order."""
    rank = F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("signal"))
    one = arms.select("path", F.struct(rank.alias("rank"), "signal").alias("x")).distinct().groupBy("path").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return one.select("path", F.col("x")[0]["signal"].alias("signal"), F.array_join(F.transform("x", lambda x: x["signal"]), ",").alias("signals"))


def update_edges(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The graph after files (changed: path, removed) were read again: their out-edges are replaced; edges into removed files go."""
    kept = edges.join(changed.select(F.col("path").alias("src")), "src", "left_anti")
    kept = kept.join(changed.where("removed").select(F.col("path").alias("dst")), "dst", "left_anti")
    return kept.select("src", "dst").unionByName(fresh.select("src", "dst")).distinct()
