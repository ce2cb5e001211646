"""Queries over logs, histories, links and streams that Spark writes from the driver's tables and reads back."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import predicates
from repolith.functions.text import locale_order
from repolith.functions.time import micros
from repolith.operators import evals, extract, graph, history, risk, search, trends
from repolith.operators.lineage import count, cut, numbered, round6, shared_dir
from repolith.plans.catalog import COUPLING, HISTORY, NOW, PAIRS, _now, _pairs, query, r6
from repolith.sources import exports, files, git, logs
from repolith.sources.adapters import CHAIN_EDGES, SUPPLIER_PATHS, TELEMETRY, Tables
from repolith.streaming import jobs


def _place(t: Tables, name: str) -> str:
    """A fresh folder that all executors see."""
    return f"{shared_dir(t.spark)}/repolith-{name}-{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, at: str, **options: str) -> str:
    df.write.options(**options).text(at)
    return at


# --- git logs ---------------------------------------------------------------------------

_SHA = "lpad(printf('%x', o_orderkey), 40, '0')"


def _log(t: Tables) -> str:
    """A log of the orders as git would print it: files as suppliers, with binary files, excluded folders and broken records among them."""
    rows = t.commit_files().select("sha", F.concat_ws("\t", "added", "deleted", "path").alias("line")).groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    c = t.commits().join(rows, "sha")
    name = F.lpad(F.lower(F.hex("sha")), 40, "0")
    parents = F.when(F.col("is_merge"), F.concat(name, F.lit(" "), name)).otherwise(name)
    extra = F.lit("\n-\t-\tlogo.png\n3\t4\tnode_modules/x/index.js\nx\ty\tbad\n")
    user = F.concat(F.lit("user "), F.col("author").cast("string"))
    record = F.concat_ws("\0", name, parents, user, F.concat("author", F.lit("@x.org")), F.col("ts").cast("string"), "message", F.concat(F.lit("\n\n"), F.col("lines"), extra))
    broken = F.when(F.col("sha") % 7 == 0, F.concat(F.lit("\x1eshort\0record"), F.lit("\x1e"), F.repeat(F.lit("0"), 39), F.lit("\0\0a\0b\0007\0m\0"))).otherwise("")
    return _written(c.select(F.concat(F.lit("\x1e"), record, broken).alias("value")), _place(t, "gitlog"), lineSep="\n")


@query(f"WITH {HISTORY} SELECT {_SHA.replace('o_orderkey', 'sha')} AS sha, 'user ' || author AS author, author || '@x.org' AS email, ts, message, is_merge, CAST(n AS INTEGER) AS n_files, n > 3 AS is_bulk, CAST(lines AS BIGINT) AS lines FROM commits JOIN (SELECT sha, count(*) AS n, sum(added + deleted) AS lines FROM commit_files GROUP BY sha) USING (sha)")
def git_commits(t: Tables) -> DataFrame:
    """Commits and their files out of a log's text: binary, unreadable and excluded files don't count, nor do broken records."""
    c = git.read(t.spark, _log(t), bulk=3)
    return c.select("sha", "author", "email", "ts", "message", "is_merge", F.size("files").alias("n_files"), "is_bulk", F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["added"] + f["deleted"]).alias("lines"))


@query(f"WITH {HISTORY} SELECT {_SHA.replace('o_orderkey', 'sha')} AS sha, path, added, deleted FROM commit_files JOIN commits USING (sha) WHERE sha % 3 = 0")
def git_incremental(t: Tables) -> DataFrame:
    """Files of the commits that a table of known ones lacks."""
    now = git.read(t.spark, _log(t))
    return git.commit_files(git.new_commits(now, now.where("conv(right(sha, 15), 16, 10) % 3 != 0")))


@query(f"WITH {HISTORY}, {NOW}, {PAIRS}, {COUPLING} SELECT path, partner, 'Changed together in ' || shared || ' commit' || CASE WHEN shared = 1 THEN '' ELSE 's' END || '; last co-change ' || days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END || ' ago.' AS explanation FROM (SELECT c.path, partner, shared, CAST(floor((now - last_ts) / 86400.0) AS BIGINT) AS days FROM coupled c, now JOIN (SELECT node_a, node_b, last_ts FROM pairs) p ON node_a = least(c.path, partner) AND node_b = greatest(c.path, partner) WHERE rk <= 3)")
def coupling_explained(t: Tables) -> DataFrame:
    """Each file's three strongest partners with a sentence."""
    pairs, now = cut(_pairs(t), "pairs"), _now(t)
    c = history.coupling(pairs, now, k=3)
    last = pairs.select(F.col("node_a").alias("__a"), F.col("node_b").alias("__b"), "last_ts")
    x = c.join(last, (F.least("path", "partner") == F.col("__a")) & (F.greatest("path", "partner") == F.col("__b")))
    return x.select("path", "partner", history.coupling_explanation(F.col("shared"), F.col("last_ts"), now).alias("explanation"))


# --- JSON logs --------------------------------------------------------------------------


@query(f"WITH {TELEMETRY}, x AS (SELECT *, min(CAST(ts AS DATE)) OVER () + INTERVAL 3 DAY AS a FROM tele) SELECT event_id, tool, epoch_us(ts) // 1000 AS ms FROM x WHERE ts >= a AND ts < a + INTERVAL 5 DAY AND tool = (SELECT min(tool) FROM tele)")
def telemetry_read(t: Tables) -> DataFrame:
    """Events of some days and a tool out of a log in folders by day: other days' folders aren't read."""
    e, at = t.telemetry(), _place(t, "telemetry")
    logs.append_telemetry(e.select("ts", F.col("event_id").cast("string").alias("event"), "tool", "original_tokens"), at)
    ends = e.agg(F.min(F.to_date("ts")).alias("first"), F.min("tool").alias("tool")).first()
    day = lambda n: str(ends["first"] + timedelta(days=n))
    found = logs.telemetry(t.spark, at, f"{day(3)} 00:00:00", f"{day(7)} 23:59:59.999999", ends["tool"])
    return found.select(F.col("event").cast("long").alias("event_id"), "tool", F.floor(micros("ts") / 1000).alias("ms"))


_SNAPSHOTS = "snap AS (SELECT 1700000000 + o_orderkey * 600 AS ts, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS edges, count(*) FILTER (l_discount > 0.05) AS dead, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(1 + max(l_tax), 2) END AS bus FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


def _snapshots(t: Tables) -> DataFrame:
    o, li = t.raw("orders").select("o_orderkey"), t.raw("lineitem")
    x = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey").agg(count().alias("files"), F.sum("l_linenumber").cast("long").alias("edges"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("dead"), F.round(1 + F.max("l_tax"), 2).alias("bus"))
    return x.select((1700000000 + F.col("o_orderkey") * 600).alias("ts"), "files", "edges", "dead", F.when(F.col("o_orderkey") % 3 != 0, F.col("bus")).alias("bus"))


@query(f"WITH {_SNAPSHOTS}, last AS (SELECT max(ts) AS now FROM snap) SELECT ts, files, edges, dead, bus FROM snap, last WHERE ts >= now - 30 * 86400 ORDER BY ts DESC LIMIT 500")
def trends_read(t: Tables) -> DataFrame:
    """The newest snapshots of thirty days out of a log with broken and incomplete lines."""
    s = cut(_snapshots(t), "snapshots")
    line = F.to_json(F.struct(F.col("ts").alias("unixSeconds"), F.col("files").alias("totalFiles"), F.col("edges").alias("totalEdges"), F.col("dead").alias("deadFiles"), F.col("bus").alias("avgBusFactor")))
    bad = F.when(F.col("ts") % 1800 == 0, F.concat(F.lit("\n{broken\n"), F.to_json(F.struct((F.col("ts") + 1).alias("unixSeconds"))))).otherwise("")
    at = _written(s.select(F.concat(line, bad).alias("value")), _place(t, "trends"))
    now = s.agg(F.max("ts").alias("now")).first().now
    return logs.trends(t.spark, at, now).select(F.col("unixSeconds").alias("ts"), F.col("totalFiles").alias("files"), F.col("totalEdges").alias("edges"), F.col("deadFiles").alias("dead"), F.col("avgBusFactor").alias("bus"))


_RISK = "pts AS (SELECT l_suppkey AS f, l_orderkey * 100 + l_linenumber AS ts, l_discount AS score, CASE WHEN l_discount > 0.08 THEN 'critical' WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0.02 THEN 'medium' WHEN l_discount > 0.005 THEN 'low' ELSE 'unknown' END AS label FROM lineitem), good AS (SELECT * FROM pts WHERE label <> 'unknown' AND f = 7)"


@query(f"WITH {_RISK} SELECT ts, score, label, (SELECT count(*) FROM good) AS total_count FROM good WHERE ts >= 1000 ORDER BY ts DESC LIMIT 200")
def file_risk_read(t: Tables) -> DataFrame:
    """A file's newest points out of a log of all files; the total counts those before the time asked for."""
    d = F.col("l_discount")
    label = F.when(d > 0.08, "critical").when(d > 0.05, "high").when(d > 0.02, "medium").when(d > 0.005, "low").otherwise("unknown")
    rows = t.raw("lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("unixSeconds"), F.col("l_suppkey").cast("string").alias("file"), d.alias("score"), label.alias("label"))
    at = _written(rows.select(F.to_json(F.struct("*")).alias("value")), _place(t, "risk"))
    return logs.file_risk(t.spark, at, "7", 1000).select(F.col("unixSeconds").alias("ts"), "score", "label", "total_count")


# --- trends -----------------------------------------------------------------------------

_SERIES = """series AS (SELECT l_suppkey AS repo, l_orderkey * 10 AS ts, CAST(floor(min(l_quantity) / 25) AS BIGINT) AS files, min(l_linenumber) % 2 AS dead, CASE WHEN min(l_discount) < 0.02 THEN NULL ELSE 1 + min(l_tax) / 10 END AS bus FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts) AS i FROM series)"""
_SAME = "n.ts - k.ts < 300 AND n.files = k.files AND n.dead = k.dead AND (n.bus IS NULL) = (k.bus IS NULL) AND (n.bus IS NULL OR abs((n.bus - k.bus) / k.bus) <= 0.01)"


@query(f"WITH RECURSIVE {_SERIES}, k AS (SELECT repo, i, ts, files, dead, bus, 1 AS line FROM n WHERE i = 1 UNION ALL SELECT n.repo, n.i, n.ts, n.files, n.dead, n.bus, line + CASE WHEN {_SAME} THEN 0 ELSE 1 END FROM k JOIN n ON n.repo = k.repo AND n.i = k.i + 1) SELECT repo, max(ts) AS ts, arg_max(files, i) AS files, CAST(arg_max(dead, i) AS BIGINT) AS dead, {r6('max_by(coalesce(bus, -1), i)')} AS bus FROM k GROUP BY repo, line")
def trend_collapse(t: Tables) -> DataFrame:
    """Of each series the rows that stand once those that say nothing new overwrote the last one; the twin folds row by row."""
    li = t.raw("lineitem")
    bus = F.when(F.min("l_discount") >= 0.02, 1 + F.min("l_tax") / 10)
    s = li.groupBy(F.col("l_suppkey").alias("repo"), (F.col("l_orderkey") * 10).alias("ts")).agg(F.floor(F.min("l_quantity") / 25).alias("files"), (F.min("l_linenumber") % 2).cast("long").alias("dead"), bus.alias("bus"))
    kept = trends.collapse(s, "repo", (("files", True, False), ("dead", True, False), ("bus", False, True)))
    return kept.select("repo", "ts", "files", "dead", round6(F.coalesce("bus", F.lit(-1.0))).alias("bus"))


# --- calls, search, evaluation ------------------------------------------------------------

_CONFIDENCE = "CASE l_linenumber % 4 WHEN 0 THEN 'inferred' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'extracted' END"


@query(f"WITH {SUPPLIER_PATHS}, c AS (SELECT path AS caller_file, 'f' || (l_partkey % 5) AS caller_symbol, 'g' || (l_partkey % 11) AS callee_symbol, coalesce({_CONFIDENCE}, 'extracted') AS confidence, l_orderkey, l_linenumber FROM lineitem JOIN spath ON l_suppkey = s_suppkey), x AS (SELECT caller_file, caller_symbol, callee_symbol, arg_max(confidence, struct_pack(a := l_orderkey, b := l_linenumber)) AS confidence FROM c GROUP BY 1, 2, 3) SELECT callee_symbol AS name, caller_file, caller_symbol, confidence FROM x WHERE confidence = 'inferred' AND callee_symbol IN ('g1', 'g5', 'g10')")
def callers_by_confidence(t: Tables) -> DataFrame:
    """Who calls some symbols, by edges of one confidence; of repeated edges the last one counts."""
    kind = F.when(F.col("l_linenumber") % 4 == 0, "inferred").when(F.col("l_linenumber") % 4 == 1, "ambiguous").when(F.col("l_linenumber") % 4 == 2, "extracted")
    c = t.raw("lineitem").join(t.supplier_paths(), F.col("l_suppkey") == F.col("s_suppkey"))
    c = c.select(F.col("path").alias("caller_file"), F.concat(F.lit("f"), F.col("l_partkey") % 5).alias("caller_symbol"), F.concat(F.lit("g"), F.col("l_partkey") % 11).alias("callee_symbol"), kind.alias("confidence"), "l_orderkey", "l_linenumber")
    names = t.spark.createDataFrame([("g1",), ("g5",), ("g10",)], "name string")
    return graph.callers_of(graph.call_index(c, "l_orderkey", "l_linenumber"), names, "inferred")


@query("SELECT n_nationkey AS repo, count(label) AS n_vectors, count(label) = 0 AS skipped FROM nation LEFT JOIN embeddings ON label = n_nationkey GROUP BY 1")
def cross_repo_status(t: Tables) -> DataFrame:
    """Registered repositories, and which of them a search skips as they have no vectors."""
    return search.searched_repos(t.embeddings(), t.raw("nation").select(F.col("n_nationkey").alias("repo")))


@query(f"WITH t AS (SELECT doc_id, source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0), p AS (SELECT doc_id, source FROM documents WHERE contains(text, '%%%') OR contains(text, ' | ')), g AS (SELECT source FROM t UNION SELECT source FROM p), x AS (SELECT t.source, t.doc_id, p.doc_id IS NOT NULL AS hit FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND t.source = p.source WHERE lang <> 'en') SELECT g.source, count(x.doc_id) AS n_source_truth, count(*) FILTER (hit) AS source_tp, {r6('CASE count(x.doc_id) WHEN 0 THEN 1.0 ELSE count(*) FILTER (hit) / CAST(count(x.doc_id) AS DOUBLE) END')} AS source_recall FROM g LEFT JOIN x ON g.source = x.source GROUP BY g.source")
def source_recall(t: Tables) -> DataFrame:
    """Recall over the true files that the index can hold."""
    d = t.raw("documents")
    truth = d.join(t.raw("labels").where("quality = 0").select("doc_id"), "doc_id").select("doc_id", "source", "lang")
    predicted = d.where("contains(text, '%%%') OR contains(text, ' | ')").select("doc_id", "source")
    return evals.source_recall(truth, predicted, ["doc_id", "source"], "source", F.col("lang") != "en").withColumn("source_recall", round6(F.col("source_recall")))


_EXTENSIONS = ["ts", "TSX", "Py", "md", "png", "svg", "WOFF2", "json", "go", "tar.gz", "h", ""]


@query(f"SELECT path, regexp_matches(path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|vue|py|rs|go|java|cs|rb|kt|kts|swift|php|dart|c|cpp|h)$') AS source, regexp_matches(path, '(?i)\\.(png|jpg|jpeg|gif|ico|webp|svg|pdf|zip|tar|gz|bz2|woff|woff2|ttf|otf|mp3|mp4|mov|wav)$') AS bin FROM (SELECT 'p' || p_partkey || CASE p_partkey % 12 WHEN 11 THEN '' ELSE '.' END || ({_EXTENSIONS})[1 + p_partkey % 12] AS path FROM part)")
def source_and_binary_files(t: Tables) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % 12).cast("int"))
    x = t.raw("part").select(F.concat(F.lit("p"), "p_partkey", F.when(F.col("p_partkey") % 12 == 11, "").otherwise("."), ext).alias("path"))
    return x.select("path", predicates.is_source("path").alias("source"), predicates.is_binary("path").alias("bin"))


@query("WITH w AS (SELECT DISTINCT regexp_extract(text, '^[^ .,]+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT DISTINCT w FROM w WHERE regexp_full_match(w, '[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}')) SELECT w AS word, CAST(row_number() OVER (ORDER BY w COLLATE en, w) AS INTEGER) AS place FROM x")
def words_in_locale_order(t: Tables) -> DataFrame:
    """First words of documents in the order people expect: accents and case count after letters."""
    word = F.regexp_extract("text", "^[^ .,]+", 0)
    x = t.raw("documents").where("text IS NOT NULL").select(word.alias("word")).where(F.col("word").rlike("^[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}$")).distinct()
    return numbered(x, [locale_order("word"), F.col("word")], "place").select("word", F.col("place").cast("int").alias("place"))


# --- links, pictures ----------------------------------------------------------------------

#: Links by the last digit of a part: target of dir<k>/link, and where dir<k>/link/f leads: null, if out of the root or in a loop.
_LINKS = [("../real", "real/f", "ok"), ("/abs/<k>", "abs/<k>/f", "ok"), ("../../out", None, "outside"), ("link", None, "loop"), ("../dir<k>/second", "real/f", "ok"), ("./sub/../../real/deep", "real/deep/f", "ok"), ("../ring<k>/a", None, "loop"), ("../dir<k>/via/x", "real/x/f", "ok")]


@query("SELECT 'dir' || p_partkey || '/link/f' AS path, replace(real, '<k>', CAST(p_partkey AS VARCHAR)) AS real, state FROM part JOIN (VALUES " + ", ".join(f"({k}, {'NULL' if r is None else repr(r)}, '{s}')" for k, (_, r, s) in enumerate(_LINKS)) + f") v(k, real, state) ON p_partkey % {len(_LINKS)} = k UNION ALL SELECT 'plain/' || p_partkey, 'plain/' || p_partkey, 'ok' FROM part")
def links_resolved(t: Tables) -> DataFrame:
    """Where paths lead once links are followed: through chains and folders, out of the root, and round in loops."""
    k = F.col("p_partkey").cast("string")
    target = F.replace(F.get(F.array(*(F.lit(x) for x, _, _ in _LINKS)), (F.col("p_partkey") % len(_LINKS)).cast("int")), F.lit("<k>"), k)
    row = lambda path, to: F.struct(path.alias("path"), to.alias("target"))
    in_dir = lambda name: F.concat(F.lit("dir"), k, F.lit(name))
    ring = lambda name: F.concat(F.lit("ring"), k, F.lit(name))
    links = t.raw("part").select(F.explode(F.array(row(in_dir("/link"), target), row(in_dir("/second"), F.lit("third")), row(in_dir("/third"), F.lit("/real")), row(in_dir("/via"), F.lit("../real")), row(ring("/a"), F.lit("b")), row(ring("/b"), F.lit("./a")))).alias("x")).select("x.*")
    paths = t.raw("part").select(F.explode(F.array(F.concat(F.lit("dir"), k, F.lit("/link/f")), F.concat(F.lit("plain/"), k))).alias("path"))
    return files.resolved_links(paths, links)


@query(f"""WITH {CHAIN_EDGES}, imp AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM edges GROUP BY 1), n AS (SELECT count(*) AS n, greatest(200.0, count(*) * 24.0 / (2 * pi())) AS r FROM nodes),
x AS (SELECT path, k AS a, CAST(floor(r + 120 + r * cos(2 * pi() * (k - 1) / n) + 0.5) AS BIGINT) AS x, CAST(floor(r + 120 + r * sin(2 * pi() * (k - 1) / n) + 0.5) AS BIGINT) AS y, coalesce(importers, 0) AS importers FROM (SELECT path, row_number() OVER (ORDER BY path) AS k FROM nodes) LEFT JOIN imp USING (path), n)
SELECT 0 AS ord, CAST(0 AS BIGINT) AS lno, '<svg xmlns="http://www.w3.org/2000/svg" width="' || CAST(floor(2 * r + 240) AS BIGINT) || '" height="' || CAST(floor(2 * r + 240) AS BIGINT) || '">' AS value FROM n
UNION ALL SELECT 1, s.a, '<line x1="' || s.x || '" y1="' || s.y || '" x2="' || d.x || '" y2="' || d.y || '" stroke="#889"/>' FROM edges JOIN x s ON src = s.path JOIN x d ON dst = d.path
UNION ALL SELECT 2, a, '<circle class="' || CASE WHEN importers >= 5 THEN 'hub' ELSE 'file' END || '" cx="' || x || '" cy="' || y || '" r="6"><title>' || path || ': ' || importers || ' importers</title></circle>' FROM x
UNION ALL SELECT 3, a, '<text x="' || x || '" y="' || (y + 16) || '" font-size="9">' || split_part(path, '/', 3) || '</text>' FROM x UNION ALL SELECT 4, 0, '</svg>'""")
def graph_svg(t: Tables) -> DataFrame:
    """The lines of a picture of the import graph."""
    e = t.chain_edges()
    return exports.svg(graph.nodes(e), e).select("ord", F.col("at").alias("lno"), "value")


# --- Python and other sources ---------------------------------------------------------------

_PY = 'import os.path\nfrom a<key>.b import c as d, e\n\n\n@deco(1)\nasync def f<key>(x: int):\n    """call(1)"""\n    return g<key>(x).run(h(os.getcwd()))  # no(2)\n\n\nclass C<key>(Base):\n    def m(self):\n        self.n<key>()\n\n\ntop<key>()\n'


def _python(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return t.part_keys().select(F.concat(F.lit("py/m"), key, F.lit(".py")).alias("path"), F.replace(F.lit(_PY), F.lit("<key>"), key).alias("content"))


@query("SELECT 'py/m' || p_partkey || '.py' AS path, type, replace(name, '<k>', CAST(p_partkey AS VARCHAR)) AS name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, m AS names FROM part, (VALUES ('import', 'os.path', 1, 1, 'os.path'), ('import', 'a<k>.b', 2, 2, 'd|e'), ('function', 'f<k>', 6, 8, ''), ('class', 'C<k>', 11, 13, 'def m(self)')) v(type, name, a, b, m)")
def python_nodes(t: Tables) -> DataFrame:
    return extract.definitions(_python(t)).select("path", "type", "name", "start_line", "end_line", F.array_join("methods", "|").alias("names"))


@query("SELECT 'py/m' || p_partkey || '.py' AS path, caller AS caller_symbol, replace(callee, '<k>', CAST(p_partkey AS VARCHAR)) AS callee_symbol, CAST(line AS BIGINT) AS line FROM (SELECT p_partkey, replace(caller, '<k>', CAST(p_partkey AS VARCHAR)) AS caller, callee, line FROM part, (VALUES ('f<k>', 'g<k>', 8), ('f<k>', 'run', 8), ('f<k>', 'h', 8), ('f<k>', 'getcwd', 8), ('m', 'n<k>', 13), ('', 'top<k>', 16)) v(caller, callee, line)) UNION ALL SELECT 'py/m' || p_partkey || '.py', 'f' || p_partkey, 'deco', 5 FROM part")
def python_calls(t: Tables) -> DataFrame:
    return extract.calls(_python(t))


@query("SELECT 'py/m' || p_partkey || '.py' AS path, 'f' || p_partkey AS caller_symbol, CAST(8 AS BIGINT) AS line FROM part")
def call_sites_of_symbol(t: Tables) -> DataFrame:
    """Where a symbol is called, in all files."""
    return extract.call_sites_of(extract.calls(_python(t)), "getcwd")


@query("SELECT 'web/p' || p_partkey || '.ts' AS src, spec || p_partkey AS specifier, CASE WHEN p_partkey % 2 = 0 THEN a ELSE b END || p_partkey || '.ts' AS dst FROM part, (VALUES ('~/lib/m', 'src/lib/m', 'alt/lib/m'), ('@/m', 'm', 'm')) v(spec, a, b)")
def alias_resolution(t: Tables) -> DataFrame:
    """Imports through a configuration's aliases: the first base that holds the file counts, @/ is the root."""
    k = F.col("p_partkey").cast("string")
    aliases = extract.tsconfig_aliases('{"compilerOptions": {"paths": {"~/*": ["src/*", "alt/*"]}}}')
    texts = t.part_keys().select(F.concat(F.lit("web/p"), k, F.lit(".ts")).alias("path"), F.concat(F.lit("import a from '~/lib/m"), k, F.lit("';\nimport b from '@/m"), k, F.lit("';")).alias("content"))
    there = t.raw("part").select(F.explode(F.array(F.concat(F.when(F.col("p_partkey") % 2 == 0, "src/lib/m").otherwise("alt/lib/m"), k, F.lit(".ts")), F.concat(F.lit("m"), k, F.lit(".ts")))).alias("path"))
    return extract.resolve_aliases(extract.raw_imports(texts), t.spark.createDataFrame(aliases, "prefix string, base string"), there)


@query("WITH f AS (SELECT p_brand AS d, p_partkey AS k FROM part) SELECT DISTINCT 'cmd/' || a.k || '.go' AS src, b.d || '/' || b.k || '.go' AS dst FROM f a JOIN f b ON a.d = b.d WHERE a.k % 10 = 0 AND b.k % 3 <> 0")
def go_package_edges(t: Tables) -> DataFrame:
    """An import of a package leads to all its files but tests."""
    p = t.raw("part").select(F.col("p_brand").alias("d"), F.col("p_partkey").alias("k"))
    there = p.select(F.concat("d", F.lit("/"), "k", F.when(F.col("k") % 3 == 0, "_test.go").otherwise(".go")).alias("path"))
    texts = p.where("k % 10 = 0").select(F.concat(F.lit("cmd/"), "k", F.lit(".go")).alias("path"), F.concat(F.lit('package main\n\nimport (\n\t"fmt"\n\t"example.org/m/'), "d", F.lit('"\n)\n')).alias("content"))
    return extract.go_edges(extract.raw_imports(texts), there, "example.org/m")


@query("WITH c AS (SELECT p_brand AS d, p_partkey AS k, p_partkey % 3 <> 0 AS code, p_partkey % 4 = 0 AS test FROM part), t AS (SELECT d || '/' || k || '_test.go' AS t, d || '/' || k || '.go' AS own, code, d FROM c WHERE test), l AS (SELECT t AS src, own AS dst FROM t WHERE code UNION SELECT t, c.d || '/' || c.k || '.go' FROM t JOIN c ON t.d = c.d WHERE NOT t.code AND c.code) SELECT src, dst FROM l UNION SELECT dst, src FROM l")
def go_test_edges(t: Tables) -> DataFrame:
    """Tests and the files they test, both ways; a test without a file of its own goes with all files of its folder."""
    p = t.raw("part").select(F.concat("p_brand", F.lit("/"), "p_partkey").alias("stem"), F.col("p_partkey").alias("k"))
    there = p.where("k % 3 <> 0").select(F.concat("stem", F.lit(".go")).alias("path")).union(p.where("k % 4 = 0").select(F.concat("stem", F.lit("_test.go"))))
    return extract.go_test_links(there)


# --- streams --------------------------------------------------------------------------------


def _stream(t: Tables) -> DataFrame:
    """The events as a stream of files."""
    at = _place(t, "events")
    t.telemetry().select("event_id", "ts", "user_id", "tool").repartition(4, "user_id").write.parquet(at)
    return t.spark.readStream.schema("event_id long, ts timestamp, user_id long, tool string").option("maxFilesPerTrigger", 2).parquet(at)


def _ended(t: Tables, out: DataFrame, mode: str) -> DataFrame:
    """What a stream has given once its input is through: its last whole result, or all that it added."""
    at, schema = _place(t, "streamed"), out.schema

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(at)

    out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", _place(t, "streaming")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(at)


@query(f"WITH {TELEMETRY} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS breaches FROM tele GROUP BY 1")
def stream_breaches_by_day(t: Tables) -> DataFrame:
    """Tumbling days over a stream."""
    return _ended(t, jobs.breaches_by_day(_stream(t)), "complete")


@query(f"WITH {TELEMETRY}, d AS (SELECT tool, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS a FROM tele, range(14) r(k)) SELECT strftime(a, '%Y-%m-%d') AS since, tool, count(*) AS calls FROM d GROUP BY 1, 2")
def stream_sliding(t: Tables) -> DataFrame:
    """Windows of fourteen days, one each day, over a stream."""
    return _ended(t, jobs.sliding(_stream(t)), "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("since"), "tool", "calls")


_TASKS = f"{TELEMETRY}, f AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 * 12 AS INT), 0) AS fresh FROM tele), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)"


@query(f"WITH {_TASKS} SELECT user_id, event_id, CAST(4 AS BIGINT) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS place FROM s) WHERE place = 4")
def stream_task_budget(t: Tables) -> DataFrame:
    """The call of each session that first goes over the limit, by state on a stream. A user's events lie in one file."""
    return _ended(t, jobs.task_budget(_stream(t), 12 * 3600, 3, "10000 days"), "append")


@query(f"WITH {TELEMETRY}, f AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 * 6 AS INT), 0) AS fresh FROM tele), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f) SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS calls FROM s GROUP BY user_id, session")
def session_windows(t: Tables) -> DataFrame:
    """Session windows; a gap of exactly the limit ends a session here, as windows are half open."""
    return jobs.session_windows(t.telemetry(), "6 hours").select("user_id", micros("session_window.start").alias("began"), "calls")


# --- change risk ------------------------------------------------------------------------------

_NAMED = "CASE k % 7 WHEN 0 THEN 'm' || k || 'x.md' WHEN 1 THEN 'm' || (k + 1) || 'x.test.ts' ELSE 'm' || k || 'x.ts' END"


@query(f"""WITH {CHAIN_EDGES}, n AS (SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || {_NAMED} AS name, k FROM (SELECT path, CAST(split_part(path, '/', 3) AS BIGINT) AS k FROM nodes)),
i AS (SELECT dst AS path, count(DISTINCT src) AS importers, bool_or(s.k % 7 = 1) AS tested FROM edges JOIN n s ON src = s.path GROUP BY 1),
x AS (SELECT name, coalesce(importers, 0) AS importers, k % 7 IN (0, 1) AS aside, k % 7 IN (0, 1) OR coalesce(tested, false) OR (k % 7 = 2 AND k - 1 IN (SELECT k FROM n)) AS covered FROM n LEFT JOIN i USING (path))
SELECT name AS path, importers, covered, CASE WHEN aside AND importers >= 5 THEN 'high' WHEN aside THEN 'low' WHEN importers >= 5 AND NOT covered THEN 'critical' WHEN importers >= 5 OR (NOT covered AND importers > 2) THEN 'high' WHEN NOT covered THEN 'medium' WHEN importers > 2 THEN 'medium' ELSE 'low' END AS level FROM x""")
def change_risk_of_all(t: Tables) -> DataFrame:
    """Every file of the sparse graph, with tests, documents and sources by their names: all levels occur."""
    part, k = (lambda c, i: F.split_part(c, F.lit("/"), F.lit(i))), (lambda c: F.split_part(c, F.lit("/"), F.lit(3)).cast("long"))

    def named(c: str):
        key = k(F.col(c))
        file = F.when(key % 7 == 0, F.concat(F.lit("m"), key, F.lit("x.md"))).when(key % 7 == 1, F.concat(F.lit("m"), key + 1, F.lit("x.test.ts"))).otherwise(F.concat(F.lit("m"), key, F.lit("x.ts")))
        return F.concat_ws("/", part(F.col(c), 1), part(F.col(c), 2), file)

    e = cut(t.chain_edges().select(named("src").alias("src"), named("dst").alias("dst")), "named")
    return risk.change_risk(graph.nodes(e), e)
