"""The engine's tables over the driver's: files, commits, imports, symbols, calls, telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.time import seconds
from repolith.operators.lineage import spread


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def supplier_paths(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select("s_suppkey", F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"))

    def part_paths(self) -> DataFrame:
        return self.raw("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))

    def part_keys(self) -> DataFrame:
        """p_partkey, dealt over tasks: what is made of a part costs far more than its key."""
        return spread(self.raw("part").select("p_partkey"), "p_partkey")

    def commits(self) -> DataFrame:
        """sha, author, ts (seconds), message, is_merge."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), seconds("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("message"), (F.col("o_orderstatus") == "P").alias("is_merge"),
        )

    def commit_files(self) -> DataFrame:
        """sha, path, added, deleted."""
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber").join(self.supplier_paths(), F.col("l_suppkey") == F.col("s_suppkey"))
        return li.groupBy(F.col("l_orderkey").alias("sha"), "path").agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))

    def next_parts(self) -> DataFrame:
        """Every line: its order, part and supplier, and the part and supplier of the next line."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("s"), "l_suppkey", F.lead("l_partkey").over(w).alias("d"), F.lead("l_suppkey").over(w).alias("next_supp"))

    def edges(self) -> DataFrame:
        """src, dst: a part imports the next part of each of its orders. A path ends in its part's key, so that pairs of keys are
        made distinct, which are smaller than pairs of paths."""
        paths = self.part_paths().distinct()
        x, a, b = self.next_parts().where("s != d").select("s", "d").distinct(), paths.toDF("s", "src"), paths.toDF("d", "dst")
        return x.join(a, "s").join(b, "d").select("src", "dst")

    def chain_edges(self) -> DataFrame:
        """src, dst: a part imports the part behind it in its first and in its latest order. A sparse graph out of all lines."""
        x, a, b = self.next_parts().where("s != d"), self.part_paths().toDF("s", "src"), self.part_paths().toDF("d", "dst")
        at = F.struct("l_orderkey", "d")
        ends = x.groupBy("s").agg(F.array(F.min(at)["d"], F.max(at)["d"]).alias("ds")).select("s", F.explode("ds").alias("d"))
        return ends.join(a, "s").join(b, "d").select("src", "dst").distinct()

    def supplier_ends(self) -> DataFrame:
        """key, is_call, first, last (l_orderkey, a, b): what the edges and calls of suppliers are made of, in one pass over the lines. An edge
        goes by its supplier to the next one (a), a call by the called part to the calling part (a) and supplier (b)."""
        row = lambda is_call, key, a, b: F.struct(F.col(key).alias("key"), F.lit(is_call).alias("is_call"), F.col(a).alias("a"), b.alias("b"))
        edge = F.when(F.expr("l_suppkey != next_supp"), row(False, "l_suppkey", "next_supp", F.lit(None).cast("long")))
        call = F.when(F.expr("d IS NOT NULL"), row(True, "d", "s", F.col("l_suppkey")))
        x = self.next_parts().select("l_orderkey", F.explode(F.array(edge, call)).alias("r")).where("r IS NOT NULL")
        at = F.struct("l_orderkey", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
        return x.groupBy("r.key", "r.is_call").agg(F.min(at).alias("first"), F.max(at).alias("last"))

    def supplier_edges(self, ends: DataFrame | None = None) -> DataFrame:
        """src, dst: the same between suppliers, the files of the history."""
        ends = self.supplier_ends() if ends is None else ends
        ends = ends.where("NOT is_call").select(F.col("key").alias("l_suppkey"), F.explode(F.array("first.a", "last.a")).alias("next_supp"))
        a, b = self.supplier_paths().toDF("l_suppkey", "src"), self.supplier_paths().toDF("next_supp", "dst")
        return ends.join(a, "l_suppkey").join(b, "next_supp").select("src", "dst").distinct()

    def commit_nodes(self, nodes: DataFrame) -> DataFrame:
        """commit_files() by numbers of paths (nodes: s_suppkey, node), dealt by commit: what comes after by commit shuffles nothing."""
        li = self.raw("lineitem").join(nodes, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("sha"), F.col("node").alias("path"), "l_quantity", "l_linenumber")
        return li.repartition("sha").groupBy("sha", "path").agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))

    def supplier_symbols(self) -> DataFrame:
        """name, path, type: a part is defined by the supplier of its latest line."""
        last = self.raw("lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"].alias("s_suppkey"))
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
        return last.join(parts, "l_partkey").join(self.supplier_paths(), "s_suppkey").select("name", "path", F.lit("function").alias("type"))

    def supplier_calls(self, ends: DataFrame | None = None) -> DataFrame:
        """caller_file, caller_symbol, callee_symbol: a supplier's line calls the next line's part, in the part's first order."""
        ends = self.supplier_ends() if ends is None else ends
        x = ends.where("is_call").select(F.col("key").alias("d"), F.col("first.a").alias("s"), F.col("first.b").alias("s_suppkey"))
        names = self.raw("part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
        joined = x.join(self.supplier_paths(), "s_suppkey").join(names.toDF("s", "caller_symbol"), "s").join(names.toDF("d", "callee_symbol"), "d")
        return joined.select(F.col("path").alias("caller_file"), "caller_symbol", "callee_symbol").distinct()

    def supplier_vectors(self) -> DataFrame:
        """path, vector of the suppliers that have an embedding under their key."""
        return self.raw("embeddings").join(self.supplier_paths(), F.col("vec_id") == F.col("s_suppkey")).select("path", F.col("embedding").alias("vector"))

    def symbols(self) -> DataFrame:
        """name, path, type, start_line, end_line."""
        kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "class").otherwise("method")
        return self.raw("part").select(
            F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"), kind.alias("type"),
            F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + F.floor(F.col("p_retailprice") / 10)).cast("long").alias("end_line"),
        )

    def calls(self) -> DataFrame:
        """caller_file, caller_symbol, callee_symbol: a line's part calls the next line's."""
        x, s = self.next_parts().where("d is not null"), self.supplier_paths()
        names = self.raw("part").select("p_partkey", "p_name")
        joined = x.join(s, x.l_suppkey == s.s_suppkey).join(names.toDF("s", "caller_symbol"), "s").join(names.toDF("d", "callee_symbol"), "d")
        return joined.select(F.col("path").alias("caller_file"), "caller_symbol", "callee_symbol").distinct()

    def files(self) -> DataFrame:
        return self.raw("documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))

    def telemetry(self) -> DataFrame:
        return self.raw("events").select("event_id", "ts", "user_id", F.col("event_type").alias("tool"), F.col("value").alias("original_tokens"))

    def embeddings(self) -> DataFrame:
        """path (the id), vector, repo (the label)."""
        return self.raw("embeddings").select(F.col("vec_id").alias("path"), F.col("embedding").alias("vector"), F.col("label").alias("repo"))


#: The same views in SQL, as named parts of a WITH clause.
PART_PATHS = "ppath AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, p_name FROM part)"
SUPPLIER_PATHS = "spath AS (SELECT s_suppkey, r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
NEXT_PARTS = "nxt AS (SELECT l_orderkey, l_partkey AS s, l_suppkey, lead(l_partkey) OVER w AS d, lead(l_suppkey) OVER w AS next_supp FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"
EDGES = f"{PART_PATHS}, {NEXT_PARTS}, edges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM nxt JOIN ppath a ON s = a.p_partkey JOIN ppath b ON d = b.p_partkey WHERE s <> d), nodes AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges)"
_ENDS = "SELECT s, min(struct_pack(a := l_orderkey, b := d)).b AS d FROM nxt WHERE s <> d GROUP BY s UNION SELECT s, max(struct_pack(a := l_orderkey, b := d)).b FROM nxt WHERE s <> d GROUP BY s"
CHAIN_EDGES = f"{PART_PATHS}, {NEXT_PARTS}, edges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM ({_ENDS}) JOIN ppath a ON s = a.p_partkey JOIN ppath b ON d = b.p_partkey), nodes AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges)"
SUPPLIER_EDGES = f"{NEXT_PARTS}, sedges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM (" + _ENDS.replace("s <> d", "l_suppkey <> next_supp").replace("SELECT s,", "SELECT l_suppkey,").replace("b := d", "b := next_supp").replace("GROUP BY s", "GROUP BY l_suppkey") + ") x JOIN spath a ON x.l_suppkey = a.s_suppkey JOIN spath b ON x.d = b.s_suppkey)"
SUPPLIER_SYMBOLS = "ssymbols AS (SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, path FROM (SELECT l_partkey, max(struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)).c AS k FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey JOIN spath ON k = s_suppkey)"
SUPPLIER_CALLS = "scalls AS (SELECT DISTINCT path AS caller_file, b.p_name || ' ' || CAST(b.p_partkey AS VARCHAR) AS callee_symbol FROM (SELECT d, min(struct_pack(a := l_orderkey, b := s, c := l_suppkey)) AS x FROM nxt WHERE d IS NOT NULL GROUP BY d) JOIN spath ON x.c = s_suppkey JOIN part b ON d = b.p_partkey)"
COMMITS = "commits AS (SELECT o_orderkey AS sha, o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS message, o_orderstatus = 'P' AS is_merge FROM orders)"
COMMIT_FILES = f"{SUPPLIER_PATHS}, commit_files AS (SELECT l_orderkey AS sha, path, CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem JOIN spath ON l_suppkey = s_suppkey GROUP BY l_orderkey, path)"
HISTORY = f"{COMMITS}, {COMMIT_FILES}, touches AS (SELECT * FROM commits JOIN commit_files USING (sha))"
SYMBOLS = "symbols AS (SELECT p_name AS name, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS type, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + floor(p_retailprice / 10) AS BIGINT) AS end_line FROM part)"
CALLS = f"{SUPPLIER_PATHS}, calls AS (SELECT DISTINCT x.path AS caller_file, a.p_name AS caller_symbol, b.p_name AS callee_symbol FROM nxt JOIN spath x ON nxt.l_suppkey = x.s_suppkey JOIN part a ON s = a.p_partkey JOIN part b ON d = b.p_partkey)"
FILES = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents)"
TELEMETRY = "tele AS (SELECT event_id, ts, user_id, event_type AS tool, value AS original_tokens FROM events)"
