"""Vector, full-text and name search; rename preview."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.lineage import count


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """query, path, distance, rk: the k nearest of each query. Ties go by path.

    Each task keeps its own k nearest a query, found by one matrix product a
    batch, so that only k rows a query and task are shuffled.
    """
    qs = queries.select("query", "q").collect()  # the caller's queries
    ids, mat = [r["query"] for r in qs], np.array([r["q"] for r in qs], np.float64)
    kinds = [queries.schema["query"].dataType.simpleString(), vectors.schema["path"].dataType.simpleString()]
    arrow = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds] + [pa.float64()]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            paths = batch.column(0).to_pylist()
            if not paths:
                continue
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(paths), -1)
            # Differences, not the expanded product: near-equal distances keep their order.
            for j, q in enumerate(mat):
                if metric == "l2":
                    d = np.cumsum((x - q) ** 2, axis=1)[:, -1]
                else:
                    d = 1 - np.cumsum(x * q, axis=1)[:, -1] / (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) * np.sqrt((q * q).sum()))
                least = np.argpartition(d, min(k, len(d)) - 1)[:k]
                edge = np.flatnonzero(d <= d[least].max())
                best[j] = sorted([*best[j], *((float(d[i]), paths[i]) for i in edge)])[:k]
        rows = [(ids[j], p, d) for j, b in enumerate(best) for d, p in b]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow, strict=True)], names=["query", "path", "distance"])

    found = vectors.select("path", "vector").mapInArrow(near, f"query {kinds[0]}, path {kinds[1]}, distance double")
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("query").orderBy("distance", "path"))).where(F.col("rk") <= k)


def hybrid_search(hits: DataFrame, edges: DataFrame, limit: int = 10, step: float = 0.1) -> DataFrame:
    """path, score, via: hits (path, distance) and their imports and importers at the hit's distance and a step, where no hit. The nearest hit counts."""
    h = hits.select("path", F.col("distance").alias("score"))
    ways = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = h.join(ways, h["path"] == ways["src"]).groupBy(F.col("dst").alias("path")).agg((F.min("score") + step).alias("score")).join(h, "path", "left_anti")
    return h.withColumn("via", F.lit("vector")).unionByName(near.withColumn("via", F.lit("graph"))).orderBy("score", "path").limit(limit)


def similar_files(vectors: DataFrame, path, k: int = 5) -> DataFrame:
    seed = vectors.where(F.col("path") == path).select(F.col("path").alias("query"), F.col("vector").alias("q"))
    return knn(vectors, seed, k + 1).where(F.col("path") != path).select("path", "distance").orderBy("distance", "path").limit(k)


def semantic_arm(vectors: DataFrame, seeds: DataFrame, static: DataFrame, per_seed: int = 15, below: float = 0.5, keep: int = 10) -> DataFrame:
    """path, distance: neighbours of the seeds' stored vectors that neither the seeds nor static have, the least distance of each."""
    q = vectors.join(seeds.select("path"), "path", "left_semi").select(F.col("path").alias("query"), F.col("vector").alias("q"))
    near = knn(vectors, q, per_seed).join(seeds.select("path"), "path", "left_anti").join(static.select("path"), "path", "left_anti")
    return near.where(F.col("distance") < below).groupBy("path").agg(F.min("distance").alias("distance")).orderBy("distance", "path").limit(keep)


def cross_repo(vectors: DataFrame, query: DataFrame, limit: int = 10) -> DataFrame:
    """repo, path, distance: the max(limit, 5) nearest of each repository, merged. Each task keeps so many rows a repository before
    anything is shuffled, as the rank's bound is pushed below the exchange."""
    d = vectors.join(F.broadcast(query.select("q").limit(1))).select("repo", "path", squared_l2("vector", "q").alias("distance"))
    w = Window.partitionBy("repo").orderBy("distance", "path")
    return d.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max(limit, 5)).orderBy("distance", "path").limit(limit).select("repo", "path", "distance")


def searched_repos(vectors: DataFrame, repos: DataFrame) -> DataFrame:
    """repo, n_vectors, skipped of each registered repository (repo): one without vectors is skipped."""
    n = vectors.groupBy("repo").agg(count().alias("n_vectors"))
    return repos.select("repo").distinct().join(n, "repo", "left").na.fill(0, ["n_vectors"]).withColumn("skipped", F.col("n_vectors") == 0)


def fulltext(files: DataFrame, query: str, limit: int = 20, regex: bool = False, context: int = 1, snippets: int = 3) -> DataFrame:
    """path, matches, snippet: lines that match, most first; the first few with lines around them. Rows stay whole: no line is shuffled."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    hit = (lambda x: x.rlike(query)) if regex else (lambda x: F.contains(F.lower(x), F.lit(query.lower())))
    f = files.where(F.col("content").rlike(query) if regex else F.contains(F.lower("content"), F.lit(query.lower())))
    at = F.filter(F.transform(lines, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    f = f.select("path", lines.alias("lines"), at.alias("at")).withColumn("matches", F.size("at").cast("long")).where("matches > 0")
    piece = lambda i: F.array_join(F.slice("lines", F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context)) + 1 + context), "\n")
    return f.select("path", "matches", F.array_join(F.transform(F.slice("at", 1, snippets), piece), "\n--\n").alias("snippet")).orderBy(F.desc("matches"), "path").limit(limit)


def fulltext_hybrid(files: DataFrame, text: str, vectors: DataFrame, query: DataFrame, limit: int = 20) -> DataFrame:
    """path, matches, score: files by their number of matches, and behind them half as many nearest vectors, at their distance and 2."""
    words = fulltext(files, text, limit).select("path", "matches", (-F.col("matches")).cast("double").alias("score"))
    near = knn(vectors, query, -(-limit // 2)).select("path", F.lit(0).cast("long").alias("matches"), (F.col("distance") + 2).alias("score"))
    return words.unionByName(near.join(words.select("path"), "path", "left_anti")).orderBy("score", "path").limit(limit)


def rename_preview(files: DataFrame, old: str, new: str) -> DataFrame:
    """path, line, before, after for each line with the whole word."""
    word = rf"\b{old}\b"
    f = files.where(F.col("content").rlike(word)).select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "before")).where(F.col("before").rlike(word))
    return f.select("path", (F.col("i") + 1).cast("long").alias("line"), "before", F.regexp_replace("before", word, new).alias("after"))


def apply_rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """path, content, occurrences of the files that change."""
    word = rf"\b{old}\b"
    return files.where(F.col("content").rlike(word)).select("path", F.regexp_replace("content", word, new).alias("content"), F.regexp_count("content", F.lit(word)).cast("long").alias("occurrences"))


def fuzzy_alias(names: DataFrame, wanted: str, most: int = 3, k: int = 5) -> DataFrame:
    return names.select("name", F.levenshtein("name", F.lit(wanted)).alias("distance")).where(F.col("distance") <= most).distinct().orderBy("distance", "name").limit(k)


def discrimination(pairs: DataFrame) -> DataFrame:
    """pairs: a, b (vectors), similar. Mean cosine of similar and of different pairs, and their gap."""
    c = pairs.select("similar", cosine("a", "b").alias("c"))
    return c.agg(F.avg(F.when(F.col("similar"), F.col("c"))).alias("sim"), F.avg(F.when(~F.col("similar"), F.col("c"))).alias("diff"), count().alias("n")).select("sim", "diff", (F.col("sim") - F.col("diff")).alias("gap"), "n")


def upsert_vectors(old: DataFrame, new: DataFrame, longest: int = 512) -> DataFrame:
    """The table with new's paths replaced; content is cut."""
    new = new.withColumn("content", F.substring("content", 1, longest))
    return old.join(new.select("path"), "path", "left_anti").unionByName(new)


def remove_vectors(table: DataFrame, paths: DataFrame) -> DataFrame:
    """The table without the rows of exactly these paths (path)."""
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def vector_of(table: DataFrame, path: str) -> DataFrame:
    """vector of one path; no row where there is none."""
    return table.where(F.col("path") == path).select("vector")


def count_vectors(table: DataFrame) -> DataFrame:
    return table.agg(count().alias("n"))
