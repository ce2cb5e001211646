"""File trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.predicates import is_ignored
from repolith.operators.extract import LANGUAGES
from repolith.operators.lineage import cut

MOST_BYTES = 5 * 1024 * 1024
# Fixed names.
RULE_FILES = ("CLAUDE.md", "AGENTS.md", ".cursorrules", "CONVENTIONS.md", "CONTRIBUTING.md", "ARCHITECTURE.md")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(LANGUAGES), most_bytes: int = MOST_BYTES) -> DataFrame:
    """path (from root), ext, size, content of source files: no ignored directory on the way, not too large, not blank. Read by Spark, so root may be in any store."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?/*", "/"), "^" + _quoted(_local(root)) + "/?", "")
    f = raw.where(F.col("length") <= most_bytes).select(rel.alias("path"), F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1).alias("ext"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    return f.where(F.col("ext").isin(*extensions) & ~is_ignored(F.col("path")) & (F.trim("content") != ""))


def _local(root: str) -> str:
    import re

    return re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?/*", "/", root).rstrip("/")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s)


def inside(paths: DataFrame, root: str) -> DataFrame:
    """Adds safe: whether a path stays within root once . and .. are gone."""
    from repolith.operators.extract import normal_path

    return paths.withColumn("normal", normal_path(F.col("path"))).withColumn("safe", F.col("normal").isNotNull() & ~F.col("path").startswith("/")).drop("normal") if not root else paths.withColumn("safe", F.col("path").startswith(root.rstrip("/") + "/") & normal_path(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")).isNotNull())


def resolved_links(paths: DataFrame, links: DataFrame, most_hops: int = 40) -> DataFrame:
    """path, real, state of paths under a root once symbolic links (path, target) are followed; a target may be relative to its link's
    folder, or from the root with a leading slash. state: ok, outside (the way leaves the root; real is null), loop (more hops than
    a file system allows; real is null). Links that lead to links are shortened first by pointer doubling."""
    from repolith.operators.extract import directory, normal_path

    aimed = F.when(F.col("target").startswith("/"), F.substring("target", 2, 1 << 30)).otherwise(F.concat(directory(F.col("path")), F.lit("/"), F.col("target")))
    table = links.select("path", aimed.alias("to"), F.lit(1).cast("long").alias("hops")).withColumn("to", normal_path(F.col("to")))
    # Links may be made out of few rows, and their texts are far shorter in files than in memory: by such sizes Spark would send all of them
    # through the driver. So they are written first, and the joins of links go by shuffles.
    table = cut(table, "links")
    rounds = max(1, (most_hops - 1).bit_length())
    for _ in range(rounds):
        further = table.toDF("__path", "__to", "__hops")
        table = cut(table.join(further.hint("merge"), table["to"] == further["__path"], "left").select("path", F.when(F.col("__path").isNull(), F.col("to")).otherwise(F.col("__to")).alias("to"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops")), "links", table)
    # A path's shortest leading part that is a link is followed first, as a file system does.
    now = paths.select("path").distinct().select("path", normal_path(F.col("path")).alias("real"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("open"))
    now, k = cut(now, "paths"), 0
    while k <= most_hops:
        going = now.where("open AND real IS NOT NULL")
        parts = F.split("real", "/")
        heads = going.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("n", "head"))
        hit = heads.join(table.toDF("head", "to", "more").hint("merge"), "head").groupBy("path").agg(F.min_by(F.struct("head", "to", "more"), "n").alias("x"))
        if hit.isEmpty():
            break
        rest = F.expr("substring(real, length(x.head) + 1)")
        # A link that came round to itself has more hops than any way may have.
        moved = now.join(hit.hint("merge"), "path", "left").select(
            "path", F.when(F.col("x").isNull(), F.col("real")).otherwise(normal_path(F.concat("x.to", rest))).alias("real"), (F.col("hops") + F.coalesce("x.more", F.lit(0))).alias("hops"), F.col("x").isNotNull().alias("open")
        )
        now, k = cut(moved.withColumn("open", F.col("open") & (F.col("hops") <= most_hops)), "paths", now), k + 1
    loop = F.col("hops") > most_hops
    return now.select("path", F.when(~loop, F.col("real")).alias("real"), F.when(loop, "loop").when(F.col("real").isNull(), "outside").otherwise("ok").alias("state"))


def rule_files(files: DataFrame, names: tuple[str, ...] = RULE_FILES) -> DataFrame:
    """Rule and context files by base name, and all files of rule directories."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.where(base.isin(*names) | F.col("path").rlike(r"(^|/)\.(cursor|agents?)/rules/"))


def manifest(files: DataFrame) -> DataFrame:
    """path and content hash: what tells whether a snapshot is stale."""
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two manifests."""
    both = old.select("path", F.col("sha256").alias("o")).join(new.select("path", F.col("sha256").alias("n")), "path", "full").where("NOT (o <=> n)")
    return both.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))
