"""Versioned tables: graph and overlay snapshots, vectors; the repository registry; configuration."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions under root, oldest first. A version counts once its marker is there."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    Path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if n.startswith("v=") and fs.exists(Path(f"{root}/{n}/_COMPLETE")))


def save(tables: dict[str, DataFrame], root: str, meta: dict[str, str] | None = None) -> str:
    """Writes tables as a new version; readers see it whole or not at all."""
    spark = next(iter(tables.values())).sparkSession
    at = f"{root}/v={time.time_ns():020d}"
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    spark.createDataFrame(list((meta or {}).items()) + [("format", str(FORMAT_VERSION))], "key string, value string").coalesce(1).write.parquet(f"{at}/_meta_rows")
    fs, p = _fs(spark, f"{at}/_COMPLETE")
    fs.create(p).close()
    return at


def meta(spark: SparkSession, root: str) -> dict[str, str] | None:
    """What the newest version says of itself; None where there is none."""
    have = versions(spark, root)
    return {r.key: r.value for r in spark.read.parquet(f"{root}/{have[-1]}/_meta_rows").collect()} if have else None


def load(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the newest version, or of an index that is kept there; None where there is none, or where it has another format: it is to be built anew then."""
    from repolith.sources import index

    if index.present(spark, root):
        return index.CodeIndex(spark, root).read(name)
    have = versions(spark, root)
    if not have or meta(spark, root).get("format") != str(FORMAT_VERSION):
        return None
    return spark.read.parquet(f"{root}/{have[-1]}/{name}")


def stale(spark: SparkSession, root: str, writer: str | None, n_files: int) -> bool:
    """Whether a snapshot is to be built anew: none, of another format, by an older or unknown writer, or of another number of files."""
    said = meta(spark, root)
    return said is None or said.get("format") != str(FORMAT_VERSION) or compare_versions(said.get("writer"), writer) in ("older", "unknown") or said.get("n_files") != str(n_files)


def save_overlay(commits: DataFrame, pairs: DataFrame, owners: DataFrame, root: str, last_sha: str) -> str:
    """The three indices of the history and the commit they reach, as one version."""
    return save({"commits": commits, "pairs": pairs, "owners": owners}, root, {"last_sha": last_sha})


def load_overlay(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], str] | None:
    tables = {name: load(spark, root, name) for name in ("commits", "pairs", "owners")}
    return None if any(t is None for t in tables.values()) else (tables, meta(spark, root)["last_sha"])


def compact(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the newest versions; returns how many."""
    old = versions(spark, root)[:-keep]
    for v in old:
        fs, p = _fs(spark, f"{root}/{v}")
        fs.delete(p, True)
    return len(old)


def save_named_graph(edges: DataFrame, root: str, name: str, saved_at: int) -> None:
    """A named snapshot: its edges in a partition of their own."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", name):
        raise ValueError("a snapshot's name has letters, digits, dots, dashes and underscores")
    edges.select("src", "dst").withColumn("saved_at", F.lit(saved_at).cast("long")).write.mode("overwrite").parquet(f"{root}/snapshot={name}")


def named_graphs(spark: SparkSession, root: str) -> DataFrame:
    """snapshot, saved_at, nodes, edges of each."""
    e = spark.read.option("basePath", root).parquet(f"{root}/snapshot=*")
    n = e.select("snapshot", F.explode(F.array("src", "dst")).alias("p")).groupBy("snapshot").agg(F.countDistinct("p").alias("nodes"))
    return e.groupBy("snapshot").agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("edges")).join(n, "snapshot")


def compare_versions(mine: str | None, theirs: str | None) -> str:
    """older, newer, same or unknown for dotted triples; dev is newer than any release."""
    if mine == theirs and mine is not None:
        return "same"
    parse = lambda v: tuple(map(int, m.groups())) if v and (m := re.match(r"^(\d+)\.(\d+)\.(\d+)", v)) else None
    if mine == "dev" or theirs == "dev":
        return "unknown" if not mine or not theirs else "newer" if mine == "dev" else "older"
    a, b = parse(mine), parse(theirs)
    return "unknown" if a is None or b is None else "older" if a < b else "newer" if a > b else "same"


ALIAS = re.compile(r"^[a-z0-9][a-z0-9._-]{0,63}$")


def register_repo(repos: list[dict], root: str, alias: str | None, now: int) -> list[dict]:
    """The registry with one repository more or renewed; an alias belongs to one root."""
    if alias and not ALIAS.match(alias):
        raise ValueError(f"bad alias: {alias}")
    if alias and any(r["alias"] == alias and r["root"] != root for r in repos):
        raise ValueError(f"alias in use: {alias}")
    return [r for r in repos if r["root"] != root] + [{"root": root, "name": root.rstrip("/").rsplit("/", 1)[-1], "alias": alias, "registered_at": now}]


def unregister_repo(repos: list[dict], what: str) -> list[dict]:
    """The registry without the repository of this alias, root or name."""
    gone = find_repo(repos, what)
    return [r for r in repos if r is not gone]


REPO_SCHEMA = "root string, name string, alias string, registered_at long"


def save_registry(spark: SparkSession, repos: list[dict], root: str) -> str:
    return save({"repos": spark.createDataFrame([(r["root"], r["name"], r["alias"], r["registered_at"]) for r in repos], REPO_SCHEMA).coalesce(1)}, root)


def load_registry(spark: SparkSession, root: str) -> list[dict]:
    """As many rows as repositories were registered."""
    t = load(spark, root, "repos")
    return [] if t is None else [r.asDict() for r in t.orderBy("registered_at", "root").collect()]


def author_map(text: str) -> dict[str, str]:
    """email -> handle from YAML with a mapping `authors`; emails in lower case."""
    import yaml

    authors = (yaml.safe_load(text) or {}).get("authors") or {}
    if not isinstance(authors, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in authors.items()):
        raise ValueError("authors maps emails to handles")
    return {k.strip().lower(): v for k, v in authors.items()}


def find_repo(repos: list[dict], what: str) -> dict | None:
    return next((r for r in repos if what in (r["alias"], r["root"], r["name"])), None)


def load_rules(spark: SparkSession, text: str) -> DataFrame:
    """name, severity, from_re, to_re from YAML with a list `rules` of name, type no-import, from, to, severity (error or warn)."""
    import yaml

    from repolith.functions.predicates import glob_to_regex

    rows = []
    for r in (yaml.safe_load(text) or {}).get("rules", []):
        if r.get("type") != "no-import" or r.get("severity", "error") not in ("error", "warn") or not all(isinstance(r.get(k), str) for k in ("name", "from", "to")):
            raise ValueError(f"bad rule: {r}")
        rows.append((r["name"], r.get("severity", "error"), glob_to_regex(r["from"]), glob_to_regex(r["to"])))
    return spark.createDataFrame(rows, "name string, severity string, from_re string, to_re string")


def merged_config(defaults: dict, given: dict | None) -> dict:
    """Given values over defaults, dictionaries merged at all depths."""
    out = dict(defaults)
    for k, v in (given or {}).items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
