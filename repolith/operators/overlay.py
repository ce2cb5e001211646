"""Keeping the history's measures up to date: new commits are summed by themselves and merged into what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.history import coupling_commits, is_bug_fix, touches
from repolith.operators.lineage import count


def measures(commits: DataFrame, commit_files: DataFrame, bug_pattern: str) -> dict[str, DataFrame]:
    """Sums and maxima over commits, all of which can be merged.

    churn: path, commits, churn_lines, bug_commits, last_touch. owners: path,
    author, weight. pairs: node_a, node_b, shared, last_ts. counted: path, n (commits that count for pairs).
    """
    t = touches(commits.select("sha", "author", "ts", is_bug_fix(F.col("message"), bug_pattern).cast("long").alias("bug")), commit_files).withColumn("lines", F.col("added") + F.col("deleted"))
    small = coupling_commits(commits, commit_files)
    lists = small.groupBy("sha", "ts").agg(F.array_sort(F.collect_list("path")).alias("p"))
    both = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, 50), lambda b: F.struct(a.alias("node_a"), b.alias("node_b")))))
    return {
        "churn": t.groupBy("path").agg(count().alias("commits"), F.sum("lines").alias("churn_lines"), F.sum("bug").alias("bug_commits"), F.max("ts").alias("last_touch")),
        "owners": t.where("lines > 0").groupBy("path", "author").agg(F.sum("lines").alias("weight")),
        "pairs": lists.select("ts", F.explode(both).alias("x")).groupBy("x.node_a", "x.node_b").agg(count().alias("shared"), F.max("ts").alias("last_ts")),
        "counted": small.groupBy("path").agg(count().alias("n")),
    }


KEYS = {"churn": ("path",), "owners": ("path", "author"), "pairs": ("node_a", "node_b"), "counted": ("path",)}
LATEST = ("last_touch", "last_ts")


def merge(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The measures of all commits from those of the old and of the new ones: one aggregation a table, of a row a key on either side."""
    out = {}
    for name, keys in KEYS.items():
        sums = [c for c in old[name].columns if c not in keys]
        both = old[name].select(*keys, *sums).unionByName(new[name].select(*keys, *sums))
        out[name] = both.groupBy(*keys).agg(*((F.max if c in LATEST else F.sum)(c).alias(c) for c in sums))
    return out


def new_commits(commits: DataFrame, seen: DataFrame) -> DataFrame:
    """The commits that the overlay hasn't read."""
    return commits.join(seen.select("sha"), "sha", "left_anti")
