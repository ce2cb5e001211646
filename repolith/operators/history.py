"""Operators over git history: commits(sha, author, ts, message, is_merge) and commit_files(sha, path, added, deleted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.predicates import BUG_FIX, is_bug_fix
from repolith.operators.lineage import count, cut, numbered

DAY = 86400


def touches(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Files with their commits' columns; where commit_files has these already, as touches() gives them, nothing is joined again."""
    return commit_files if set(commits.columns) <= set(commit_files.columns) else commit_files.join(commits, "sha")


def churn(commits: DataFrame, commit_files: DataFrame, bug_pattern: str = BUG_FIX) -> DataFrame:
    """path, commits, churn_lines, bug_commits, bug_density, last_touch. Merge and bulk commits count."""
    t = touches(commits.select("sha", "ts", "message"), commit_files).withColumn("bug", is_bug_fix(F.col("message"), bug_pattern).cast("long"))
    out = t.groupBy("path").agg(count().alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn_lines"), F.sum("bug").alias("bug_commits"), F.max("ts").alias("last_touch"))
    return out.withColumn("bug_density", F.col("bug_commits") / F.col("commits"))


def author_entropy(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """path, author_entropy: -sum p log2 p over each author's share of a file's commits.

    With n = sum c, that is log2 n - sum(c log2 c) / n: no second pass for the shares.
    """
    per = touches(commits.select("sha", "author"), commit_files).groupBy("path", "author").agg(count().alias("c"))
    sums = per.groupBy("path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select("path", F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)).alias("author_entropy"))


def ownership(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """path, author, weight, share, rk: owners by lines touched; touches of no lines don't count. Equal weights go by author."""
    t = touches(commits.select("sha", "author"), commit_files).where("added + deleted > 0")
    w = t.groupBy("path", "author").agg(F.sum(F.col("added") + F.col("deleted")).alias("weight"))
    whole = Window.partitionBy("path")
    rank = whole.orderBy(F.desc("weight"), "author")
    return w.withColumn("share", F.col("weight") / F.sum("weight").over(whole)).withColumn("rk", F.row_number().over(rank))


def bus_factor(owners: DataFrame) -> DataFrame:
    """path, bus_factor: the fewest top owners who hold half of the lines; compared in whole numbers."""
    run = Window.partitionBy("path").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    x = owners.withColumn("held", F.sum("weight").over(run)).withColumn("all", F.sum("weight").over(Window.partitionBy("path")))
    return x.groupBy("path").agg(F.coalesce(F.min(F.when(2 * F.col("held") >= F.col("all"), F.col("rk"))), F.max("rk")).alias("bus_factor"))


def ownership_list(owners: DataFrame, factor: DataFrame, limit: int | None = None, co_owners: int = 3) -> DataFrame:
    """path, bus_factor, primary_owner, co_owners, n_authors; files that hang on the fewest first."""
    x = owners.groupBy("path").agg(
        F.max(F.when(F.col("rk") == 1, F.col("author"))).alias("primary_owner"),
        F.array_sort(F.collect_list(F.when(F.col("rk").between(2, co_owners + 1), F.struct("rk", "author")))).alias("co"),
        count().alias("n_authors"),
    )
    x = x.join(factor, "path").select("path", F.col("bus_factor").cast("long").alias("bus_factor"), "primary_owner", F.array_join(F.transform("co", lambda c: c["author"].cast("string")), ",").alias("co_owners"), "n_authors")
    ordered = x.orderBy("bus_factor", "path")
    return ordered.limit(limit) if limit else ordered


def staleness(commits: DataFrame, commit_files: DataFrame, now: int) -> DataFrame:
    t = touches(commits.select("sha", "ts"), commit_files).groupBy("path").agg(F.max("ts").alias("last_touch"))
    return t.select("path", F.floor((F.lit(now) - F.col("last_touch")) / DAY).alias("staleness_days"))


def coupling_commits(commits: DataFrame, commit_files: DataFrame, bulk: int = 50) -> DataFrame:
    """sha, path, ts of commits that count for coupling: no merges, and bulk files at most, so that pairs stay linear in the input."""
    # Dealt by commit once: the distinct files, their numbers and the join go by it.
    of = [c for c in ("ts", "is_merge") if c in commit_files.columns]
    files = commit_files.select("sha", "path", *of).repartition("sha").distinct()
    small = files.groupBy("sha").agg(count().alias("n")).where(F.col("n") <= bulk).select("sha")
    return touches(commits.select("sha", "ts", "is_merge"), files if len(of) == 2 else files.select("sha", "path")).where("NOT is_merge").join(small, "sha").select("sha", "path", "ts")


def gathered(commits: DataFrame, commit_files: DataFrame, size: int = 50) -> DataFrame:
    """The commits' columns, n, files (path, added, deleted): commits with the number of their files, and these in arrays, more than one
    row where there are more files than size. commit_files is dealt by commit, so that nothing but the commits is shuffled."""
    n = F.col("n")
    x = commit_files.withColumn("n", count().over(Window.partitionBy("sha")))
    chunk = F.when(n <= size, 0).otherwise(F.pmod(F.xxhash64("path"), F.ceil(n / size)))
    return x.groupBy("sha", "n", chunk.alias("chunk")).agg(F.collect_list(F.struct("path", "added", "deleted")).alias("files")).drop("chunk").join(commits, "sha")


def cochange_pairs(commits: DataFrame, commit_files: DataFrame, bulk: int = 50, least_shared: int = 1) -> DataFrame:
    """node_a < node_b, shared, last_ts, count_a, count_b, jaccard, by final counts.

    A commit's files are gathered once (bulk bounds the array) and its pairs
    come from that array, so that no join by commit is needed. Pairs are of
    numbers in the order of the paths: they are most of what is shuffled.
    """
    names = numbered(commit_files.select("path").distinct(), [F.col("path")], "node").select("path", F.col("node").cast("int").alias("node"))
    t = coupling_commits(commits, commit_files.join(names, "path").drop("path").withColumnRenamed("node", "path"), bulk)
    lists = cut(t.groupBy("sha", "ts").agg(F.array_sort(F.collect_list("path")).alias("p")), "coupled")
    return pairs_of(lists, names, bulk, least_shared)


def pairs_of(lists: DataFrame, names: DataFrame, bulk: int = 50, least_shared: int = 1) -> DataFrame:
    """The same of commits' sorted lists of numbers (ts, p) and the numbers' paths (node, path)."""
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, bulk), lambda b: F.struct(a.alias("node_a"), b.alias("node_b")))))
    shared = lists.select("ts", F.explode(pairs).alias("x")).groupBy("x.node_a", "x.node_b").agg(count().alias("shared"), F.max("ts").alias("last_ts"))
    n = cut(lists.select(F.explode("p").alias("node")).groupBy("node").agg(count().alias("n")).join(names, "node"), "counts")
    end = lambda k: n.select(F.col("node").alias(f"node_{k}"), F.col("path").alias(f"path_{k}"), F.col("n").alias(f"count_{k}"))
    out = shared.where(F.col("shared") >= least_shared).join(end("a"), "node_a").join(end("b"), "node_b")
    return out.select(F.col("path_a").alias("node_a"), F.col("path_b").alias("node_b"), "shared", "count_a", "count_b", "last_ts", (F.col("shared") / (F.col("count_a") + F.col("count_b") - F.col("shared"))).alias("jaccard"))


def cochange_as_ingested(commits: DataFrame, commit_files: DataFrame, bulk: int = 50) -> DataFrame:
    """The pairs' counts as they stood when the pair was last met, with commits read from newest to oldest."""
    t = coupling_commits(commits, commit_files, bulk)
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("so_far", count().over(w))
    lists = t.groupBy("sha", "ts").agg(F.array_sort(F.collect_list(F.struct("path", "so_far"))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, bulk), lambda b: F.struct(a["path"].alias("node_a"), b["path"].alias("node_b"), a["so_far"].alias("ca"), b["so_far"].alias("cb")))))
    x = lists.select("sha", "ts", F.explode(pairs).alias("x")).select("sha", "ts", "x.*")
    # The last met is the oldest: the least (ts, sha).
    out = x.groupBy("node_a", "node_b").agg(count().alias("shared"), F.min(F.struct("ts", "sha", "ca", "cb")).alias("m"))
    return out.select("node_a", "node_b", "shared", F.col("m.ca").alias("count_a"), F.col("m.cb").alias("count_b"), (F.col("shared") / (F.col("m.ca") + F.col("m.cb") - F.col("shared"))).alias("jaccard"))


def confidence(now: int, half_life_days: float = 90.0) -> Column:
    age = F.greatest((F.lit(now) - F.col("last_ts")) / DAY, F.lit(0.0))
    return F.col("jaccard") * F.log1p("shared") * F.exp(-F.log(F.lit(2.0)) * age / half_life_days)


def coupling(pairs: DataFrame, now: int, least_shared: int = 3, least_confidence: float = 0.05, k: int | None = 10, half_life_days: float = 90.0) -> DataFrame:
    """path, partner, shared, jaccard, confidence, rk: each file's strongest partners."""
    scored = pairs.where(F.col("shared") >= least_shared).withColumn("confidence", confidence(now, half_life_days)).where(F.col("confidence") >= least_confidence)
    ways = F.explode(F.array(F.struct(F.col("node_a").alias("path"), F.col("node_b").alias("partner")), F.struct(F.col("node_b").alias("path"), F.col("node_a").alias("partner"))))
    both = scored.select("shared", "jaccard", "confidence", ways.alias("w")).select("w.path", "w.partner", "shared", "jaccard", "confidence")
    ranked = both.withColumn("rk", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "partner")))
    return ranked.where(F.col("rk") <= k) if k else ranked


def coupling_explanation(shared: Column, last_ts: Column, now: int) -> Column:
    """A sentence on how often and how lately two files changed together."""
    days = F.floor((F.lit(now) - last_ts) / DAY)
    many = lambda n: F.when(n == 1, "").otherwise("s")
    return F.format_string("Changed together in %d commit%s; last co-change %d day%s ago.", shared, many(shared), days, many(days))


def coupling_arm(pairs: DataFrame, seeds: DataFrame, static: DataFrame, now: int, per_seed: int = 25, least: float = 0.1, keep: int = 10) -> DataFrame:
    """Partners of the seeds that static analysis doesn't have: per seed the first 25, for each partner the first seed by name, 10 in all."""
    c = coupling(pairs, now, 3, least, per_seed).join(seeds.select("path"), "path", "left_semi")
    c = c.join(static.select(F.col("path").alias("partner")), "partner", "left_anti").join(seeds.select(F.col("path").alias("partner")), "partner", "left_anti")
    one = c.groupBy("partner").agg(F.min_by(F.struct("path", "confidence", "shared"), "path").alias("x"))
    return one.select(F.col("partner").alias("path"), F.col("x.path").alias("seed"), F.col("x.confidence").alias("confidence"), F.col("x.shared").alias("shared")).orderBy(F.desc("confidence"), "path").limit(keep)


def owner_activity(owners: DataFrame, last_touch: DataFrame) -> DataFrame:
    """author, last_ts: the latest touch of any file they own a share of."""
    return owners.join(last_touch, "path").groupBy("author").agg(F.max("last_touch").alias("last_ts"))


def bus_factor_warnings(factor: DataFrame, stale: DataFrame, most: int = 2, days: int = 90) -> DataFrame:
    return factor.join(stale, "path").where((F.col("bus_factor") <= most) | (F.col("staleness_days") > days)).select("path", "bus_factor", "staleness_days")


def simple_reviewers(owners: DataFrame, changed: DataFrame, approvers: DataFrame | None = None, k: int = 2) -> DataFrame:
    """author, share: the mean over the changed files where an author is an owner; approvers first."""
    mean = owners.join(changed.select("path"), "path", "left_semi").groupBy("author").agg(F.avg("share").alias("share"))
    first = F.lit(False) if approvers is None else F.col("ok").isNotNull()
    mean = mean if approvers is None else mean.join(F.broadcast(approvers.select("author", F.lit(1).alias("ok"))), "author", "left")
    return mean.withColumn("approver", first).orderBy(F.desc("approver"), F.desc("share"), "author").select("author", "approver", "share").limit(k)


def codeowners_rules(owners: DataFrame, least_share: float = 0.3, per_file: int = 2) -> DataFrame:
    """dir, owners: for each directory the sorted owners with such a share among a file's first ones."""
    top = owners.where((F.col("share") >= least_share) & (F.col("rk") <= per_file)).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return top.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set(F.col("author").cast("string"))), " ").alias("owners"))


def reviewer_scores(owners: DataFrame, changed: DataFrame, factor: DataFrame, last: DataFrame, pairs: DataFrame, now: int, author: int | None = None, k: int | None = 3) -> DataFrame:
    """author, own, peers, activity, boost, multiplier, total of candidates for changed files.

    total = multiplier * (.5 own + .25 peers + .15 activity + .1 boost). own: the
    mean share over all changed files (0 where absent). peers: of the ten files
    most coupled to each changed one, the share the candidate owns, mean over
    files. activity: 1 within 30 days, .5 within 90. boost: the share of changed
    files of bus factor 2 at most where the candidate holds a tenth and isn't
    first. multiplier: .3 beyond 90 days; beyond 180 no candidate. Totals are
    compared in steps of 0.02, then by multiplier, recency and author.
    """
    files = changed.select("path").distinct()
    n = files.agg(F.greatest(count(), F.lit(1)).alias("n_files"))
    mine = owners.join(files, "path", "left_semi").join(factor, "path", "left")
    own = mine.groupBy("author").agg(F.sum("share").alias("own"), F.sum(F.when((F.col("bus_factor") <= 2) & (F.col("share") >= 0.1) & (F.col("rk") > 1), 1).otherwise(0)).alias("boosts"))
    partner = coupling(pairs, now, k=10).join(files, "path", "left_semi").select("path", "partner")
    n_partners = partner.groupBy("path").agg(count().alias("k"))
    hits = partner.join(owners.select(F.col("path").alias("partner"), "author"), "partner").groupBy("path", "author").agg(count().alias("h")).join(n_partners, "path")
    peers = hits.groupBy("author").agg(F.sum(F.col("h") / F.col("k")).alias("peers"))
    x = own.join(peers, "author", "full").join(owner_activity(owners, last), "author").crossJoin(F.broadcast(n))
    days = F.floor((F.lit(now) - F.col("last_ts")) / DAY)
    x = x.withColumn("days", days).where(F.col("days") <= 180)
    x = x.where(F.col("author") != author) if author is not None else x
    x = x.select(
        "author", "last_ts", (F.coalesce("own", F.lit(0.0)) / F.col("n_files")).alias("own"), (F.coalesce("peers", F.lit(0.0)) / F.col("n_files")).alias("peers"),
        F.when(F.col("days") <= 30, 1.0).when(F.col("days") <= 90, 0.5).otherwise(0.0).alias("activity"), (F.coalesce("boosts", F.lit(0)) / F.col("n_files")).alias("boost"), F.when(F.col("days") > 90, 0.3).otherwise(1.0).alias("multiplier"),
    )
    x = x.withColumn("total", F.col("multiplier") * (0.5 * F.col("own") + 0.25 * F.col("peers") + 0.15 * F.col("activity") + 0.1 * F.col("boost")))
    ordered = x.orderBy(F.desc(F.floor(F.col("total") / 0.02)), F.desc("multiplier"), F.desc("last_ts"), "author")
    return ordered.limit(k) if k else x
