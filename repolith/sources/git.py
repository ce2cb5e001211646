"""Git history: `git log --numstat` as commit tables.

GitLog is a data source. A batch read has a partition for each repository and
range of commit dates, so that tasks run git side by side; a stream's offset is
the last commit of each repository, and a micro-batch brings what came after it.
Repositories must lie where all executors see them. A dump to a file is read
with the record separator as line separator, so that Spark splits it into
commits. All three give records that parse() turns into commits.
"""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "%x1e%H%x00%P%x00%an%x00%ae%x00%at%x00%s%x00"
EXCLUDED = ("node_modules/", "dist/")


RECORDS = "repo string, value string"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def check_sha(repo: str, sha: str) -> str:
    """A commit's full name, if the repository has it."""
    if len(sha) != 40 or set(sha) - set("0123456789abcdef"):
        raise ValueError("a commit is named by 40 hex digits")
    if subprocess.run(["git", "-C", repo, "cat-file", "-e", sha + "^{commit}"], capture_output=True).returncode:
        raise ValueError(f"{repo} has no commit {sha}")
    return sha


def head(repo: str) -> str:
    """The newest commit's name; empty for a repository without commits."""
    found = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, text=True).stdout.strip()
    if not found:
        _git(repo, "rev-parse", "--git-dir")  # not a repository at all: an error
    return found


@dataclass
class Log(InputPartition):
    """What one task reads of a repository: a span of commits or a range of their dates."""

    repo: str
    what: list[str]


def records(part: Log | None) -> Iterator[tuple[str, str]]:
    """The log's records as git gives them, one at a time. Spark asks once with no partition where there is nothing to read."""
    if part is None:
        return
    with subprocess.Popen(["git", "-C", part.repo, "log", f"--format={FORMAT}", "--numstat", *part.what], stdout=subprocess.PIPE) as p:
        held = b""
        while piece := p.stdout.read(1 << 16):
            *whole, held = (held + piece).split(b"\x1e")
            yield from ((part.repo, r.decode("utf-8", "replace")) for r in whole if r)
        if held:
            yield part.repo, held.decode("utf-8", "replace")
    if p.returncode:
        raise RuntimeError(f"git log failed in {part.repo}")


class GitLog(DataSource):
    """Options: repos (a JSON list of folders), since_days (365; empty for all), range_days (30), now (seconds), since (JSON: folder -> the
    last commit that is known)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _GitStream(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.repos = options, json.loads(options["repos"])

    def partitions(self) -> list[Log]:
        known = json.loads(self.options.get("since", "{}"))
        days = self.options.get("since_days", "365")
        now, step = int(self.options.get("now", time.time())), int(self.options.get("range_days", "30")) * 86400
        out = []
        for repo in self.repos:
            newest = head(repo)
            if not newest:
                continue
            span = [f"{check_sha(repo, known[repo])}..{newest}"] if repo in known else [newest]
            # Commit dates by which the span is dealt; the first and the last range are open, as clocks differ.
            dates = [int(x) for x in _git(repo, "log", "--format=%ct", "--max-count=1", *span).split()]
            if not dates:
                continue
            low = now - int(days) * 86400 if days and repo not in known else int(_git(repo, "log", "--format=%ct", "--reverse", *span).split(None, 1)[0])
            cuts = list(range(low, max(dates[0], low) + 1, step))
            for k, begin in enumerate(cuts):
                what = [f"--since-as-filter={begin}"] if k or (days and repo not in known) else []
                if k + 1 < len(cuts):
                    what.append(f"--until={cuts[k + 1] - 1}")
                out.append(Log(repo, [*what, *span]))
        return out

    def read(self, partition: Log) -> Iterator[tuple[str, str]]:
        return records(partition)


class _GitStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.repos, self.since = json.loads(options["repos"]), json.loads(options.get("since", "{}"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {r: check_sha(r, self.since[r]) if r in self.since else "" for r in self.repos}

    def latestOffset(self) -> dict:  # noqa: N802
        return {r: head(r) for r in self.repos}

    def partitions(self, start: dict, end: dict) -> list[Log]:
        spans = [(r, start.get(r, ""), end.get(r, "")) for r in self.repos]
        return [Log(r, [f"{check_sha(r, a)}..{check_sha(r, b)}" if a else check_sha(r, b)]) for r, a, b in spans if b and a != b]

    def read(self, partition: Log) -> Iterator[tuple[str, str]]:
        return records(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)


def log(spark: SparkSession, repos: list[str], **options: object) -> DataFrame:
    """Commits of repositories (with repo) by the data source."""
    register(spark)
    return parse(spark.read.format("gitlog").options(repos=json.dumps(repos), **{k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}).load())


def log_stream(spark: SparkSession, repos: list[str], **options: object) -> DataFrame:
    """The same as a stream: what comes to the repositories, after the commits in since."""
    register(spark)
    return parse(spark.readStream.format("gitlog").options(repos=json.dumps(repos), **{k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}).load())


def dump(repo: str, to: str, since_days: int | None = 365, since_sha: str | None = None) -> None:
    """Writes a repository's log to a local file, newest first. since_sha: only what came after it."""
    if since_sha is not None and not (len(since_sha) == 40 and all(c in "0123456789abcdef" for c in since_sha)):
        raise ValueError("since_sha must be 40 hex digits")
    what = [f"{since_sha}..HEAD"] if since_sha else [f"--since={since_days}.days"] if since_days else []
    with open(to, "wb") as f:
        subprocess.run(["git", "-C", repo, "log", f"--format={FORMAT}", "--numstat", *what], stdout=f, check=True)


def read(spark: SparkSession, path: str, bulk: int = 50, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """sha, author, email, ts, message, is_merge, is_bulk, files (path, added, deleted). Records that aren't commits are left out; bulk is judged after exclusions."""
    return parse(spark.read.option("lineSep", "\x1e").text(path), bulk, excluded)


def parse(raw: DataFrame, bulk: int = 50, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Records (value, and other columns that stay) to commits."""
    p = F.split("value", "\x00", 7)
    lines = F.split(F.coalesce(F.get(p, 6), F.lit("")), "\n")
    parsed = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+\t\d+\t.")), lambda x: F.struct(F.element_at(F.split(x, "\t", 3), 3).alias("path"), F.element_at(F.split(x, "\t", 3), 1).try_cast("long").alias("added"), F.element_at(F.split(x, "\t", 3), 2).try_cast("long").alias("deleted")))
    out = F.filter(parsed, lambda f: ~_any(f["path"], excluded) if excluded else F.lit(True))
    ok = (F.size(p) >= 6) & F.get(p, 0).rlike("^[0-9a-f]{40}$") & F.get(p, 4).try_cast("long").isNotNull()
    c = raw.where(ok).select(
        *(x for x in raw.columns if x != "value"), F.get(p, 0).alias("sha"), F.get(p, 2).alias("author"), F.get(p, 3).alias("email"), F.get(p, 4).try_cast("long").alias("ts"), F.get(p, 5).alias("message"),
        (F.size(F.filter(F.split(F.get(p, 1), " "), lambda x: x != "")) >= 2).alias("is_merge"), out.alias("files"),
    )
    return c.withColumn("is_bulk", F.size("files") > bulk)


def _any(path, prefixes):
    cond = path.startswith(prefixes[0])
    for p in prefixes[1:]:
        cond = cond | path.startswith(p)
    return cond


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("sha", F.explode("files").alias("f")).select("sha", "f.path", "f.added", "f.deleted")


def new_commits(read_now: DataFrame, known: DataFrame) -> DataFrame:
    """Commits not in the known table: an incremental scan."""
    return read_now.join(known.select("sha"), "sha", "left_anti")
