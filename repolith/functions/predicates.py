"""Path and message predicates, as patterns for rlike and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
TEST_FILE = r"\.test\.|\.spec\.|/tests/|/test/|/spec/|__tests__"
ENTRY_POINT = r"(^|/)(index|main|server|app|cli)\.[^/]+$"
BUG_FIX = r"(?i)\b(fix|bug|hotfix|revert)\b"
BENCH_TEST = r"(^|/)(tests?|spec|__tests__)/|\.test\.|_test\.|\.spec\.|(^|/)test_[^/]*\.py$"
NON_SOURCE = (
    r"(?i)\.(?:md|mdx|markdown|txt|rst|adoc|lock|sum|png|jpg|jpeg|gif|svg|ico|webp|woff2?|ttf|otf|eot|mp4|mov|webm|wav|mp3)$"
    r"|(^|/)(?-i:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|Gemfile\.lock|Cargo\.lock)$"
    r"|(^|/)(?:LICEN[CS]E|CHANGELOG|README|AUTHORS|CONTRIBUTORS|NOTICE)(?:\.[a-z]+)?$"
)
SAFE_PATH = r"^[A-Za-z0-9._/\-+]{1,500}$"
SOURCE_EXTENSIONS = "ts tsx js jsx mjs cjs vue py rs go java cs rb kt kts swift php dart c cpp h".split()
BINARY_EXTENSIONS = "png jpg jpeg gif ico webp svg pdf zip tar gz bz2 woff woff2 ttf otf mp3 mp4 mov wav".split()
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "coverage", "__pycache__", ".venv", "venv", "target", "vendor")


def is_test(path: Column | str) -> Column:
    return F.col(path).rlike(TEST_FILE) if isinstance(path, str) else path.rlike(TEST_FILE)


def is_non_source(path: Column | str) -> Column:
    """Documents, pictures, lock files and the like, which no test covers."""
    return (F.col(path) if isinstance(path, str) else path).rlike(NON_SOURCE)


def _has_extension(path: Column | str, known: list[str]) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^.]*)$", 1)).isin(known)


def is_source(path: Column | str) -> Column:
    """Files that an import graph can hold, by their last extension in any case."""
    return _has_extension(path, SOURCE_EXTENSIONS)


def is_binary(path: Column | str) -> Column:
    return _has_extension(path, BINARY_EXTENSIONS)


def is_bug_fix(message: Column, pattern: str = BUG_FIX) -> Column:
    return F.coalesce(message.rlike(pattern), F.lit(False))


def is_ignored(path: Column) -> Column:
    """Whether a directory on the way is one to skip."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*IGNORED_DIRS) | d.endswith(".egg-info") | d.endswith(".dist-info"))


def is_safe(path: Column) -> Column:
    return path.rlike(SAFE_PATH) & ~F.contains(path, F.lit(".."))


def glob_to_regex(glob: str) -> str:
    """A glob's anchored pattern: ** crosses directories, * and ? don't, braces are alternatives, dots are ordinary."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i : i + 2] == "**":
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def handle_matches(pattern: Column, email: Column) -> Column:
    """Equality, or *@domain."""
    return F.when(pattern.startswith("*@"), email.endswith(F.substring(pattern, 2, 1 << 30))).otherwise(pattern == email)
