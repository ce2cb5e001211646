"""What surrounds a query's rows in an answer: token budgets, envelopes, levels of detail, and which query suits a task."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from repolith.operators.lineage import count


def estimate(text: str) -> int:
    """A token for every four characters, rounded up."""
    return -(-len(text) // 4)


@dataclass(frozen=True)
class Budget:
    """Limits of answers in tokens: by default, by query, and for the task at hand, which goes before both."""

    default: int | None = None
    by_query: dict[str, int] | None = None
    task: int | None = None

    def of(self, query: str, asked: int | None = None) -> int | None:
        """The limit that holds: what the caller asks for, but not above a task's."""
        own = asked if asked is not None else (self.by_query or {}).get(query, self.default)
        return own if self.task is None else self.task if own is None else min(own, self.task)


def envelope(query: str, full: str, skeleton: str | None = None, budget: int | None = None, tokens: Callable[[str], int] = estimate) -> dict:
    """{data, meta}: the full answer if it fits, else its skeleton, else the beginning of it; an error if nothing may be said."""
    size = tokens(full)
    if budget is None or size <= budget:
        mode, data = "full", full
    elif skeleton is not None and tokens(skeleton) <= budget:
        mode, data = "skeleton", skeleton
    elif budget > 0:
        mode, data = "truncate", full[: budget * 4]
    else:
        mode, data = "error", None
    used = 0 if data is None else tokens(data)
    return {"data": data, "meta": {"query": query, "mode": mode, "tokens": used, "original_tokens": size, "budget": budget, "ratio": used / size if size else None}}


def answer(query: str, rows: DataFrame, limit: int = 200, budget: int | None = None) -> dict:
    """The envelope of a query's first rows as JSON lines, its skeleton the first column alone. limit bounds what comes to the driver."""
    some = rows.limit(limit).collect()
    whole = "\n".join(json.dumps(r.asDict(True), default=str) for r in some)
    return envelope(query, whole, "\n".join(str(r[0]) for r in some), budget)


def at_detail(rows: DataFrame, level: str = "standard") -> DataFrame:
    """standard: the rows. minimal: their number."""
    if level not in ("standard", "minimal"):
        raise ValueError(f"no such level of detail: {level}")
    return rows if level == "standard" else rows.agg(count().alias("n"))


#: Which queries suit a task, and what often comes after one.
ROUTES = {
    "review a change": ("detect_changes", "blast_radius", "affected_flows", "rules_check"),
    "understand the code": ("architecture_overview", "hub_nodes", "communities", "entry_points"),
    "find something": ("full_text_search", "search", "definition", "similar_files"),
    "refactor": ("blast_call_sites", "refactor_preview", "apply_refactor", "knowledge_gaps"),
}
NEXT = {
    "search": ("get_file", "context_packet"),
    "full_text_search": ("get_file", "definition"),
    "definition": ("blast_call_sites", "context_packet"),
    "detect_changes": ("blast_radius", "affected_flows"),
    "blast_radius": ("blast_call_sites", "git_coupling"),
    "hub_nodes": ("blast_radius", "knowledge_gaps"),
    "refactor_preview": ("apply_refactor",),
}


def suggested_next(query: str, learned: DataFrame | None = None, k: int = 3) -> list[str]:
    """What callers did next most often (from_tool, to_tool, n), filled up with the table's."""
    seen = [r.to_tool for r in learned.where(learned["from_tool"] == query).orderBy(learned["n"].desc(), "to_tool").limit(k).collect()] if learned is not None else []
    return list(dict.fromkeys([*seen, *NEXT.get(query, ())]))[:k]
