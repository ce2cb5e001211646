"""Conversation structure repair by cheapest edits.

A conversation's roles should read: an optional system message, then pairs of
user and assistant (or nothing at all). Its messages, in the order of turns, are
kept (cost 0), given the role that fits (2) or deleted (3), and empty messages of
the role that fits are inserted (2); a message that stays although it is cut off
costs 1 more. Blank messages and repeated ones must go. Positions between
messages times the four states of the role pattern are the nodes of a graph whose
arcs cost 0 to 3: Dial's bucket queue finds all distances to the end, and a walk
along tight arcs, the least letter first (D, I, K, R), gives the audit. A state
and a letter have one arc at most, so that the audit alone gives the repair.

How it is distributed. Rows are dealt and sorted by ranges of (conv_id, turn,
role, text), so that a large conversation lies in many ranges. A task cuts its
rows into segments of one conversation, of MOST_ROWS rows or MOST_CHARS
characters at most. A segment that holds a whole conversation is solved at once.
Those at the ends of a range and those of large conversations are open: repeats
are found by digests across segments, each segment gives its costs from every
state to every state, these are chained from the end, each segment then tells
where its walk comes out for each state it may begin in, these are chained from
the start, and each segment writes its part of the audit and of the repair. What
is chained or read as a whole is a row a segment; a conversation's repair is
hashed in order by one task as it streams by, as SHA-256 wants it.

Nulls: a null role or text is one space (so the message is blank or its role is
none of the three), null turns come first, a null conv_id is a conversation of its
own. Rows of one turn are ordered by role and text; fully equal rows are repeats.
The initial of a role is its first character; an empty role has none. Messages
marked by `gone` only make their conversation known: one without other messages
has zeros, an empty audit and the hash of the empty string. An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from repolith.llm.common import arrow_bytes, cut, drop_cut

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
FAR = 1 << 60
MOST_ROWS, MOST_CHARS = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

#: States of the role pattern: nothing yet, after system, after user, after assistant.
FITS = (2, 2, 3, 2)  # the state after a message of the role that fits: user, user, assistant, user
ENDS = (0, FAR, FAR, 0)  # a conversation may end with nothing or after an assistant
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}  # the states that messages of a kind lead to


def _back_arcs() -> tuple[list, dict]:
    """For the search from the end: of each state the (offset to the node before, cost) of inserts, and of the edits of a message by its mark."""
    inserts = [[(p - q, INSERT) for p in range(4) if FITS[p] == q] for q in range(4)]
    edits = {"x": [[(-4, DELETE)] for _ in range(4)]}
    for kind, steps in NEXT.items():
        for mark, more in ((kind, 0), (kind.upper(), CUT_OFF)):
            edits[mark] = [
                [(-4, DELETE)] + [(p - q - 4, KEEP + more) for p, to in steps.items() if to == q] + [(p - q - 4, REROLE + more) for p in range(4) if FITS[p] == q] for q in range(4)
            ]
    return inserts, edits


INSERTS, EDITS = _back_arcs()
ARCS = {mark: [INSERTS[q] + arcs[q] for q in range(4)] for mark, arcs in EDITS.items()}


def distances(marks: str, ends: Iterable[int]) -> list[int]:
    """Dial's search from the end: the least cost from node 4 * position + state to the end, where state q costs ends[q] more.

    marks has a character for each message: x must go, else its role's kind s, u, a or o, in upper case if it is cut off.
    Costs are small, so that a ring of buckets is the queue.
    """
    n, ends = len(marks), list(ends)
    dist, d = [FAR] * (4 * n + 4), min(ends)
    span = max([DELETE, REROLE + CUT_OFF, *(e - d for e in ends if e < FAR)]) + 1
    ring: list[list[int]] = [[] for _ in range(span)]
    waiting = 0
    for q, e in enumerate(ends):
        if e < FAR:
            dist[4 * n + q] = e
            ring[e % span].append(4 * n + q)
            waiting += 1
    while waiting:
        bucket = ring[d % span]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] < d:
                continue
            for offset, cost in ARCS[marks[(node >> 2) - 1]][node & 3] if node > 3 else INSERTS[node & 3]:
                to, far = node + offset, d + cost
                if far < dist[to]:
                    dist[to] = far
                    ring[far % span].append(to)
                    waiting += 1
        d += 1
    return dist


def walk(marks: str, dist: list[int], state: int, last: bool = True) -> tuple[str, int]:
    """The least audit along tight arcs from a state before the first message, and the state that it ends in. Where other messages
    follow, inserts behind the last one are left to them, as a deletion may come first there."""
    at, letters, n = state, [], len(marks)
    i = 0
    while i < n or last:
        here = dist[4 * i + at]
        if i < n:
            mark = marks[i]
            more, kind = (CUT_OFF, mark.lower()) if mark.isupper() else (0, mark)
            if here == DELETE + dist[4 * i + 4 + at]:
                letters.append("D")
                i += 1
                continue
        if here == INSERT + dist[4 * i + FITS[at]]:
            letters.append("I")
            at = FITS[at]
            continue
        if i == n:
            break
        to = NEXT[kind].get(at) if kind != "x" else None
        if to is not None and here == KEEP + more + dist[4 * i + 4 + to]:
            letters.append("K")
        else:
            letters.append("R")
            to = FITS[at]
        at = to
        i += 1
    return "".join(letters), at


@lru_cache(20_000)
def _short(marks: str) -> tuple[int, str]:
    dist = distances(marks, ENDS)
    return dist[0], walk(marks, dist, 0)[0]


def cheapest(marks: str) -> tuple[int, str]:
    """Least cost of a whole conversation and its audit."""
    return _short(marks) if len(marks) <= 32 else _short.__wrapped__(marks)


def replay(audit: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what stays or is inserted by an audit."""
    out, left = [], iter(rows)
    for letter in audit:
        role, text = next(left) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[role[0]][state]
        else:
            role = "assistant" if state == 2 else "user"
            state = FITS[state]
        out.append((letter, role, text))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of conv_id:turn modulo 20: 0 drops (marked as gone), 1 empties, 2 takes the marks of
    sentence ends, 3 repeats, 4 sets the role to user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") < 2, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


# --- segments -------------------------------------------------------------------------


class Segment:
    """Neighbouring rows of one conversation."""

    def __init__(self, conv, most_rows: int = MOST_ROWS):
        self.conv, self.most_rows, self.rows, self.turns, self.chars = conv, most_rows, [], [], 0

    def add(self, turn, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.turns.append(turn)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= self.most_rows or self.chars >= MOST_CHARS

    def facts(self) -> dict:
        """Marks, counts and what neighbours need to know."""
        seen, marks, fresh = set(), [], []
        blank = duplicate = 0
        for k, row in enumerate(self.rows):
            bare = row[1].rstrip(SPACE)
            if not bare:
                blank += 1
                marks.append("x")
            elif row in seen:
                duplicate += 1
                marks.append("x")
            else:
                seen.add(row)
                fresh.append(k)
                kind = row[0][:1]
                kind = kind if kind in ("s", "u", "a") else "o"
                marks.append(kind if bare[-1] in ".!?" else kind.upper())
        initials = [role[:1] for role, _ in self.rows]
        known = [t for t in self.turns if t is not None]
        return {
            "marks": "".join(marks), "fresh": fresh, "blank": blank, "duplicate": duplicate, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "distinct": len(set(known)),
        }


def truncated(marks: str) -> int:
    return sum(m.isupper() for m in marks)


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def gaps_of(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def joined(lines: Iterable[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in lines)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "array<struct<edit:string,role:string,text:string>>"
OPEN = f"done boolean, {RESULT}, lines {LINES}, part int, seq int, marks string, first_initial string, last_initial string, first_turn long, last_turn long, n_distinct long, fresh array<int>, digests array<binary>, roles array<string>, texts array<string>"


def _with_conv(df: DataFrame, schema: str) -> StructType:
    return StructType([StructField("conv_id", df.schema["conv_id"].dataType), *StructType.fromDDL(schema)])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _row(s: Segment, whole: bool, part: int, seq: int, texts: bool) -> dict:
    x = s.facts()
    out = {"conv_id": s.conv, "done": whole, "part": part, "seq": seq, "blank": x["blank"], "duplicate": x["duplicate"], "illegal": x["illegal"]}
    if whole:
        cost, audit = cheapest(x["marks"])
        lines = replay(audit, s.rows)
        out |= {"gaps": gaps_of(x["first_turn"], x["last_turn"], x["distinct"]), "truncated": truncated(x["marks"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(joined(lines).encode()).hexdigest()}
        return out | ({"lines": [dict(zip(("edit", "role", "text"), v, strict=True)) for v in lines]} if texts else {})
    keys = {"first_initial", "last_initial", "first_turn", "last_turn", "marks", "fresh"}
    return out | {k: x[k] for k in keys} | {"n_distinct": x["distinct"], "digests": [digest(*s.rows[k]) for k in x["fresh"]], "roles": [r for r, _ in s.rows], "texts": [t for _, t in s.rows]}


def segments(messages: DataFrame, texts: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each segment: the result if it is a whole conversation, else what the open segments' passes need."""
    # Equal rows may be any number: dealt by their place in the input too. Which of them goes where makes no difference.
    ordered = messages.withColumn("__row", F.monotonically_increasing_id()).withColumn("__head", F.substring("text", 1, 64))
    dealt = ordered.repartitionByRange("conv_id", "turn", "role", "__head", "__row").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _with_conv(messages, OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part = _arrow(schema), TaskContext.get().partitionId()
        now, seq, ends, rows, size = None, 0, True, [], 0  # ends: the segment may go on before or behind

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if now is not None and (now.conv != conv or now.full()):
                    same = now.conv == conv
                    rows.append(_row(now, not ends and not same, part, seq, texts))
                    size += now.chars if ends or same or texts else 0
                    seq, ends, now = seq + 1, same, None
                    if size > MOST_CHARS or len(rows) >= 4096:
                        yield flush()
                        rows, size = [], 0
                now = now or Segment(conv, most_rows)
                if not gone:
                    now.add(turn, role, text)
        if now is not None:
            rows.append(_row(now, False, part, seq, texts))
        if rows:
            yield flush()

    return dealt.select("conv_id", "turn", "role", "text", "gone").mapInArrow(run, schema)


# --- conversations of several segments ------------------------------------------------


def _late(open_: DataFrame) -> DataFrame:
    """part, seq, late: the rows of a segment that repeat one of an earlier segment. A digest comes once a segment at most."""
    keys = open_.select("conv_key", "part", "seq", F.explode(F.arrays_zip("fresh", "digests")).alias("x")).select("conv_key", "part", "seq", "x.fresh", F.col("x.digests").alias("digest"))
    firsts = keys.groupBy("conv_key", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(firsts, ["conv_key", "digest"]).where(F.struct("part", "seq") > F.col("first")).groupBy("part", "seq").agg(F.collect_list("fresh").alias("late"))


def _costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks and counts with the repeats of earlier segments, and the least costs from each state to each state."""
    for x in frames:
        out = []
        for conv, part, seq, marks, late in zip(x["conv_key"], x["part"], x["seq"], x["marks"], x["late"], strict=True):
            if late is not None and len(late):
                gone = set(late)
                marks = "".join("x" if k in gone else m for k, m in enumerate(marks))
            to = [distances(marks, [0 if q == end else FAR for q in range(4)])[:4] for end in range(4)]
            out.append((conv, part, seq, marks, 0 if late is None else len(late), [to[q][p] for p in range(4) for q in range(4)]))
        yield pd.DataFrame(out, columns=["conv_key", "part", "seq", "marks", "more", "costs"])


def _chain_back(x: pd.DataFrame) -> pd.DataFrame:
    """What the end costs from each state behind each segment."""
    x, after, out = x.sort_values(["part", "seq"]), list(ENDS), []
    for costs in reversed(x["costs"].tolist()):
        out.append(after)
        after = [min(min(FAR, costs[4 * p + q] + after[q]) for q in range(4)) for p in range(4)]
    last = [False] * (len(x) - 1) + [True]
    return pd.DataFrame({"part": x["part"].to_numpy(), "seq": x["seq"].to_numpy(), "after": out[::-1], "last": last})


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each state a segment may begin in, the one it ends in."""
    for x in frames:
        out = []
        for marks, after in zip(x["marks"], x["after"], strict=True):
            dist = distances(marks, after.tolist())
            out.append([walk(marks, dist, p, last=False)[1] for p in range(4)])
        yield pd.DataFrame({"conv_key": x["conv_key"], "part": x["part"], "seq": x["seq"], "exits": out})


def _chain_forth(x: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment begins in."""
    x, at, entry = x.sort_values(["part", "seq"]), 0, []
    for exits in x["exits"]:
        entry.append(at)
        at = int(exits[at])
    return pd.DataFrame({"part": x["part"].to_numpy(), "seq": x["seq"].to_numpy(), "entry": entry})


def _pieces(texts: bool):
    """Each segment's part of the audit and of the repair, as lines or as one text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for marks, after, last, entry, roles, messages in zip(x["marks"], x["after"], x["last"], x["entry"], x["roles"], x["texts"], strict=True):
                dist = distances(marks, after.tolist())
                audit, _ = walk(marks, dist, entry, last)
                lines = replay(audit, list(zip(roles, messages, strict=True)), entry)
                out.append((dist[entry], audit, len(lines), "" if texts else joined(lines), [dict(zip(("edit", "role", "text"), v, strict=True)) for v in lines] if texts else None))
            made = pd.DataFrame(out, columns=["cost", "audit", "n_lines", "repaired", "lines"], index=x.index)
            yield pd.concat([x.drop(columns=["after", "last", "entry", "roles", "texts"]), made], axis=1)

    return run


def _results(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations out of their segments' pieces, which come in order. The hash goes on from piece to piece."""
    key, now, done = None, None, []
    for batch in batches:
        for x in batch.to_pylist():
            if now is None or x["conv_key"] != key:
                if now is not None:
                    done.append(now)
                key = x["conv_key"]
                now = {"conv_id": x["conv_id"], "first": None, "last": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": x["cost"], "audit": [], "hash": hashlib.sha256(), "lines": 0, "initial": None}
            for name in ("blank", "duplicate", "truncated", "illegal"):
                now[name] += x[name]
            if x["first_initial"] is not None:
                now["illegal"] += now["initial"] is not None and now["initial"] + x["first_initial"] not in LEGAL
                now["initial"] = x["last_initial"]
            if x["first_turn"] is not None:
                now["distinct"] += x["n_distinct"] - (now["last"] == x["first_turn"])
                now["first"], now["last"] = x["first_turn"] if now["first"] is None else now["first"], x["last_turn"]
            now["audit"].append(x["audit"])
            if x["n_lines"]:
                now["hash"].update(("\n" if now["lines"] else "").encode() + x["repaired"].encode())
                now["lines"] += x["n_lines"]
        if len(done) >= 1000:
            yield _closed(done, kind)
            done = []
    if now is not None:
        yield _closed([*done, now], kind)


def _closed(done: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    rows = [x | {"gaps": gaps_of(x["first"], x["last"], x["distinct"]), "audit": "".join(x["audit"]), "repaired_sha256": x["hash"].hexdigest()} for x in done]
    return pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in kind} for r in rows], schema=kind)


def _solved(messages: DataFrame, texts: bool, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """The segments, and the pieces of those that are open with all that their results need."""
    spark = messages.sparkSession
    with arrow_bytes(spark, "16m"):
        cells = cut(segments(messages, texts, most_rows), "segments")
        open_ = cells.where("NOT done").withColumn("conv_key", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
        facts = open_.select("conv_key", "part", "seq", "marks").join(_late(open_), ["part", "seq"], "left").select("conv_key", "part", "seq", "marks", "late")
        marked = cut(facts.mapInPandas(_costs, "conv_key string, part int, seq int, marks string, more int, costs array<long>"), "costs")
        after = marked.select("conv_key", "part", "seq", "costs").groupBy("conv_key").applyInPandas(_chain_back, "part int, seq int, after array<long>, last boolean")
        ahead = cut(marked.drop("costs").join(after, ["part", "seq"]), "ahead")
        entry = ahead.select("conv_key", "part", "seq", "marks", "after").mapInPandas(_exits, "conv_key string, part int, seq int, exits array<int>").groupBy("conv_key").applyInPandas(_chain_forth, "part int, seq int, entry int")
        known = open_.select("conv_id", "part", "seq", "blank", "duplicate", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "n_distinct", "roles", "texts")
        x = known.join(ahead.join(entry, ["part", "seq"]), ["part", "seq"]).withColumn("duplicate", F.col("duplicate") + F.col("more"))
        x = x.withColumn("truncated", F.regexp_count("marks", F.lit("[SUAO]")).cast("long")).drop("more")
        schema = _with_conv(messages, f"part int, seq int, blank long, duplicate long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, n_distinct long, conv_key string, marks string, truncated long, cost long, audit string, n_lines long, repaired string, lines {LINES}")
        pieces = cut(x.select("conv_id", "part", "seq", "blank", "duplicate", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "n_distinct", "conv_key", "marks", "truncated", "after", "last", "entry", "roles", "texts").mapInPandas(_pieces(texts), schema), "pieces")
    drop_cut(marked)
    drop_cut(ahead)
    return cells, pieces


def repair(messages: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each conversation of messages (conv_id, turn, role, text, gone): gaps in its turns, first faults, illegal neighbours,
    the least cost, its audit and the hash of the repaired conversation, role:text a line."""
    cells, pieces = _solved(messages, False, most_rows)
    schema = _with_conv(messages, RESULT)
    kind = _arrow(schema)
    ordered = pieces.repartition("conv_key").sortWithinPartitions("conv_key", "part", "seq")
    return cells.where("done").select(*schema.names).unionByName(ordered.mapInArrow(lambda batches: _results(batches, kind), schema))


def repaired_messages(messages: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The messages of the repaired conversations: conv_id, part, seq and at (their order), edit (K kept, R with another role, I inserted), role, text."""
    cells, pieces = _solved(messages, True, most_rows)
    both = cells.where("done").select("conv_id", "part", "seq", "lines").unionByName(pieces.select("conv_id", "part", "seq", "lines"))
    return both.select("conv_id", "part", "seq", F.posexplode("lines").alias("at", "x")).select("conv_id", "part", "seq", "at", "x.edit", "x.role", "x.text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
