"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from repolith.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def least(symbols):
    """(cost, audit) over all edits, by trying each at every message. symbols: (initial, must go, cut off)."""
    accepts = re.compile("(s?(ua)+)?")

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(symbols):
            if accepts.fullmatch({0: "", 1: "s", 2: "su", 3: "sua"}[state]):
                found.append((0, ""))
        else:
            initial, gone, cut = symbols[i]
            found.append(extend(3, "D", best(i + 1, state, 3)))
            if not gone:
                if (to := step(state, initial)) is not None:
                    found.append(extend(cut, "K", best(i + 1, to, 3)))
                for other in "ua":
                    if (to := step(state, other)) is not None:
                        found.append(extend(2 + cut, "R", best(i + 1, to, 3)))
        if inserts:  # three in a row at most: more never pay
            for other in "ua":
                if (to := step(state, other)) is not None:
                    found.append(extend(2, "I", best(i, to, inserts - 1)))
        return min((x for x in found if x), default=None)

    def extend(cost, letter, rest):
        return rest and (cost + rest[0], letter + rest[1])

    def step(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))

    return best(0, 0, 3)


def expected(rows):
    """Results by conversation, row by row."""
    space = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, fault = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if fault == 0:
                continue
            if fault == 1:
                text = ""
            if fault == 2:
                text = re.sub("[.!?]", "", text)
            if fault == 4:
                role = "user"
            live += [(turn, role, text)] * (2 if fault == 3 else 1)
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in live:
            bare = text.rstrip(SPACE)
            first = 0 if not bare.strip(SPACE) else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if first is not None:
                counts[first] += 1
            seen.add((role, text))
            symbols.append((role[:1], first in (0, 1), int(first == 2)))
        cost, audit = least(tuple(symbols))
        lines, left = [], iter(live)
        last = None  # the role before
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            role, text = (row[1], row[2]) if letter == "K" else ("assistant" if last == "u" else "user", "" if row is None else row[2])
            last = role[0]
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in live if t is not None]
        initials = [r[:1] for _, r, _ in live]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def made(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "a b", "", " \t", None, "What?\n", "long. tail", "x .", "é?", "."]
    rows = []
    for c in range(conversations):
        for _ in range(rng.choice([0, 1, 2, 5, most]) or 1):
            rows.append((None if c == 3 else c, rng.choice([None, *range(most)]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "User", "sys"]), rng.choice(texts + [f"w{rng.random()}."] * 8)))
    return rows


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("most_rows", [1, 3, cr.MOST_ROWS])
def test_repair_is_the_search_over_all_edits(spark, most_rows):
    rows = made(5, 60, 24) + made(6, 60, 24)[:200]
    got = results(cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA)), most_rows))
    assert got == expected(rows)


def test_a_large_conversation_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(7, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{rng.random()}!", ""])) for _ in range(400)] + [(7, 5, "user", "same.")] * 100 + [(8, 1, "user", "a.")]
    want = expected(rows)
    for most_rows in (16, cr.MOST_ROWS):
        assert results(cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA).repartition(4)), most_rows)) == want


def test_distances_are_shortest_paths():
    rng = random.Random(3)
    for _ in range(200):
        marks = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(9)))
        symbols = tuple((m.lower(), m == "x", int(m.isupper())) for m in marks)
        assert cr.cheapest(marks) == least(symbols)
        # Cut anywhere, the costs through the parts are the same.
        k = rng.randrange(len(marks) + 1)
        after = cr.distances(marks[k:], cr.ENDS)[:4]
        assert cr.distances(marks[:k], after)[0] == cr.cheapest(marks)[0]


def test_messages_of_the_repair(spark):
    rows = made(2, 20, 12)
    damaged = cr.damage(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in cr.repaired_messages(damaged, 2).orderBy("conv_id", "part", "seq", "at").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for conv, want in expected(rows).items():
        mine = lines.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == want[-1]
        assert "".join(r.edit for r in mine) == want[-2].replace("D", "")
        assert all(r.text == "" for r in mine if r.edit == "I")


def test_empty_table_dropped_rows_and_extra_columns(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, dropped, "user", "a.", 1, 2)], SCHEMA + ", fault int, seq int")
    assert results(cr.repair(cr.damage(df))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_whole_table(spark):
    from repolith.llm.entry import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(queries()["op11_conversation_repair"](spark, "/root/testdata/sf0.001")) == expected(rows)
