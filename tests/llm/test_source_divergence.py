"""Source divergence against row-by-row arithmetic in Python and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from repolith.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")
DOWN = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def terms_of(text):
    return [t.translate(DOWN) for t in TERM.findall(text or "")]


def expected(rows, least_docs):
    n, docs, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for x, t in docs if x == lang and docs[lang, t] >= least_docs)
        names = sorted((s for x, s in groups if x == lang), key=str.encode)
        whole = Counter()
        for s in names:
            whole.update(n[lang, s])

        def p_of(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = p_of(whole), {s: p_of(n[lang, s]) for s in names}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in names if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= 10}
    return out


def made(seed, count):
    rng = random.Random(seed)
    words = ["a", "B", "é", "É", "ab", "Ab", "日本", "x1y", "long" * 9, "\x00nul", "a b", "[z]", "it's", *(f"w{chr(97 + k)}" for k in range(20))]
    return [(k, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(40)))]) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(9)),
             rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "s1", "s2", "hot", "hot", "hot", "é", "z"])) for k in range(count)] + [(0, None, "xx", "only"), (1, "a", "yy", "u"), (2, "b", "yy", "v")]


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.mark.parametrize("cells,width", [(sd.CELLS, sd.SOURCES), (7, 2), (1, 1)])
def test_audit_is_plain_arithmetic(spark, cells, width):
    rows = made(1, 160)
    got = rows_of(sd.audit(spark.createDataFrame(rows, SCHEMA), 4, cells, width))
    assert len(got) == len(set(got)) and set(got) == expected(rows, 4)


def test_sql_agrees(spark):
    rows = made(2, 300)
    con = duckdb.connect()
    documents = pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows)))))
    con.register("documents", documents)
    want = {tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sd.SQL})").fetchall()}
    assert set(rows_of(sd.audit(spark.createDataFrame(rows, SCHEMA)))) == want == expected(rows, 10)


def test_terms_by_bytes():
    texts = ["Ab cd", None, "", "ab", "éÀx-É9é", "\x7fz\x80", "tail", "Head"]
    data, bounds = sd.buffer_of(pa.array(["skipped", *texts]).slice(1))
    data = sd.LOWER[data]
    starts, ends = sd.boundaries(data, bounds)
    doc = np.searchsorted(bounds, starts, "right") - 1
    raw = data.tobytes()
    assert [(d, raw[a:b].decode()) for d, a, b in zip(doc.tolist(), starts, ends)] == [(k, t) for k, x in enumerate(texts) for t in terms_of(x)]


@pytest.mark.parametrize("weak", [lambda b: 0, lambda b: len(b), lambda b: b[0] % 3])
def test_equal_hashes_are_told_apart(weak):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    code, first = sd.grouped(data, starts, ends, weak)
    assert [words[first[c]] for c in code] == words and len(first) == len(set(words))


def test_probability_is_exact():
    rng = random.Random(6)
    for _ in range(500):
        whole = rng.randrange(1, 9 * 10**15)
        n = rng.randrange(max(1, whole - 1)) if rng.random() < 0.8 else 0
        assert sd.probability(np.array([n]), np.int64(max(whole, n + 2)))[0] == 1 + 10**9 * (n + 2) // max(whole, n + 2)


def test_empty_table_and_extra_columns(spark):
    assert sd.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "x"), (2, "b", "en", "t", 1, "x")], SCHEMA + ", n long, term string")
    assert set(rows_of(sd.audit(df, 1))) == expected([(1, "a", "en", "s"), (2, "b", "en", "t")], 1)
