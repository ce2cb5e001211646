"""Exact dedup, Jaccard join, WARC, quotes, pipeline: against brute force and SQL, with odd rows and hot groups."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolith.llm import chat_quotes, exact_dedup, jaccard_join, warc
from repolith.llm.exact_dedup import DigestIndex


def twin(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    r = c.sql(sql)
    return sorted(repr([x[r.columns.index(k)] for k in sorted(r.columns)]) for x in r.fetchall())


def same(df):
    return sorted(repr([r[k] for k in sorted(df.columns)]) for r in df.collect())


DOCS = "doc_id long, text string, lang string, n_chars long, digest string, rep long"


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, "en", 1, "clash", 5) for i, t in rows], DOCS)


# --- exact dedup ------------------------------------------------------------------------


def test_dedup_matches_sql(spark):
    docs = documents(spark, (1, "A b"), (5, "a B"), (3, "É"), (4, "é"), (7, None), (8, ""), (None, "a b"), (9, "x" * 200_000), (9, "x" * 200_000))
    index = DigestIndex.fresh(spark, 4)
    index.add(docs)
    assert same(index.lookup(docs)) == twin(exact_dedup.SQL, documents=docs)
    kept = index.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8, 9]


def test_index_is_persistent(spark):
    index = DigestIndex.fresh(spark, 4)
    index.add(documents(spark, (1, "a"), (2, "b")))
    more = documents(spark, (10, "A"), (11, "c"), (12, "c"))
    index.add(more)
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.lookup(more).collect()}
    assert got == {10: (1, False), 11: (12, False), 12: (12, True)}
    assert [r.doc_id for r in index.dedup(more).collect()] == [12]
    index.add(documents(spark))
    assert index.rows().count() == 3
    plan = index.spark.table(index.table)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def test_index_goes_through_the_anti_join(spark):
    index = DigestIndex.fresh(spark, 4)
    assert spark.catalog.tableExists(index.table) and index.rows().count() == 0
    batches = [documents(spark, (1, "a"), (2, "b"), (3, "A")), documents(spark, (4, "a"), (5, "c"), (6, "b"), (7, "C")), documents(spark, (8, "c"))]
    for batch in batches:
        index.add(batch)
    assert sorted((r.keep_id, r.group_size) for r in index.rows().collect()) == [(2, 1), (3, 2), (7, 2)]
    index.drop()
    assert not spark.catalog.tableExists(index.table)


def test_dedup_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z"), (2, "A", "x", "y", "z")], "doc_id long, text string, text_sha256 string, stays string, kept_id string")
    index = DigestIndex.fresh(spark, 2)
    index.add(docs)
    kept = index.dedup(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "A", "x", "y", "z")]


def test_empty_tables(spark):
    none = documents(spark)
    index = DigestIndex.fresh(spark, 2)
    index.add(none)
    assert index.lookup(none).count() == 0 and index.dedup(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0


# --- Jaccard ------------------------------------------------------------------------------


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = [w for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        k = min(width, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, n=140):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400))
    shared = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(90)]
    for i in range(n):
        kind = i % 7
        if kind == 0:
            text = [word() for _ in range(rng.randrange(0, 9))]
        elif kind == 1:
            text = [word() for _ in range(60)] + shared
        elif kind == 2:
            text = shared + [word() for _ in range(rng.randrange(8, 14))]
        else:
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text) if i % 11 else " ".join(text).upper()))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "é\x0bÉ"), (n + 4, "É\x0cé"), (n + 5, "One two"), (n + 6, "one TWO")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_components_match_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    p = jaccard_join.Params(width=width, percent=percent, counters=1 << 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, *rows), p).collect()}
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize(("counters", "percent"), [(1 << 6, 85), (1 << 12, 85), (1 << 12, 80), (1 << 18, 85)])
def test_one_sided_copies_match_brute_force(spark, counters, percent):
    rng = random.Random(counters + percent)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9000))
    rows = []
    for i in range(60):
        text, extra = [word() for _ in range(203)], [word() for _ in range(rng.choice([16, 26, 32, 36]))]
        at = rng.randrange(20, 180)
        copy = [text + extra, text[:at] + extra + text[at:], text[: -len(extra)], extra + text][i % 4]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    rows += [(1000 + i, " ".join(word() for _ in range(203))) for i in range(60)]
    p = jaccard_join.Params(percent=percent, counters=counters)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, *rows), p).collect()}
    assert got == brute(rows, 4, percent)


def test_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    near = text.replace("w49", "other")
    docs = documents(spark, (5, text), (5, text), (9, near), (None, text), (2, "alone"))
    got = jaccard_join.jaccard_components(docs, jaccard_join.Params(counters=1 << 12)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(2, 1, 2), (5, 47, 5), (5, 47, 5), (9, 47, 5)]
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == 5


def test_bound_never_refuses_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for counters in (1 << 4, 1 << 12):
        table = rng.integers(0, 6, counters).astype(np.uint8)
        for _ in range(300):
            base = np.unique(rng.integers(0, 1 << 62, rng.integers(6, 200)).astype(np.uint64))
            other = base.copy()
            k = rng.integers(0, max(1, len(base) // 8))
            other[rng.choice(len(base), k, replace=False)] = rng.integers(0, 1 << 62, k)
            other = np.unique(other)
            if jaccard_join.links(base, other, 85):
                for order in range(3):
                    a, b = (np.frombuffer(jaccard_join.signature(x, jaccard_join.class_of(table, x), order, 85), np.uint32) for x in (base, other))
                    assert jaccard_join.may_share(a, b, len(base), len(other), 85)


def test_halves_of_keys_that_collide_refuse_no_link():
    import numpy as np

    # Keys whose upper halves are all alike: nothing can be told apart, so that nothing may be refused.
    a = np.full(3, 7, np.uint32)
    assert jaccard_join.may_share(a, a.copy(), 10, 10, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_differences_find_every_link_that_leaders_leave(percent):
    """Members that link with each other but not through the leader share a token of their differences' prefixes, within the bound."""
    import numpy as np

    rng = np.random.default_rng(percent)
    seen = 0
    for _ in range(60):
        table = rng.integers(0, 12, 1 << 8).astype(np.uint8)
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(30, 150)).astype(np.uint64))
        middle = [base]
        for _ in range(3):
            y = base.copy()
            y[rng.choice(len(y), len(y) // 7, replace=False)] = rng.integers(0, 1 << 62, len(y) // 7)
            middle.append(np.unique(y))
        members = []
        for _ in range(24):
            y = middle[rng.integers(4)].copy()
            k = rng.integers(0, len(y) // 6)
            y[rng.choice(len(y), k, replace=False)] = rng.integers(0, 1 << 62, k)
            members.append(np.unique(y[rng.random(len(y)) > rng.choice([0, 0.05])]).astype(np.uint64))
        c = members[0]
        near = int(rng.choice([40, 60, 75]))
        found = [jaccard_join.difference(x, c, jaccard_join.class_of(table, x), jaccard_join.class_of(table, c), percent, near) for x in members]
        for i, x in enumerate(members):
            assert found[i].linked == jaccard_join.links(x, c, percent)
            for j in range(i):
                y = members[j]
                if not jaccard_join.links(x, y, percent) or (found[i].linked and found[j].linked):
                    continue
                seen += 1
                if found[i].far and found[j].far:
                    continue  # both stay in the old list
                assert found[i].close and found[j].close
                at = {t: k for k, t in enumerate(found[i].tokens.tolist())}
                first = next((k, at[t]) for k, t in enumerate(found[j].tokens.tolist()) if t in at)
                rest = min(found[j].size - first[0], found[i].size - first[1])
                assert 2 * (100 + percent) * rest >= found[i].need + found[j].need
    assert seen > 200


def near_copies(n, seed):
    """One text with ever more changed words, mostly other ones; some changes are those of an earlier copy."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = [base]
    for _ in range(n):
        text = list(rng.choice(texts) if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(0, 11)):
            text[rng.randrange(len(text))] = word()
        at = rng.randrange(140)
        texts.append(text[:at] + [word() for _ in range(rng.choice([0, 0, 0, 8, 30]))] + text[at:])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "short", "levels"), [(5, 80, 24, 2), (4, 85, 2, 3), (5, 80, 1, 0)])
def test_large_groups_of_near_copies_match_brute_force(spark, width, percent, short, levels):
    rows = near_copies(200, width + percent)
    p = jaccard_join.Params(width=width, percent=percent, counters=1 << 12, short=short, short_later=short, levels=levels)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, *rows), p).collect()}
    assert got == brute(rows, width, percent)


def templated(rng, rows, slots):
    """Texts of one template: each slot holds one of two phrases."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    phrases = [[" ".join(word() for _ in range(6)) for _ in range(2)] for _ in range(slots)]
    return [" ".join(p[rng.integers(2)] for p in phrases) for _ in range(rows)]


def test_templated_texts_make_few_pairs(spark, monkeypatch):
    """Twice the rows, some twice the pairs: lists of texts that share common shingles alone aren't looked at pair by pair."""
    looked = []
    real = jaccard_join.met

    def met(lists, p):
        out = real(lists, p)
        looked.append(out.distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "met", met)
    made, seen = templated(np.random.default_rng(3), 800, 60), []
    for n in (400, 800):
        looked.clear()
        rows = list(enumerate(made[:n])) + [(5000 + k, made[k] + " tail") for k in range(20)]
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, *rows)).collect()}
        assert got == {i: i if i < 5000 else i - 5000 for i, _ in rows}
        seen.append(sum(looked))
    assert seen[1] < 3 * seen[0] + 500 and seen[1] < 800 * 20


@pytest.mark.parametrize("orders,percent", [(4, 85), (9, 80)])
def test_links_meet_in_bands(orders, percent):
    p = jaccard_join.Params(percent=percent)
    rng = np.random.default_rng(orders)
    bands = int(np.ceil(np.log(p.escape) / np.log1p(-((percent / 100) ** orders))))
    for _ in range(60):
        n = int(rng.integers(7, 200))
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[: int(np.ceil(n * percent / 100))]])
        assert jaccard_join.links(np.sort(x), np.sort(y), percent)
        assert (jaccard_join.band_keys(np.sort(x), orders, bands) == jaccard_join.band_keys(np.sort(y), orders, bands)).any()
    assert not (jaccard_join.band_keys(np.arange(9, dtype=np.uint64), orders, bands) == jaccard_join.band_keys(np.arange(50, 99, dtype=np.uint64), orders, bands)).any()


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """From twice as many near copies come about twice as many pairs, not four times."""
    made = []
    sharing = jaccard_join.sharing
    monkeypatch.setattr(jaccard_join, "sharing", lambda pairs, *a: made.append(pairs.count()) or sharing(pairs, *a))
    sums = []
    for n in (300, 600):
        made.clear()
        jaccard_join.jaccard_components(documents(spark, *near_copies(n, 9)), jaccard_join.Params(counters=1 << 14))
        sums.append(sum(made))
    assert sums[1] < 3 * sums[0] and sums[1] < 30 * 600


def test_ids_are_joined_by_a_shuffle_beyond_the_broadcast_bound(spark):
    rows = corpus(4)
    p = jaccard_join.Params(counters=1 << 12, broadcast_ids=0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, *rows), p).collect()}
    assert got == brute(rows, 4, 85)


def test_rows_that_share_an_id_are_one_node(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    got = jaccard_join.jaccard_components(documents(spark, (1, text), (2, text), (2, other), (3, other), (4, "alone")), jaccard_join.Params(counters=1 << 12)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


# --- WARC -----------------------------------------------------------------------------------


def pages(spark):
    big, other = "<p>" + "é" * 600, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (7, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "WARC/1.1\r\n\r\n", "WARC/1.1\r\n\r\n\r\n" * 100), (9, "u", other), (None, "u", other), (10, "u", "z" * 999), (11, "u", "z" * 999), (7, None, big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, first string")


def test_warc_round_trip_matches_sql(spark, tmp_path):
    p = pages(spark)
    p.write.parquet(f"{tmp_path}/pages.parquet")
    assert same(warc.op6_warc(spark, str(tmp_path))) == twin(warc.SQL, pages=p)


def test_warc_payloads_and_transactions(spark, tmp_path):
    warc.write(pages(spark), f"file://{tmp_path}/w")
    records = warc.read(spark, f"file://{tmp_path}/w").cache()
    assert {r.kind: r.n for r in records.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()} == {"request": 13, "metadata": 13, "revisit": 3, "response": 10}
    got = warc.captures(records).collect()
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in got)
    bodies = {bytes(r.capture.payload) for r in got if r.capture.kind == "response"}
    assert ("<p>" + "é" * 600).encode() in bodies and b"WARC/1.1\r\n\r\n\r\n" * 100 in bodies
    for r in got:
        if r.capture.kind == "response":
            assert r.capture.payload_sha1 == hashlib.sha1(bytes(r.capture.payload)).hexdigest() == r.capture.declared.removeprefix("sha1:")


def test_warc_records_are_tied_from_either_side(spark, tmp_path):
    def rec(kind, rid, *fields, block=b""):
        lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *fields, b"Content-Length: %d" % len(block), b"", block]
        return b"\r\n".join(lines) + b"\r\n\r\n"

    to = lambda *ids: [b"WARC-Concurrent-To: " + i for i in ids]
    data = rec(b"warcinfo", b"<i>") + rec(b"request", b"<q1>") + rec(b"response", b"<r1>", *to(b"<q1>", b"<m1>"), block=b"one") + rec(b"metadata", b"<m1>", block=b"a: b")
    data += rec(b"response", b"<r2>", block=b"two") + rec(b"request", b"<q2>", *to(b"<r2>")) + rec(b"metadata", b"<m2>", *to(b"<r2>", b"<q2>")) + rec(b"metadata", b"<m3>", *to(b"<r2>")) + rec(b"request", b"<q3>")
    (tmp_path / "w.warc").write_bytes(data)
    got = {r.record_id: ([q.record_id for q in r.requests], [m.record_id for m in r.metadata]) for r in warc.captures(warc.read(spark, f"file://{tmp_path}/w.warc")).collect()}
    assert got == {"<r1>": (["<q1>"], ["<m1>"]), "<r2>": (["<q2>"], ["<m2>", "<m3>"])}


def test_warc_keeps_urls_and_bounds_files(spark, tmp_path):
    rows = [(1, "http://a", "x" * 1200), (1, "http://b", "x" * 1200), (2, "http://c", "x" * 1200), *((i, f"http://d/{i}", f"{i}" + "y" * 70_000) for i in range(3, 9))]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(p, f"file://{tmp_path}/w", file_bytes=150_000)
    got = warc.captures(warc.read(spark, f"file://{tmp_path}/w")).collect()
    assert sorted(r.capture.uri for r in got) == sorted(u for _, u, _ in rows)
    response = next(r.record_id for r in got if r.capture.uri == "http://c")
    assert {r.capture.uri: r.capture.refers_to for r in got if r.capture.kind == "revisit"} == {"http://a": response, "http://b": response}
    assert len([f for f in (tmp_path / "w").iterdir() if f.suffix == ".gz"]) >= 4


def test_warc_of_no_pages(spark, tmp_path):
    pages(spark).limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0


# --- quotes ----------------------------------------------------------------------------------


def talk(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, lines string")


TALK = [
    (1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> hello   THERE\nHi!"), (1, 2, "u", "> > Hello there\n> Hi!\nfine"), (1, 3, "a", "no quote"), (1, 4, "u", ">> fine\n\n> nothing like it\nok"),
    (2, 0, "u", "> Hello there"), (2, 1, "a", "one\n\ntwo\nthree\n\nfour"), (2, 2, "u", "> two\n> three\nyes"), (2, 3, "a", ">"), (None, 4, "u", "> yes"), (2, None, "u", "> yes"), (3, 0, "u", None), (3, 1, "a", ""), (3, 1, "a", ""), (4, 0, "u", "x " * 20_000),
]


def test_quotes_match_sql_and_meaning(spark, tmp_path):
    df = talk(spark, *TALK)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_quotes.op5_chat_quotes(spark, str(tmp_path))
    assert same(out) == twin(chat_quotes.SQL, conversations=df)
    got = {(r.conv_id, r.turn): (r.reply_to_turn, r.root_turn, r.n_quoted) for r in out.collect()}
    assert got[1, 1] == (0, 0, 1) and got[1, 2] == (1, 0, 2) and got[1, 4] == (2, 0, 2) and got[2, 0] == (None, 0, 1) and got[2, 2] == (1, 1, 2)
    assert {r.own_text for r in chat_quotes.link(df).where("conv_id = 1 AND turn = 2").collect()} == {"fine"}


def test_threads_that_branch_have_depths(spark):
    rows = [(1, 0, "u", "root"), (1, 1, "a", "> root\nleft"), (1, 2, "a", "> root\nright"), (1, 3, "u", "> left\nleaf"), (1, 4, "u", "alone"), (1, 5, "u", "> right\n> > root\nother leaf")]
    got = {r.turn: (r.reply_to_turn, r.root_turn, r.depth) for r in chat_quotes.link(talk(spark, *rows)).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 1), 2: (0, 0, 1), 3: (1, 0, 2), 4: (None, 4, 0), 5: (2, 0, 2)}


def test_messages_of_many_passages(spark):
    text = "\n".join(f"> quote {k}\nanswer {k}" for k in range(20_000))
    got = chat_quotes.link(talk(spark, (1, 0, "u", "quote 7\nquote 19999"), (1, 1, "a", text))).where("turn = 1").first()
    assert (got.reply_to_turn, got.root_turn, got.depth, got.n_quoted) == (0, 0, 1, 20_000)


def test_trimmed_quotes_of_several_lines_link(spark):
    text = "one\ntwo  TWO\nthree\n\nfour\nfive\n\nsix"
    quotes = ["two two\nthree", "one\ntwo two\nthree\n\nfour\nfive", "three\n\nfour", "two two\nthree\nfour\nfive\nsix", "one\nthree", "four\nthree", "three\nfour\nfive\nsix\nseven"]
    rows = [(1, 0, "u", text), *((1, k, "a", "".join(f"> {x}\n" for x in q.split("\n")) + f"answer {k}") for k, q in enumerate(quotes, 1)), (2, 9, "a", "> two two\n> three")]
    df = chat_quotes.link(talk(spark, *rows))
    got = {(r.conv_id, r.turn): (r.reply_to_turn, r.root_turn) for r in df.collect()}
    assert got == {(1, 0): (None, 0), (2, 9): (None, 9)} | {(1, k): (0, 0) if k <= 4 else (None, k) for k in range(1, 8)}


def test_trimmed_quotes_match_sql(spark, tmp_path):
    """The twin knows runs of lines too."""
    rng = random.Random(12)
    lines = ["one", "Two  two", "three", "", "  four", "five five"]
    rows = []
    for conv in range(12):
        said = []
        for turn in range(8):
            quote = []
            if said and rng.random() < 0.8:
                source = rng.choice(said).split("\n")
                k, n = rng.randrange(len(source)), rng.randrange(1, 5)
                quote = ["> " + x.upper() for x in source[k : k + n]]
            own = [rng.choice(lines) for _ in range(rng.randrange(1, 7))] + [f"mine {conv} {turn}"]
            said.append("\n".join(own))
            rows.append((conv, turn, "u", "\n".join(quote + own)))
    df = talk(spark, *rows, (99, 1, "u", "one\nthree"), (99, 1, "u", "two\none\nthree\n"), (99, 2, "u", "> one\n> three"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat_quotes.op5_chat_quotes(spark, str(tmp_path)).cache()
    assert same(out) == twin(chat_quotes.SQL, conversations=df)
    assert out.where("reply_to_turn IS NOT NULL").count() > 30


def test_many_lines_and_many_lengths_take_no_runs_of_all(spark):
    """Runs are made where a quote may begin, not at every line for every length."""
    text = "\n".join(f"line {k}" for k in range(3000))
    quotes = [(1, n, "a", "\n".join(f"> line {100 + k}" for k in range(n)) + "\nok") for n in range(2, 150)]
    df = talk(spark, (1, 0, "u", text), *quotes)
    m = chat_quotes.with_lines(df.select("conv_id", "turn", "role", "text")).withColumn("own_text", chat_quotes.own_text(F.col("lines")))
    quoting = spark.createDataFrame([(1, hashlib.sha256(b"line 100").hexdigest(), n) for n in range(2, 150)], "conv_id long, first string, n_lines int")
    assert chat_quotes.line_runs(m, quoting).count() == 148
    assert {r.reply_to_turn for r in chat_quotes.link(df).where("turn > 0").collect()} == {0}


def test_long_chains_and_no_quotes(spark):
    chain = [(1, k, "u", f"> line {k - 1}\nline {k}" if k else "line 0") for k in range(40)]
    assert {r.root_turn for r in chat_quotes.link(talk(spark, *chain)).collect()} == {0}
    plain = chat_quotes.link(talk(spark, (1, 0, "u", "a"), (1, 1, "a", "a")))
    assert [r.reply_to_turn for r in plain.collect()] == [None, None]
    assert chat_quotes.link(talk(spark, (1, 0, "u", "a")).limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    for df in (chat_quotes.link(talk(spark, *TALK)), exact_dedup.with_digest(documents(spark, (1, "a")))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(80))
        junk, toxic = i % 6 == 0, i % 6 == 1
        rows.append((i, " | ".join(text.split()) if junk else f"{text} vile{word()[:2]} {word()}" if toxic else text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    clean = [r for r in rows if r[0] % 6 > 1]
    a, b = clean[0][1], clean[1][1]
    rows += [(1000, a.upper(), "en", "s", 1), (1001, b.replace(b.split()[40], "changed"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    at, kept = docs, {r[0] for r in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/s{k}")
        at = spark.read.parquet(f"{tmp_path}/s{k}")
        now = {r.doc_id for r in at.select("doc_id").collect()}
        assert now <= kept
        if k == 0:
            assert len([i for i in kept - now if i % 6 == 0 and i < 1000]) >= 38 and len(kept - now) <= 42
        if k == 2:
            assert kept - now >= {clean[0][0]} and 1000 in now
        if k == 3:
            assert 1001 not in now and clean[1][0] in now
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_warc_archives_are_parsed_once(spark, tmp_path, monkeypatch):
    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    asked, captures = [], warc.captures
    monkeypatch.setattr(warc, "captures", lambda records: asked.extend(records.inputFiles()) or captures(records))
    assert warc.op6_warc(spark, str(tmp_path)).count() > 0
    assert asked and not [x for x in asked if x.endswith(".gz")]
