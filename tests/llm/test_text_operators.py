"""Classifiers, counts, codec, packing, media: whole texts, empty, null and long ones, repeated rows, empty tables, clashing columns."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolith.llm import media, packing, quality, sp_codec, token_counts, toxicity

DOCS = "doc_id long, text string, score double, label string"
SMALL_Q = quality.Params(buckets=1 << 12, train_rows=200, epochs=8)
SMALL_T = toxicity.Params(buckets=1 << 14, train_rows=200, root=0.0)


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, 9.0, "x") for i, t in enumerate(texts)], DOCS)


def labelled(spark, bad, good, n=80):
    texts = [f"{bad} word{i} more{i % 7}" if i % 2 else f"{good} word{i} more{i % 7}" for i in range(n)]
    return documents(spark, *texts), spark.createDataFrame([(i, 1 - i % 2) for i in range(n)] + [(0, None), (None, 1)], "doc_id long, label int")


@pytest.mark.parametrize(("op", "p"), [(quality, SMALL_Q), (toxicity, SMALL_T)])
def test_classifier_learns_and_handles_odd_rows(spark, op, p):
    docs, labels = labelled(spark, "awful%%% junk%%%", "fine prose")
    model = op.train(docs, labels, p)
    odd = spark.createDataFrame([(100, "fine prose again", 1.0, "y"), (101, "awful%%% junk%%%", 1.0, "y"), (102, None, 1.0, "y"), (103, "", 1.0, "y"), (None, "fine prose again", None, None), (100, "fine prose again", 1.0, "y"), (104, "fine prose " * 50_000, 1.0, "y")], DOCS)
    got = [(r.doc_id, r.s) for r in op.score(odd, model, p, keep=odd.columns, into="s").collect()]
    by = dict(got)
    assert len(got) == 7 and by[100] > 0.5 > by[101] and by[102] == by[103] and by[None] == by[100]
    assert all(0 <= s <= 1 for _, s in got)
    assert by[104] > 0.5
    assert op.score(odd.limit(0), model, p).count() == 0


@pytest.mark.parametrize(("op", "p"), [(quality, SMALL_Q), (toxicity, SMALL_T)])
def test_classifier_without_labels(spark, op, p):
    docs = documents(spark, "a", "b")
    model = op.train(docs, spark.createDataFrame([], "doc_id long, label int"), p)
    assert [r.score for r in op.score(docs, model, p).collect()] == [0.5, 0.5]


def test_quality_counts_the_middle_of_long_words(spark):
    f = lambda w: quality.word_features(w, SMALL_Q.grams, SMALL_Q.buckets).tolist()
    word = "a" * 32 + "bcdefg" * 1000 + "z" * 32
    marked = f"<{word}>"
    assert f(word) == [zlib.crc32(x.encode()) % SMALL_Q.buckets for x in (marked, *(marked[i : i + g] for g in SMALL_Q.grams for i in range(len(marked) - g + 1)))]
    edge = lambda middle: "a" * 32 + middle * 1000 + "z" * 32
    bad, good = edge("junk%%"), edge("文字列を書く")
    docs = documents(spark, *([bad, good] * 40))
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int"), SMALL_Q)
    scores = [r.score for r in quality.score(documents(spark, bad, good), model, SMALL_Q).collect()]
    assert scores[0] < 0.5 < scores[1]


def test_held_out_accuracy():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), 5))
    p = toxicity.Params(buckets=1 << 16, l2=1e-3)  # a small sample takes a stronger pull to zero
    rows = [(f"{' '.join(word() for _ in range(30))} {'zqx' + word() if k % 3 == 0 else ''}", int(k % 3 == 0)) for k in range(900)]
    sets = [(np.sort(np.fromiter(set().union(*(toxicity.grams_of(w, p) for w in t.split())), np.int32)), y) for t, y in rows]
    number, bias = toxicity.fit(sets[:700], p)
    right = [(1 / (1 + np.exp(-(bias + number[s].sum()))) >= 0.3) == bool(y) for s, y in sets[700:]]
    assert np.mean(right) > 0.95


# --- tokens ---------------------------------------------------------------------------

ODD = ["", "a<|endoftext|>b c", "é é\ńx", "it's I'll don't\x1cx\x85y 12 3a", "x" * 300 + " " + "y." * 70, "  \n ", "　a b '  s", "İstanbul ΣΑΣ Straße ÀÉ.", "end. End, END", "日本語 テキスト", "<|startoftext|>", "a.b c,d .e ,"]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def lists(batch):
    ids, bounds = batch
    return [ids[a:b].tolist() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def test_word_encoder_is_the_library():
    encode, lib = packing.word_encoder()(), library()
    for texts in (ODD, ODD[::-1], [None, *ODD], [" ".join(ODD) * 50], []):
        assert lists(encode(pa.array(texts, pa.string()))) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_merges_are_the_library_on_made_up_words():
    rng = np.random.default_rng(4)
    encode, lib = packing.word_encoder()(), library()
    letters = list("etaoinshrdlucmfwypvbgkjqxzETAOINéèßñÀØ")
    words = ["".join(rng.choice(letters, rng.integers(1, 36))) + rng.choice(["", "", ".", ",", "..", "'s", "1"]) for _ in range(4000)] + ["a" * n for n in range(1, 70)]
    assert lists(encode(pa.array(words))) == [x.ids for x in lib.encode_batch(words, add_special_tokens=False)]


def test_packed_pieces_are_the_librarys_ids(spark):
    lib, length = library(), 64
    rng = np.random.default_rng(2)
    texts = [None, "", *ODD, *(" ".join("".join(rng.choice(list("abcdeinorst.,'é1"), rng.integers(1, 9))) for _ in range(rng.integers(1, 300))) for _ in range(60))]
    rows = packing.pack(documents(spark, *texts), packing.word_encoder(), length=length).collect()
    want = set()
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want.add((i, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_table_holds_what_it_got():
    from repolith.llm.units import Table

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    table = Table(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 62, 5000), keys)
    assert (table.get(other) == -1).all() and len(table.get(np.zeros(0, np.int64))) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85 .,'sStTéÉßñÑǅİΣ<|>12"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_encoder_on_any_text(text):
    global _pair
    try:
        encode, lib = _pair
    except NameError:
        encode, lib = _pair = packing.word_encoder()(), library()
    assert lists(encode(pa.array([text]))) == [lib.encode(text, add_special_tokens=False).ids]


def lengths_of(spark, lengths):
    fake = lambda: lambda texts: (np.full(sum(lengths_in(texts)), 7, np.uint32), np.concatenate([[0], np.cumsum(lengths_in(texts))]).astype(np.int64))
    lengths_in = lambda texts: [len(t or "") for t in texts.to_pylist()]
    return packing.pack(documents(spark, *("x" * n for n in lengths)), fake, length=16, bins=3).collect()


def check_packed(rows, lengths, length=16):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for part in seqs.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, n in enumerate(lengths):
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, n + 1, length)) and sum(r.length for r in pieces) == n + 1
    return len(seqs)


def test_packing_places_every_piece(spark):
    lengths = [0, 5, 9, 15, 16, 40, 3, 3, 3, 7, 8, 1, 1, 1, 12]
    assert check_packed(lengths_of(spark, lengths), lengths) <= -(-sum(n + 1 for n in lengths) // 16) + 4


def test_packing_is_best_fit_and_closes_the_fullest():
    bins, closed = packing.Bins(10, 2), []
    for n, x in ((6, "a"), (3, "b"), (4, "c")):
        closed += list(bins.put(n, x))
    assert closed == []  # 3 goes to the bin with 4 free, so that 4 opens another
    assert sorted(map(sorted, (i for b in bins.by_free.values() for i in b))) == [["a", "b"], ["c"]]
    assert list(bins.put(8, "d")) == [["a", "b"]]


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    got = packing.pack(df, packing.word_encoder()).collect()
    assert sorted(r.length for r in got) == [1, 1, 3]
    assert {r.ids_crc32 for r in got if r.length == 1} == {zlib.crc32(b"\1\0\0\0")}
    assert packing.pack(df.limit(0), packing.word_encoder()).count() == 0


def test_histogram_answers(spark):
    lengths = [0, 0, 3, 5, 5, 9, 5000, 5000, 70000]
    counted = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    h = token_counts.histogram(counted).cache()
    for r in h.collect():
        assert r.docs == lengths.count(r.n_tokens)
        assert r.docs_ge == sum(n >= r.n_tokens for n in lengths) and r.tokens_ge == sum(n for n in lengths if n >= r.n_tokens)
        assert r.docs_le == sum(n <= r.n_tokens for n in lengths) and r.truncated_tokens == sum(min(n, r.n_tokens) for n in lengths)
    got = {r.context_limit: (r.docs_over, r.truncated_tokens) for r in token_counts.at_limits(h, [4, 4096]).collect()}
    assert got == {k: (sum(n > k for n in lengths), sum(min(n, k) for n in lengths)) for k in (4, 4096)}
    assert {r.p: r.n_tokens for r in token_counts.quantiles(h, [0.5, 1.0]).collect()} == {0.5: 5, 1.0: 70000}
    empty = token_counts.histogram(counted.limit(0))
    assert empty.count() == 0 and token_counts.quantiles(empty, [0.5]).first().n_tokens is None


def test_token_count_query_answers_limits_and_quantiles(spark):
    from repolith.llm.entry import queries

    at = "/root/testdata/sf0.001"
    rows = queries()["op4_token_counts"](spark, at).collect()
    n = [r.n_tokens for r in token_counts.lengths(spark.read.parquet(f"{at}/documents.parquet"), token_counts.byte_bpe()).collect()]
    assert {r.n_tokens: r.docs for r in rows if r.part == "length"} == {k: n.count(k) for k in set(n)}
    assert {r.n_tokens: (r.docs_ge, r.truncated_tokens) for r in rows if r.part == "limit"} == {x: (sum(k > x for k in n), sum(min(k, x) for k in n)) for x in token_counts.LIMITS}
    least = lambda p: min(k for k in n if sum(j <= k for j in n) >= p * len(n))
    assert {r.share: r.n_tokens for r in rows if r.part == "quantile"} == {p: least(p) for p in token_counts.QUANTILES}


def test_token_counts_of_odd_texts(spark):
    got = token_counts.lengths(documents(spark, None, "", "a b", "x" * 100_000), token_counts.byte_bpe()).collect()
    assert [r.n_tokens for r in got][:3] == [0, 0, 2] and got[3].n_tokens > 0


# --- SentencePiece ----------------------------------------------------------------------


def whole_lattice(c, text):
    text = c.normalise(text)
    best = [(0, 0, ())] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - c.longest), j):
            p = c.pieces.get(text[i:j]) or ((-1 - ord(text[i]), c.unknown_key) if j - i == 1 else None)
            if p:
                x = (best[i][0] + p[1], -i, best[i][2] + (p[0],))
                best[j] = x if best[j] is None or x[:2] > best[j][:2] else best[j]
    return [k for p in best[-1][2] for k in ([p] if p >= 0 else [c.byte_id[b] for b in chr(-1 - p).encode()])]


TEXTS = ["", " ", "Hello world", "  two  spaces   here", "日本語 かな́ 🎉\n\ttab", "a" * 300, "mixed▁mark ▁ x", "Étion dans, çouelle"]


@pytest.mark.parametrize("text", TEXTS)
def test_codec_is_the_whole_lattice_and_round_trips(text):
    c = sp_codec.codec()
    assert c.encode(text) == whole_lattice(c, text) == list(c.stream(c.normalise(text)))
    if "▁" not in text:
        assert c.decode(c.encode(text)) == text == sp_codec.Decoder(c).texts(*c.batch(pa.array([text])))[0]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst  .,\né日'"), max_size=200))
def test_codec_on_any_text(text):
    c = sp_codec.codec()
    assert c.encode(text) == whole_lattice(c, text) and c.decode(c.encode(text)) == text


def test_codec_agrees_with_the_library_on_a_unigram_model():
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    c = sp_codec.codec()
    score = lambda ids: sum(m.pieces[i].score for i in ids)  # noqa: E731  the library's single precision may choose another of equal ones
    for t in ("Hello world", "internationalisation of quotations", "die Bundesregierung", "le gouvernement", "x1y22z"):
        assert score(c.encode(t)) == score(lib.encode(t))


@pytest.mark.parametrize("text", ["ab" * 20_000, "internationalisation" * 1500, "日本語x" * 5000, "thequickbrownfox " * 1500])
def test_window_stays_bounded(text):
    """Neither scores nor backpointers grow with the text: paths converge, and what lies before is given out."""
    c = sp_codec.codec()
    text = c.normalise(text)
    taken = 0
    for k, _ in enumerate(c.stream(text)):
        taken = k + 1
    assert taken and c.held <= 8 * c.longest


def test_stream_is_the_whole_lattice_on_long_runs():
    c = sp_codec.codec()
    run = "a" * 60_001  # paths that start at other characters never meet
    assert c.encode(run) == whole_lattice(c, run)
    rng = np.random.default_rng(6)
    for _ in range(20):
        text = "".join(rng.choice(list("aaabceinorst"), 400))
        assert c.encode(text) == whole_lattice(c, text) == list(c.stream(c.normalise(text)))


def test_batches_commit_where_paths_converge(monkeypatch):
    c, calls = sp_codec.codec(), []
    real = sp_codec.Codec.converged
    monkeypatch.setattr(sp_codec.Codec, "converged", staticmethod(lambda *a: calls.append(1) or real(*a)))
    texts = ["internationalisation" * 9, None, "", "short words only", "a\n\nb \n c", " lead", "x" * 99 + " y"]
    assert lists(c.batch(pa.array(texts, pa.string()))) == [whole_lattice(c, t) if t else [] for t in texts]
    assert calls


def test_whole_texts_go_through_the_window(monkeypatch):
    """All ids of whole texts come from windows of the longest piece, and are committed where the paths meet."""
    c, widths, met = sp_codec.codec(), set(), []
    real = sp_codec.Stretch.converged

    def watched(window, back, rows, i, size):
        at = real(window, back, rows, i, size)
        widths.add(window.shape[1])
        met.extend(zip(rows.tolist(), at.tolist(), (at < size[rows]).tolist()))
        for r, k in list(zip(rows.tolist(), at.tolist()))[:50]:  # as one text's search says
            alive = [p for p in range(i + 1, min(i + c.longest, size[r]) + 1) if window[r, p % window.shape[1]] > np.iinfo(np.int64).min]
            assert sp_codec.Codec.converged(alive, [(int(b), 0) for b in back[r]], 0) == k
        return at

    monkeypatch.setattr(sp_codec.Stretch, "converged", staticmethod(watched))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").combine_chunks()
    ids, bounds = c.batch(texts)
    assert widths == {c.longest + 1} and any(early for *_, early in met) and len(ids) > 100_000
    monkeypatch.undo()
    for t, ids_of in list(zip(texts.to_pylist(), lists((ids, bounds))))[:40]:
        assert ids_of == (whole_lattice(c, t[:3000]) if len(t) <= 3000 else ids_of)
        assert c.decode(ids_of) == t


def test_codec_frames(spark):
    df = documents(spark, "one two", None, "")
    enc = sp_codec.encode(df)
    assert [len(r.ids) for r in enc.collect()][1:] == [0, 0]
    assert [r.text for r in sp_codec.decode(enc).collect()] == ["one two", "", ""]
    assert all(r.round_trip for r in sp_codec.digests(df).collect())
    assert sp_codec.encode(df.limit(0)).count() == 0


# --- media ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_samples_round_trip(data):
    payload = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
    avi = media.write_avi(media.encode_samples(payload), 512, 8, info={b"ICMT": b"%d" % len(payload)})
    got, frames, _ = media.load(avi)
    assert got == payload and sum(f.size for f in frames) >= len(payload)


def test_general_decoder_agrees_with_the_fast_one():
    frame = media.Frame(media.encode_samples(bytes(range(256)) * 2)[0])
    fast = np.repeat(np.repeat(frame.samples(), 8, 0), 8, 1)
    assert (fast == frame.luma()).all()


def test_general_decoder_reads_ac_coefficients():
    # One block: DC 0, then run 0 size 2 value 3 at k=1; codes of one and two bits.
    dht = media.segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x00") + media.segment(0xC4, b"\x10" + bytes([0, 2] + [0] * 14) + b"\x02\x00")
    head = b"\xff\xd8" + media.segment(0xDB, b"\0" + b"\x10" * 64) + media.segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0)) + dht + media.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits = "0" + "00" + "11" + "01"  # DC size 0; AC symbol 2, value 3; end of block
    raw = int(bits.ljust(8, "1"), 2).to_bytes(1, "big")
    plane = media.decode_jpeg(head + raw + b"\xff\xd9")
    k = np.arange(8)
    want = 128 + 3 * 16 * np.cos((2 * k + 1) * np.pi / 16) * 0.5 * np.sqrt(0.125)
    assert np.abs(plane.astype(float) - want[None, :]).max() <= 0.51


def test_shots_at_changes():
    dark, light = bytes(4096), bytes([250]) * 4096
    frames = [media.encode_samples(x)[0] for x in (dark, dark, dark, light, light, dark)]
    rows = media.clip_rows(media.write_avi(frames, 512, 512, fps=10))
    assert [(r[1], r[2]) for r in rows] == [(0, 2), (3, 4), (5, 5)] and rows[1][3:] == (0.3, 0.5)


def test_index_order_rules_and_damage(spark):
    a, b = media.encode_samples(bytes(64))[0], media.encode_samples(bytes([9]) * 64)[0]
    avi = media.write_avi([a, b], 512, 8)
    assert media.read_avi(avi)["frames"] == [a, b]
    no_index = avi[: avi.index(b"idx1")]
    no_index = no_index[:4] + struct.pack("<I", len(no_index) - 8) + no_index[8:]
    assert media.read_avi(no_index)["frames"] == [a, b]
    df = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"")), (4, bytearray(avi[:100]))], "media_id long, media binary")
    assert [r.media_id for r in media.clips(df, damaged="skip").select("media_id").distinct().collect()] == [1]
    with pytest.raises(ValueError):
        media.clip_rows(avi[:100])


def test_text_media(spark):
    texts = [None, "", "abc", "é" * 5000, "z" * 64, "abc"]
    got = media.text_media(documents(spark, *texts)).collect()
    for t, r in zip(texts, got, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.store(t)[0]).hexdigest()
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[5][1:]
    assert media.text_media(documents(spark, "a").limit(0)).count() == 0


# --- media that others write -----------------------------------------------------------------


def usual_jpeg(values, with_tables):
    """A greyscale frame of DC blocks, coded with the standard's tables."""
    of = lambda key: {s: (n, c) for (n, c), s in media.huffman(*media.USUAL[key]).items()}
    dc, ac, bits, before = of(0x00), of(0x10), "", 0
    for v in values:
        d = v - 128 - before
        before = v - 128
        s = abs(d).bit_length()
        bits += format(dc[s][1], f"0{dc[s][0]}b") + (format(d if d >= 0 else d + (1 << s) - 1, f"0{s}b") if s else "") + format(ac[0][1], f"0{ac[0][0]}b")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    tables = b"".join(media.segment(0xC4, bytes([k, *c]) + v) for k, (c, v) in media.USUAL.items()) if with_tables else b""
    head = media.segment(0xDB, b"\0" + b"\x08" * 64) + media.segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * len(values), 1, 1, 0x11, 0))
    return b"\xff\xd8" + head + tables + media.segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + data + b"\xff\xd9"


@pytest.mark.parametrize("with_tables", [False, True])
def test_frames_without_tables_take_the_standards(with_tables):
    values = [0, 255, 128, 3, 200, 77, 77, 12]
    plane = media.decode_jpeg(usual_jpeg(values, with_tables))
    assert plane.shape == (8, 64) and plane[3, ::8].tolist() == values


def test_standard_tables_are_prefix_codes():
    for counts, symbols in media.USUAL.values():
        assert sum(counts) == len(symbols) == len(set(symbols)) and sum(n * 2.0**-k for k, n in enumerate(counts, 1)) < 1


def grey(v):
    return usual_jpeg([v] * 8, False)


def test_empty_frames_repeat_the_one_before():
    frames = [grey(10)] * 12 + [b""] * 3 + [grey(240)] * 12
    assert [(a, b) for _, a, b, _, _ in media.clip_rows(media.write_avi(frames, 64, 8))] == [(0, 14), (15, 26)]
    assert [(a, b) for _, a, b, _, _ in media.clip_rows(media.write_avi([b"", *frames], 64, 8))] == [(0, 15), (16, 27)]
    assert media.clip_rows(media.write_avi([b"", b""], 64, 8)) == []


def test_parts_behind_the_first_riff_count():
    first, more = [grey(10)] * 12, [grey(240)] * 12
    part = lambda frames: media.chunk(b"RIFF", b"AVIX" + media.chunk(b"LIST", b"movi" + media.chunk(b"LIST", b"rec " + b"".join(media.chunk(b"00dc", f) for f in frames))))
    data = media.write_avi(first, 64, 8) + part(more) + part(first)
    assert [(a, b) for _, a, b, _, _ in media.clip_rows(data)] == [(0, 11), (12, 23), (24, 35)]


def test_video_may_be_the_second_stream():
    data = media.write_avi([grey(10)] * 3, 64, 8)
    sound = media.chunk(b"LIST", b"strl" + media.chunk(b"strh", b"auds" + b"\0" * 52))
    at = data.index(b"LIST", data.index(b"hdrl"))
    grown = data[:at] + sound + data[at:]
    hdrl = data.index(b"hdrl") - 4
    grown = grown[:4] + struct.pack("<I", len(grown) - 8) + grown[8:hdrl] + struct.pack("<I", struct.unpack_from("<I", data, hdrl)[0] + len(sound)) + grown[hdrl + 4 :]
    assert len(media.read_avi(grown.replace(b"00dc", b"01dc"))["frames"]) == 3 and media.read_avi(grown)["frames"] == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 255), st.integers(0, 3))
def test_damage_is_a_value_error(at, byte, kind):
    data = media.write_avi([grey(10), grey(99)], 64, 8)
    data = data[: at % len(data)] if kind == 0 else data[: at % len(data)] + bytes([byte]) + data[at % len(data) + 1 :]
    try:
        media.clip_rows(data)
    except ValueError:
        pass


# --- scores by brute force ---------------------------------------------------------------------


def test_quality_scores_are_the_plain_sums(spark):
    docs, labels = labelled(spark, "awful%%% junk%%%", "fine prose")
    numbers, bias = model = quality.train(docs, labels, SMALL_Q)
    texts = ["fine prose prose word3", "awful%%% JUNK%%% awful%%%", "é 日本語 " + "x" * 500, "", None]
    got = [r.score for r in quality.score(documents(spark, *texts), model, SMALL_Q).collect()]
    for text, s in zip(texts, got, strict=True):
        words, buckets = (text or "").lower().split(), []
        for k, w in enumerate(words):
            marked = f"<{w}>"
            buckets += [zlib.crc32(x.encode()) % SMALL_Q.buckets for x in (marked, *(marked[i : i + g] for g in SMALL_Q.grams for i in range(len(marked) - g + 1)))]
            if k and words[k - 1] == w:
                buckets.append(quality.REPEAT % SMALL_Q.buckets)
        z = bias + (np.mean([np.float64(numbers[b]) for b in buckets]) if buckets else 0.0)
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_scores_are_the_plain_sums(spark):
    docs, labels = labelled(spark, "fine prose", "awful%%% junk%%%")
    numbers, bias = model = toxicity.train(docs, labels, SMALL_T)
    texts = ["fine prose prose word3", "awful%%% JUNK%%% awful%%%", "é 日本語 " + "x" * 500, "", None]
    got = [r.score for r in toxicity.score(documents(spark, *texts), model, SMALL_T).collect()]
    for text, s in zip(texts, got, strict=True):
        buckets = set()
        for w in (text or "").lower().split():
            marked = f" {w} "
            buckets |= {zlib.crc32(marked[i : i + g].encode("utf-32-le")) % SMALL_T.buckets for g in SMALL_T.grams for i in range(len(marked) - g + 1)}
        z = bias + sum(numbers[b] for b in buckets)
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_an_id_that_many_documents_share_is_learnt_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}", 1.0, "x") for i in range(500)] + [(2, "other", 1.0, "x")], DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, label int")
    same = spark.createDataFrame([(1, "text 99", 1.0, "x"), (2, "other", 1.0, "x")], DOCS)
    for op, p in ((quality, SMALL_Q), (toxicity, SMALL_T)):
        a, b = op.train(docs, labels, p), op.train(same, labels.distinct(), p)
        assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_workers_keep_no_words_of_a_packing_task(spark):
    """Workers live on between stages: what an encoder keeps would be missing in the next one."""
    from repolith.llm import packing
    from repolith.llm.common import WordCache

    docs = spark.createDataFrame([(i, " ".join(f"слово{i}x{j}" for j in range(200))) for i in range(40)], "doc_id long, text string").repartition(2)
    assert packing.pack(docs, packing.word_encoder()).count() == 40

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            known = packing._word_encoder(None).known
            yield pa.RecordBatch.from_arrays([pa.array([len(known) + len(known.before)], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 8, 1, 2).mapInArrow(held, "n long").collect()} == {0}
    cache = WordCache(str.upper, 3)
    assert [cache[w] for w in "abcdea"] == list("ABCDEA") and cache.before
    cache.empty()
    assert not cache and not cache.before and cache["a"] == "A"


def test_toxicity_keeps_words_as_arrays():
    """Buckets of 20,000 distinct words take some MB, as sets they took more than 40."""
    import tracemalloc

    from repolith.llm import toxicity

    p = toxicity.Params()
    texts = [" ".join(f"word{i}number{j}" for j in range(1000)) for i in range(20)] + [None, "a a"]
    tracemalloc.start()
    got = toxicity.text_buckets(texts, p)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [sorted(set().union(*(toxicity.grams_of(w, p) for w in set((t or "").split())))) for t in texts]
    assert all(x.dtype == "int32" for x in got) and most < 20e6
