"""Source divergence audit: how the sources of a language differ in their words.

Terms are runs of letters A-Z, a-z and of bytes above 127, with A-Z in lower
case. Texts lie one after another in a UTF-8 buffer; a lookup table over its bytes
finds where terms begin and end, xxhash groups the slices, and each slice is held
against its group's first byte by byte (a slice that differs goes by its bytes).
A batch leaves as one row for each language, source and term, with the number of
occurrences and of documents.

A language keeps the V terms in at least `least_docs` of its documents. A group is
a language's source, and each language is one by itself. With n occurrences of a
kept term among a group's N, p = 1 + floor(10^9 * (n + 2) / (N + 2V)); two groups
diverge in a term by floor((p - q)^2 / (p + q)). All arithmetic is in whole
numbers: (p - q)^2 stays below 2^63, and p is found digit by digit, as 10^9 * n
need not fit.

Divergences are summed by blocks: cells (term, source, n) are dealt by a hash of
the term, in as many slices as keep each at some CELLS, and by pairs of blocks of
SOURCES sources. A slice is a CSR matrix of its sources' rows. Where both
sources lack a term, p and q are the same for all such terms, so that sums run
over the cells alone, by reduceat, and the rest is a product. A slice also gives
each source's strongest terms against its language; ten of each slice suffice.

Nulls in text, lang and source count as the empty text. Each row is a document,
repeated or not. Groups without terms have p from n = N = 0; where V = 0 all
values are 0. A language with one source has no pairs. Ties go by item in
the order of UTF-8 bytes. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.llm.common import arrow_bytes, arrow_schema, cut, drop_cut, slices

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
CELLS, SOURCES = 200_000, 256

_byte = np.arange(256, dtype=np.uint8)
_capital = (_byte >= 0x41) & (_byte <= 0x5A)
IN_TERM = _capital | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where(_capital, _byte + 32, _byte).astype(np.uint8)


# --- terms ----------------------------------------------------------------------------


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, one after another, and where each begins and the last ends. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def boundaries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end. None goes over the end of a text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = inside[1:] & (~inside[:-1] | edge)
    last = inside[:-1] & (~inside[1:] | edge)
    return np.flatnonzero(first), np.flatnonzero(last)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of slices, one slice after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hash_of: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes, and of each number one slice that has it."""
    raw = data.tobytes()
    hashes = np.fromiter((hash_of(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    same = sizes == sizes[first[code]]
    held = np.flatnonzero(same)
    for k in range(0, len(held), 1 << 17):
        some = held[k : k + (1 << 17)]
        equal = data[spread(starts[some], sizes[some])] == data[spread(starts[first[code[some]]], sizes[some])]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(sizes[some]) - sizes[some])
    others: dict[bytes, int] = {}
    for k in np.flatnonzero(~same).tolist():
        word = raw[starts[k] : ends[k]]
        if word not in others:
            others[word] = len(first)
            first = np.append(first, k)
        code[k] = others[word]
    return code, first


def term_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> dict[str, list]:
    """Rows (lang, source, term, n, n_docs) of some documents."""
    data, bounds = buffer_of(texts)
    data = LOWER[data]
    starts, ends = boundaries(data, bounds)
    if not len(starts):
        return {name: [] for name in ("lang", "source", "term", "n", "n_docs")}
    code, first = grouped(data, starts, ends)
    width = len(first)
    doc = np.searchsorted(bounds, starts, "right") - 1
    # A CSR matrix of documents by terms, then its rows summed by group.
    cells, n = np.unique(doc * width + code, return_counts=True)
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    group = pair[cells // width] * width + cells % width
    order = np.argsort(group, kind="stable")
    keys, begin, docs = np.unique(group[order], return_index=True, return_counts=True)
    pairs, terms = keys // width, first[keys % width]
    raw = data.tobytes()
    return {
        "lang": lang.dictionary.take(pa.array(pairs // len(source.dictionary))), "source": source.dictionary.take(pa.array(pairs % len(source.dictionary))),
        "term": [raw[a:b].decode() for a, b in zip(starts[terms].tolist(), ends[terms].tolist(), strict=True)], "n": np.add.reduceat(n[order], begin), "n_docs": docs,
    }


COUNTS = "lang string, source string, term string, n long, n_docs long"


def counted(documents: DataFrame) -> DataFrame:
    """Occurrences and documents of each term of each language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(COUNTS)
        for batch in batches:
            lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
            for a, b in slices(text):
                out = term_counts(lang[a:b], source[a:b], text[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


# --- divergences ----------------------------------------------------------------------


def probability(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (n + 2) / whole), three digits at a time, so that nothing goes beyond 2^63 for counts up to 9 * 10^15."""
    n = np.asarray(n, np.int64) + 2
    out = n // whole
    left = n - out * whole
    for _ in range(3):
        left = left * 1000
        digit = left // whole
        out, left = out * 1000 + digit, left - digit * whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix."""
    out, some = np.zeros(len(bounds) - 1, np.int64), np.diff(bounds) > 0
    if some.any():
        out[some] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][some])
    return out


OUT = "lang string, source string, part string, item string, value long"


def slice_sums(x: pd.DataFrame, width: int = SOURCES) -> pd.DataFrame:
    """What a slice of terms adds to each pair of sources of two blocks, in both directions, and if it is one block its sources' strongest terms."""
    lang, low, high, part = (x[c].iat[0] for c in ("lang", "low", "high", "slice"))
    head, cells = x[x["term"].isna()].sort_values("sid"), x[x["term"].notna()]
    sids, names = head["sid"].to_numpy(), head["source"].to_numpy(object)
    kept, lang_total = int(head["kept"].iat[0]), int(head["lang_n"].iat[0])
    out: list[tuple] = []
    if kept:
        whole = head["n"].to_numpy() + 2 * kept
        none = probability(np.zeros(len(sids), np.int64), whole)  # p of a term that a source lacks
        cells = cells.sort_values("sid", kind="stable")
        row, (term, terms) = np.searchsorted(sids, cells["sid"].to_numpy()), pd.factorize(cells["term"])
        p = probability(cells["n"].to_numpy(), whole[row])
        bounds = np.searchsorted(row, np.arange(len(sids) + 1))
        if low == high:
            q = probability(cells["lang_n"].to_numpy(), np.int64(lang_total + 2 * kept))
            value, words = divergence(p, q), cells["term"].to_numpy(object)
            for g in range(len(sids)):
                mine = np.arange(bounds[g], bounds[g + 1])
                mine = mine[p[mine] > q[mine]]
                if len(mine) > TOP:
                    mine = mine[value[mine] >= np.partition(value[mine], -TOP)[-TOP]]
                best = sorted(mine.tolist(), key=lambda k: (-value[k], words[k].encode()))[:TOP]
                out += [(lang, names[g], "term", words[k], value[k]) for k in best]
    for h in np.flatnonzero(sids // width == high):
        before = h if low == high else int(np.count_nonzero(sids // width == low))  # rows g < h are pairs with h
        if not before:
            continue
        if kept:
            there = slice(bounds[h], bounds[h + 1])
            of_h, has = np.full(len(terms), none[h]), np.zeros(len(terms), bool)
            of_h[term[there]], has[term[there]] = p[there], True
            upto = bounds[: before + 1]
            at = term[: upto[-1]]
            mine = row_sums(divergence(p[: upto[-1]], of_h[at]), upto)
            both = row_sums(np.where(has[at], divergence(none[row[: upto[-1]]], of_h[at]), 0), upto)
            shared = row_sums(has[at].astype(np.int64), upto)
            seen, times = np.unique(p[there], return_counts=True)
            alone = divergence(none[:before, None], seen[None, :]) @ times
            rest = divergence(none[:before], none[h])
            united = np.diff(upto) + (bounds[h + 1] - bounds[h]) - shared
            total = mine + alone - both + ((kept if part == 0 else 0) - united) * rest
        else:
            total = np.zeros(before, np.int64)
        out += [(lang, names[g], "pair", names[h], int(v)) for g, v in enumerate(total)]
        out += [(lang, names[h], "pair", names[g], int(v)) for g, v in enumerate(total)]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, cells: int = CELLS, width: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: of each source its divergence from each other one of the language (pair), and the terms
    that it has more of than the language, by what they add to their divergence (term, the first TOP)."""
    with arrow_bytes(documents.sparkSession, "16m"):
        counts = cut(counted(documents), "terms")
    term = Window.partitionBy("lang", "term")
    known = counts.withColumns({"docs": F.sum("n_docs").over(term), "lang_n": F.sum("n").over(term), "once": F.row_number().over(term.orderBy("source")) == 1})
    kept = cut(known.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "once"), "kept")
    drop_cut(counts)

    groups = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("once").cast("long")).alias("once"))
    head = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "cells", "once"])
    lang = Window.partitionBy("lang")  # a row for each source
    head = head.withColumns({
        "sid": F.row_number().over(lang.orderBy("source")) - 1, "kept": F.sum("once").over(lang), "lang_n": F.sum("n").over(lang),
        "slices": F.greatest(F.lit(1), F.ceil(F.sum("cells").over(lang) / cells)).cast("int"), "blocks": F.ceil(F.count(F.lit(1)).over(lang) / width).cast("int"),
    }).drop("cells", "once")
    head = cut(head, "sources")

    block, other = F.floor(F.col("sid") / width).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ends = {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    columns = ["lang", "low", "high", "slice", "sid", "source", "term", "n", "lang_n", "kept"]
    heads = head.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("block", block).withColumn("other", other).withColumns(ends).withColumn("term", F.lit(None).cast("string"))
    placed = kept.join(head.select("lang", "source", "sid", "slices", "blocks"), ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    placed = placed.withColumn("block", block).withColumn("other", other).withColumns(ends).withColumn("kept", F.lit(0).cast("long")).withColumn("source", F.lit(None).cast("string"))
    found = placed.select(*columns).unionByName(heads.select(*columns)).groupBy("lang", "low", "high", "slice").applyInPandas(lambda x: slice_sums(x, width), OUT)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT t.lang, source, term, count(*) AS n FROM t SEMI JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY 1, 2, 3),
total AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(total.n, 0) + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (size.n + 2 * v) AS q
      FROM groups g JOIN kept k ON g.lang = k.lang JOIN size ON size.lang = g.lang
      LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""
