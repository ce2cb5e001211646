"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of a character n-gram (within a word and its two
edges) anywhere in the text, hashed to buckets. Each bucket's value is the log
ratio of its smoothed document counts in toxic and clean training texts; a
logistic layer learns a weight for the scaled presence. Weight times ratio is
one number a bucket, so that a text's score is the sum over the distinct
buckets it holds.

Nulls and empty texts hold no bucket: their score is the bias alone. Labels
other than 0 and 1 are left out of training, repeated label rows count once, of
documents that share an id the greatest text is learnt from; without labelled rows every score
is 0.5, with labels of one kind it is near that label. With few labelled rows few n-grams are
in two texts or more, or none: texts that hold none of them have the bias alone. Whole texts are read; repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from repolith.llm.common import WordCache, lean_batches, lean_memory, map_rows


@dataclass(frozen=True)
class Params:
    #: Labelled rows that training reads at most: those with the smallest hash of their id.
    train_rows: int = 6000
    buckets: int = 1 << 19
    #: These and root, ratio, epochs and l2 were chosen by four-fold cross-validation on training rows alone (see the README).
    grams: tuple[int, ...] = (4, 5, 6)
    #: A bucket in fewer training texts than this many times the root of their number, or in one alone, has no weight: chance puts
    #: a bucket into one class more often by about the root of its count.
    root: float = 0.27
    alpha: float = 1.0
    #: So does one whose log-count ratio is nearer to 0: common n-grams would only pile up noise in long texts.
    ratio: float = 1.5
    epochs: int = 20
    rate: float = 0.5
    l2: float = 3e-4
    #: Numbers smaller than this are 0, which keeps the sets of most words empty.
    tiny: float = 0.02


def grams_of(word: str, p: Params) -> set[int]:
    """Buckets of a word's n-grams; all windows of a long word count."""
    marked, crc = f" {word} ".encode("utf-32-le"), zlib.crc32
    n = len(marked) // 4
    return {crc(marked[4 * i : 4 * (i + g)]) % p.buckets for g in p.grams for i in range(n - g + 1)}


def text_buckets(texts: Iterable[str | None], p: Params) -> list[np.ndarray]:
    """Distinct buckets of each text, in order. Words' buckets are kept as arrays: sets take ten times their memory."""
    none = np.zeros(0, np.int32)
    cache = WordCache(lambda w: np.fromiter(grams_of(w, p), np.int32), 50_000)
    return [np.unique(np.concatenate([none, *map(cache.__getitem__, set((t or "").lower().split()))])) for t in texts]


def fit(rows: list[tuple[np.ndarray, int]], p: Params) -> tuple[np.ndarray, float]:
    """Each bucket's number and the bias."""
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(p.buckets), 0.0 if not len(y) else (8.0 if y[0] else -8.0)
    df = np.zeros((2, p.buckets))
    for ids, label in rows:
        df[label, ids] += 1
    texts = np.bincount(y.astype(int), minlength=2) + 2 * p.alpha
    ratio = np.log((df[1] + p.alpha) / texts[1]) - np.log((df[0] + p.alpha) / texts[0])
    ratio[(df.sum(0) < max(2, p.root * len(y) ** 0.5)) | (np.abs(ratio) < p.ratio)] = 0
    used = np.flatnonzero(ratio)
    place = np.full(p.buckets, -1)
    place[used] = np.arange(len(used))
    kept = [place[ids][place[ids] >= 0] for ids, _ in rows]
    starts, flat = np.cumsum([0] + [len(k) for k in kept]), np.concatenate(kept)
    owner = np.repeat(np.arange(len(kept)), np.diff(starts))
    scale = ratio[used]
    w, bias, rms = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(used))
    for _ in range(p.epochs):
        z = np.bincount(owner, (w * scale)[flat], len(kept)) + bias
        err = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.bincount(flat, err[owner], len(used)) * scale / len(y) + p.l2 * w
        rms = 0.9 * rms + 0.1 * grad**2
        w -= p.rate * 0.1 * grad / (np.sqrt(rms) + 1e-5)
        bias -= p.rate * err.mean()
    number = np.zeros(p.buckets)
    number[used] = w * scale
    number[np.abs(number) < p.tiny] = 0
    return number, bias


def train(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Fits on a bounded sample of the labelled rows. labels: doc_id, label; only these rows are learnt from."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .select("doc_id", F.col("label").cast("long").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(p.train_rows)
    )

    def features(batch: pa.RecordBatch) -> dict:
        got = text_buckets((t.as_py() for t in batch.column("text")), p)
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "ids": [a.tobytes() for a in got]}

    # train_rows bounds the broadcast side and what is collected, even if many documents share an id.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = map_rows(sample, "doc_id long, label long, ids binary", features).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, np.int32), r.label) for r in rows], p)


def score(documents: DataFrame, model: tuple[np.ndarray, float], p: Params = Params(), keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns in keep (doc_id) and, named into, the score of each whole text."""
    spark, keep = documents.sparkSession, keep or ["doc_id"]
    lean_batches(spark)
    held = np.flatnonzero(model[0])
    shared = spark.sparkContext.broadcast((dict(zip(held.tolist(), model[0][held].tolist(), strict=True)), model[1]))  # buckets entries at most
    out = documents.select(*keep, *([] if "text" in keep else ["text"]))
    names, text_at = out.columns[: len(keep)], out.columns.index("text")
    schema = StructType([*out.schema.fields[: len(keep)], StructField(into, DoubleType())])

    def run(batches):
        lean_memory()
        numbers, bias = shared.value
        none = frozenset()

        def one(word: str) -> frozenset:
            return frozenset(g for g in grams_of(word, p) if g in numbers) or none

        cache = WordCache(one)
        for batch in batches:
            z = []
            for text in batch.column(text_at):
                active = set().union(*map(cache.__getitem__, set((text.as_py() or "").lower().split())))
                z.append(bias + sum(map(numbers.__getitem__, sorted(active))))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s)], names=[*names, into])

    return out.mapInArrow(run, schema)
