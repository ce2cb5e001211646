"""Quality classifier: supervised subword embeddings.

A document is the bag of its words, of each word's character n-grams (with
word-end marks) and of one hashed bigram that stands for "the word before,
again". Each feature hashes to a bucket with a learned vector; a document is
the mean of its vectors, and a softmax layer turns that into class
probabilities. Vectors and layer are trained together by stochastic gradient
descent in numpy.

The mean and the layer are linear, so at scoring time each bucket has a single
number, (difference of the output rows) . (bucket vector), and each word the sum
over its features. Scoring is one dictionary lookup a word over the whole text.

Nulls and empty texts have no features: their score is the bias alone. Labels
other than 0 and 1 (nulls too) are left out of training. Repeated label rows
count once; of documents that share an id the greatest text is learnt from. Without any labelled rows every score is 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from repolith.llm.common import WordCache, lean_batches, lean_memory, map_rows

REPEAT = zlib.crc32(b"\x00repeat")


@dataclass(frozen=True)
class Params:
    #: Labelled rows that training reads at most: those with the smallest hash of their id.
    train_rows: int = 2400
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 5
    rate: float = 0.6
    batch: int = 16
    seed: int = 7


def word_features(word: str, grams: tuple[int, ...], buckets: int) -> np.ndarray:
    """Buckets of the word and of its character n-grams; all windows of a long word count."""
    marked = f"<{word}>"
    crc, n = zlib.crc32, len(marked)
    parts = chain((marked,), (marked[i : i + g] for g in grams for i in range(n - g + 1)))
    return np.fromiter((crc(x.encode()) % buckets for x in parts), np.int32)


def bag(text: str | None, cache: WordCache, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids = np.concatenate([*map(cache.__getitem__, words), np.full(sum(map(eq, words, words[1:])), REPEAT % p.buckets, np.int32)])
    ids, n = np.unique(ids, return_counts=True)
    return ids.astype(np.int32), (n / n.sum()).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> tuple[np.ndarray, float]:
    """Trains vectors and softmax layer; returns each bucket's number and the bias of class 1 over class 0."""
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out, bias = np.zeros((2, p.dim), np.float32), np.zeros(2, np.float32)
    rows = [r for r in rows if len(r[0])]
    steps, step = max(1, p.epochs * -(-len(rows) // p.batch)), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), p.batch):
            part = [rows[i] for i in order[at : at + p.batch]]
            ids, share = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            starts = np.cumsum([0] + [len(r[0]) for r in part[:-1]])
            hidden = np.add.reduceat(vectors[ids] * share[:, None], starts)
            z = hidden @ out.T + bias
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(part)), [r[2] for r in part]] -= 1
            rate = p.rate * (1 - step / steps)
            back = prob @ out
            out -= rate * prob.T @ hidden
            bias -= rate * prob.mean(0)
            # A mean spreads a document's gradient thinly: each vector takes it by its share, times the number of features it has.
            width = np.repeat([np.float32(len(r[0])) ** 0.5 for r in part], [len(r[0]) for r in part])
            np.add.at(vectors, ids, -rate * (share * width)[:, None] * np.repeat(back, [len(r[0]) for r in part], axis=0))
            step += 1
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


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
        cache = WordCache(lambda w: word_features(w, p.grams, p.buckets), 50_000)
        got = [bag(t, cache, p) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "ids": [a.tobytes() for a, _ in got], "share": [b.tobytes() for _, b in got]}

    # train_rows bounds the broadcast side and what is collected, even if many documents share an id.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = map_rows(sample, "doc_id long, label long, ids binary, share binary", features).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.share, np.float32), r.label) for r in rows], p)


def score(documents: DataFrame, model: tuple[np.ndarray, float], p: Params = Params(), keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns in keep (doc_id) and, named into, the score of each whole text."""
    spark, keep = documents.sparkSession, keep or ["doc_id"]
    lean_batches(spark)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # buckets x 4 bytes
    out = documents.select(*keep, *([] if "text" in keep else ["text"]))
    names, text_at = out.columns[: len(keep)], out.columns.index("text")
    schema = StructType([*out.schema.fields[: len(keep)], StructField(into, DoubleType())])

    def run(batches):
        lean_memory()
        numbers, bias = shared.value
        again = float(numbers[REPEAT % p.buckets])

        def one(word: str) -> complex:  # the sum as real part, the number of features as imaginary part: sum() adds both
            f = word_features(word, p.grams, p.buckets)
            return complex(float(numbers[f].sum()), len(f))

        cache = WordCache(one)
        look = cache.__getitem__
        for batch in batches:
            z = []
            for text in batch.column(text_at):
                words = (text.as_py() or "").lower().split()
                n = sum(map(eq, words, words[1:]))
                total = sum(map(look, words), complex(n * again, n))
                z.append(bias + (total.real / total.imag if words else 0.0))
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s)], names=[*names, into])

    return out.mapInArrow(run, schema)
