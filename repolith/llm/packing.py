"""Best-fit packing into sequences of a fixed length.

A task reads its documents once and packs as it goes, with a fixed number of
open bins. A bitset has one bit for each amount of free space that some open bin
has; the best fit for a piece is the lowest bit at or above its length. When no
open bin fits and all are open, the fullest closes. At a task's end the open
bins are packed into each other, best fit by falling size. Nothing is shuffled,
and a task holds the pieces of its open bins at most, whatever its input.

Pieces: a document's ids with the end id behind them; only longer ones are cut,
into full pieces and a rest. A null text counts as empty: its document is the
end id alone. Each input row is a document, so repeated rows and null ids are
packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from repolith.llm.common import WordCache, lean_batches, lean_memory, slices
from repolith.llm.merges import Merges
from repolith.llm.units import gather

#: From texts to all their ids, and where each text's begin and end.
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
LENGTH, OPEN, END = 4096, 96, 1
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: White space on which a text can be cut without changing its ids: no token holds any, and no rule looks across it.
SPACES = "\n\t\r"
#: Letters that lower-case one to one and are composed already; a full stop or comma behind them is a token of its own.
LATIN = "^[A-Za-zß-öø-þÀ-ÖØ-Þ]+[.,]?$"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts whose words encode independently of each other.

    Each distinct word of a batch is encoded once and a text's ids are gathered
    from its words'. Of a word of Latin letters normalising is lower-casing, and
    nothing cuts it: the tokenizer's merge rules are applied to all such words of
    a batch in step. Other words go to the tokenizers library, whose answers are
    kept in a dictionary of bounded size until forget() is called.
    """

    def __init__(self, path: str, most: int = 25_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.known = WordCache(self.call, most, longest)
        self.stop = {p: self.lib.encode(p, add_special_tokens=False).ids[0] for p in ".,"}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits), one after another, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        for space in SPACES:
            texts = pc.replace_substring(texts, space, " ")
        return gather(pc.split_pattern(texts, " "), self.words)

    def call(self, word: str) -> list[int]:
        return self.lib.encode(word, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known.empty()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(words, LATIN).to_numpy(zero_copy_only=False) & (size <= Merges.LONGEST)
        plain = pc.utf8_lower(words.filter(pa.array(latin)))
        stop = pc.match_substring_regex(plain, "[.,]$").to_numpy(zero_copy_only=False)
        comma = pc.ends_with(plain, ",").to_numpy(zero_copy_only=False)
        ids, count = self.merges.ids(pc.utf8_rtrim(plain, ".,"))
        # The stop's id behind the word's.
        ids = np.insert(ids, np.cumsum(count)[stop], np.where(comma[stop], self.stop[","], self.stop["."]))
        count = count + stop
        others = [self.known[w] if w else [] for w in words.filter(pa.array(~latin)).to_pylist()]
        n = np.zeros(len(words), np.int64)
        n[latin], n[~latin] = count, [len(x) for x in others]
        out = np.empty(int(n.sum()), np.uint32)
        mine = np.repeat(latin, n)
        out[mine], out[~mine] = ids, [i for x in others for i in x]
        return out, n


class Bins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.bits, self.count = length, most, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def add(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.count += 1

    def take(self, free: int) -> list:
        bins = self.by_free[free]
        items = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return items

    def best(self, size: int) -> int:
        """The least free space of an open bin that a piece of this size fits; -1: none."""
        up = self.bits >> size
        return size + (up & -up).bit_length() - 1 if up else -1

    def fullest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1

    def put(self, size: int, item) -> Iterator[list]:
        """Places a piece; yields the bins that close."""
        free = self.best(size)
        if free >= 0:
            items = self.take(free)
        else:
            if self.count >= self.most:
                yield self.take(self.fullest())
            items, free = [], self.length
        items.append(item)
        if free == size:
            yield items
        else:
            self.add(free - size, items)

    def rest(self) -> Iterator[list]:
        """Closes all, small ones packed into others first."""
        left = sorted(((self.length - free, items) for free, bins in self.by_free.items() for items in bins), key=lambda x: -x[0])
        last = Bins(self.length, len(left) + 1)
        for size, items in left:
            free = last.best(size)
            if free >= 0:
                last.add(free - size, last.take(free) + items)
            else:
                last.add(self.length - size, items)
        for bins in last.by_free.values():
            yield from bins


def pack(documents: DataFrame, encoder: Callable[[], Encoder], length: int = LENGTH, bins: int = OPEN, end: int = END) -> DataFrame:
    """One row a piece. encoder() gives a function from an array of texts to all their ids and the bounds of each text's."""
    lean_batches(documents.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        encode, open_bins = encoder(), Bins(length, bins)
        base, done, rows = TaskContext.get().partitionId() << 40, 0, []

        def close(items: list) -> None:
            nonlocal done
            at = 0
            for doc_id, piece, start, size, crc in items:
                rows.append((doc_id, piece, start, size, crc, base + done, at))
                at += size
            done += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                ids, bounds = encode(batch.column(1)[low:high])
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for doc_id, first, behind in zip(batch.column(0)[low:high].to_pylist(), bounds, bounds[1:], strict=False):
                    for piece, start in enumerate(range(first, behind, length)):
                        size = min(length, behind - start)
                        for items in open_bins.put(size, (doc_id, piece, start - first, size, zlib.crc32(ids[start : start + size]))):
                            close(items)
            yield flush()
        for items in open_bins.rest():
            close(items)
        # The worker lives on, and so may the encoder: its tables stay, the words of this task don't.
        if forget := getattr(getattr(encode, "__self__", None), "forget", None):
            forget()
        yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


@lru_cache(2)
def _word_encoder(path: str | None) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(path or public_tokenizers.path("word_bpe_49k.json"))


def word_encoder(path: str | None = None) -> Callable[[], Encoder]:
    return lambda: _word_encoder(path).encode


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_encoder())
