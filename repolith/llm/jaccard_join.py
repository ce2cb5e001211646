"""N-gram Jaccard join by prefixes under several global token orders.

Two documents link when the Jaccard similarity of their word shingle sets is at
least a threshold t, compared in whole numbers. In any order of all shingles
that both sets follow, linked sets share a shingle within their prefixes of
n - ceil(t n) + 1. Pairs come from lists of the documents that hold a shingle in
their prefix of the first order, and must pass the bound of what the rest of
both sets can share. Before any whole set moves, a pair must share shingles in
its prefixes under all three orders, and as many as a link needs. Each order
sorts by frequency class, rare ones first, and within a class by a permutation
of its own. Classes come from a counter table of fixed size over all documents:
any order gives right results, this one keeps passages that many documents share
out of the prefixes.

Equal sets are one class with one representative. Of a short list all pairs are
looked at. In a long one each member is held against one leader, the member
with the fewest rarer shingles, which lies in the middle of a group of near
copies. Lists whose members are in one component by then are done. In the others
a member x that is not too far from the leader c is described by its difference
D(x) = x ^ c. As |x & y| = |c| - |c - x| - |c - y| + |D(x) & D(y)|, two members
that aren't linked through c need a number of shared shingles in their
differences: prefixes of differences make new, far shorter lists. Members far
from c go on in a list without those that are near: by the triangle inequality
of the Jaccard distance the two can't link. New lists are treated alike, and
after the last level all pairs across components that are left in lists are
looked at. Components grow by label propagation with shortcuts.

Documents out of few building blocks (pages of one template with varying parts)
share many common shingles without being near to each other: their lists are long,
and all members are far from any leader. Where a list of far members is still
long, its members leave it for bands: a band's key are the first shingles of a set
under several further orders, all of which must agree. A set's first shingle
under a random order is another's with a chance of their similarity, so that a
link shares all keys of a band with a chance of t^orders; there are as many bands
as it takes for a link to escape all of them with a chance below `escape`
(10^-12). The more members there are, the more orders a key has, so that
members that aren't similar rarely meet. All other steps lose no link at all.

Text is lower-cased in A-Z only; words are [^\\x20\\x09-\\x0D]+. With fewer words
than a shingle has, the whole sequence is the one shingle. Null, empty and blank
texts have no shingles and link with nothing. Rows that share a doc_id are one
node; rows with a null id take part in no link and have a null component. Shingles are
64-bit hashes, sets are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm.common import arrow_bytes, cut, cuts, drop_cut, lean_memory, release, settings, slices


@dataclass(frozen=True)
class Params:
    width: int = 4
    #: The threshold in hundredths.
    percent: int = 85
    #: Counters of the frequency table (four bytes each in a task, one when shared).
    counters: int = 1 << 22
    #: A list of at most this many documents is short; a list of differences, where the bound lets few pairs through, may be longer.
    short: int = 24
    short_later: int = 1000
    #: How often lists are split by leaders before all pairs that are left are looked at.
    levels: int = 3
    #: Lists of members that are far from their leader and longer than this go into bands, of at most so many orders a key; the chance that a link escapes them.
    short_far: int = 100
    band_orders: int = 16
    escape: float = 1e-12
    #: Documents with a similarity to the leader (in hundredths) of this or more aren't far from it.
    near: int = 60
    #: Ids are broadcast up to this number (some 30 MB); more are joined by a shuffle.
    broadcast_ids: int = 1 << 19


BLOCKS = 64
SPREAD = 32
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


# --- sets and prefixes (numpy) ---------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() and split() see ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(xxh3_64_intdigest, words)), np.uint64)
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B185EBCA87) + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set in an order, sorted by it. Tokens whose keys are equal stay together, as the order has to be one for all sets."""
    size = prefix_size(len(tokens), percent)
    key = keys(tokens, classes, order)
    if size < len(tokens):
        last = np.partition(key, size - 1)[size - 1]
        keep = key <= last
        tokens, key = tokens[keep], key[keep]
    return tokens[np.lexsort((tokens, key))]


def class_of(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return table[(tokens & np.uint64(len(table) - 1)).astype(np.int64)]


def to_classes(counts: np.ndarray) -> np.ndarray:
    """Frequency classes by powers of two, relative to the mean count."""
    scaled = counts.astype(np.int64) * 4 // (int(counts.mean()) + 1)
    return np.minimum(np.ceil(np.log2(scaled + 1)), 63).astype(np.uint8)


def keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    return (classes.astype(np.uint64) << np.uint64(58)) | (mixed(tokens ^ np.uint64(ORDERS[order])) >> np.uint64(6))


def signature(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> bytes:
    """The upper halves of a prefix's keys, sorted."""
    x = prefix(tokens, classes, order, percent)
    key = keys(x, classes[np.searchsorted(tokens, x)], order)
    return (key >> np.uint64(32)).astype(np.uint32).tobytes()


def may_share(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with these signatures in an order can be similar enough.

    Up to the last key that both prefixes reach, all shared tokens are seen in
    them; beyond it there are no more than either set has left. Halves of
    different keys may be equal: they count as shared, and as not yet seen.
    """
    both = int(np.isin(a, b).sum())
    if not both:
        return False
    reach = min(a[-1], b[-1])
    most = both + min(n - int(np.searchsorted(a, reach)), m - int(np.searchsorted(b, reach)))
    return (100 + percent) * most >= percent * (n + m)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Difference:
    """How a set differs from a leader's."""

    linked: bool
    #: Near enough for the list of differences; too far from the leader for members that are near to it.
    close: bool
    far: bool
    #: Twice the part that this set has in the shingles which two linked differences share, times 100 + percent.
    need: int
    #: Number of tokens of the difference, and the first of them in an order that all members of the leader's list follow.
    size: int
    tokens: np.ndarray


def difference(x: np.ndarray, c: np.ndarray, classes_x: np.ndarray, classes_c: np.ndarray, percent: int, near: int) -> Difference:
    """Of members x and y whose sets aren't linked through c, |x & y| = |c| - |c - x| - |c - y| + |D(x) & D(y)|.

    With q(x) = p |x| + (100 + p) |c - x| they link if (100 + p) |D(x) & D(y)| >=
    q(x) + q(y) - (100 + p) |c|; x and c link if q(x) <= 100 |c|. No q is below
    p |c|, and of two members that aren't linked through c one has q > 100 |c|.
    """
    own, lost = ~np.isin(x, c, assume_unique=True), ~np.isin(c, x, assume_unique=True)
    more, less = int(own.sum()), int(lost.sum())
    both, union = len(x) - more, len(c) + more
    q, p = percent * len(x) + (100 + percent) * less, percent
    linked = q <= 100 * len(c)
    close = 100 * both >= (near - (100 - p) - 1) * union
    least = (q - p * len(c)) // (100 + p) + 1 if linked else -(-(q - 100 * len(c)) // (100 + p))
    tokens = np.zeros(0, np.uint64)
    if close and least <= more + less:
        # First the member's own rare tokens, then the leader's common ones, which few members lose; last those that most members
        # lose or have besides: the leader's own rare tokens, and tokens as common as the group that the leader lacks.
        top, e, m = int(classes_c.max()), classes_x[own].astype(np.int64), classes_c[lost].astype(np.int64)
        rank = np.concatenate([np.where(e < top - 1, e, 2 * top), top + np.maximum(top - m, 0)])
        key = np.concatenate([keys(x[own], np.zeros(more, np.uint8), 0), keys(c[lost], np.zeros(less, np.uint8), 0)])
        tokens = np.concatenate([x[own], c[lost]])
        tokens = tokens[np.lexsort((tokens, key, rank))][: more + less - least + 1]
    return Difference(linked, close, 100 * both < near * union, 2 * q - (100 + p) * len(c), more + less, tokens)


# --- passes over the documents ---------------------------------------------------


def sets_of(texts: pa.Array, width: int) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    """The sets of some texts, their sizes and digests."""
    sets = [shingle_set(t.as_py(), width) for t in texts]
    digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return sets, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())


def profile(documents: DataFrame, p: Params) -> DataFrame:
    """A row for each document: doc_id, n, digest. Rows with a block hold a task's counts of the tokens hashed to it."""
    schema = "doc_id long, n long, digest binary, block int, task int, counts binary"
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counts, seen = np.zeros(p.counters, np.uint32), False
        for batch in batches:
            for low, high in slices(batch.column(1), 1 << 20):
                sets, n, digest = sets_of(batch.column(1)[low:high], p.width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], n, digest, *(pa.nulls(high - low, f.type) for f in list(kinds)[3:])], schema=kinds)
                if any(map(len, sets)):
                    at, n = np.unique((np.concatenate(sets) & np.uint64(p.counters - 1)).astype(np.int32), return_counts=True)
                    counts[at] += n.astype(np.uint32)
                    seen = True
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(BLOCKS, -1)]
            task = pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(BLOCKS, f.type) for f in list(kinds)[:3]), pa.array(range(BLOCKS), pa.int32()), task, pa.array(parts, pa.binary())], schema=kinds)

    return documents.mapInArrow(run, schema)


def frequency_classes(blocks: DataFrame, p: Params) -> np.ndarray:
    """Sums the tasks' counters in two steps, a block at a time; what comes to the driver has the table's fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            kind = np.uint32 if batch.schema.names[1] == "counts" else np.uint64
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(data.as_py()), kind)
                total[block] = total.get(block, 0) + x.astype(np.uint64)
        if total:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"])

    # First over some tasks each, so that the second step has SPREAD rows a block, however many tasks there were.
    first = blocks.repartition("block", F.col("task") % SPREAD).select("block", "counts").mapInArrow(add, "block int, sums binary")
    rows = first.repartition(8, "block").mapInArrow(add, "block int, sums binary").collect()
    table = np.zeros((BLOCKS, p.counters // BLOCKS), np.uint64)
    for r in rows:
        table[r.block] = np.frombuffer(zlib.decompress(bytes(r.sums)), np.uint64)
    return to_classes(table.reshape(-1))


def prefixes(documents: DataFrame, classes, p: Params) -> DataFrame:
    """doc_id, digest, n and the prefix under the first order, of documents with a set."""
    schema = "doc_id long, digest binary, n long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        table = classes.value
        for batch in batches:
            for low, high in slices(batch.column(1), 1 << 20):
                sets, n, digest = sets_of(batch.column(1)[low:high], p.width)
                first = [prefix(s, class_of(table, s), 0, p.percent).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], digest, n, pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "prefix"])

    return documents.mapInArrow(run, schema)


def whole_sets(documents: DataFrame, p: Params) -> DataFrame:
    """doc_id, n and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            for low, high in slices(batch.column(1), 1 << 20):
                sets, n, _ = sets_of(batch.column(1)[low:high], p.width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], n, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "tokens"])

    return documents.mapInArrow(run, "doc_id long, n long, tokens binary").where("n > 0")


def signatures(sets: DataFrame, classes, p: Params) -> DataFrame:
    """doc_id, n and the signatures under all orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        table = classes.value
        for batch in batches:
            out = []
            for data in batch.column(2):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                c = class_of(table, s)
                out.append([signature(s, c, k, p.percent) for k in range(len(ORDERS))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "n", "orders"])

    return sets.select("doc_id", "n", "tokens").mapInArrow(run, "doc_id long, n long, orders array<binary>")


def of_ids(rows: DataFrame, ids: DataFrame, p: Params) -> DataFrame:
    """The rows whose doc_id is among distinct ids. Ids are broadcast up to a number that is counted first; more of them are joined by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= p.broadcast_ids else ids, "doc_id", "left_semi")


def of_pairs(sets: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The sets that pairs name."""
    return of_ids(sets, pairs.select(F.explode(F.array(*pairs.columns)).alias("doc_id")).distinct(), p)


# --- candidates, verification, components ------------------------------------------

#: A list's rows: a document's n tokens; how many tokens lie before the list's one and from it on; what a link needs of the two, times 100 + percent and doubled; the list's length.
ROW = ("doc_id", "n", "at", "rest", "need", "label")


def may_link(p: Params, x: str = "", y: str = "") -> Column:
    """Whether two list rows (columns with the suffixes x and y) can be of linked sets if the list's token is the first in the order
    that both hold: then they share no more than the rest of either. Every link has such a first token."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    length = p.percent * F.greatest(n, m) <= 100 * F.least(n, m)
    return length & (2 * (100 + p.percent) * F.least(f"rest{x}", f"rest{y}") >= F.col(f"need{x}") + F.col(f"need{y}"))


def sized(rows: DataFrame) -> DataFrame:
    """Rows of lists with several documents, and the lists' lengths."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(several, "key")


def labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    lists = lists.drop("label")
    known = lists.join(labels, "doc_id", "left") if labels is not None else lists.withColumn("label", F.col("doc_id"))
    return known.withColumn("label", F.coalesce("label", "doc_id"))


def unfinished(lists: DataFrame) -> DataFrame:
    """The lists whose members are in several components."""
    several = lists.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    return lists.join(several, "key", "left_semi")


def with_leader(lists: DataFrame) -> DataFrame:
    """Each row with its list's leader (columns with _l): of the members with the fewest rarer tokens, the one with the least id."""
    best = lists.groupBy("key").agg(F.min(F.struct("at", "doc_id", *(c for c in ROW if c not in ("at", "doc_id")))).alias("x"))
    return lists.join(best.select("key", *(F.col(f"x.{c}").alias(f"{c}_l") for c in ROW)), "key")


def led(lists: DataFrame, p: Params) -> DataFrame:
    """Each member with the list's leader."""
    pairs = with_leader(lists).where((F.col("label") != F.col("label_l")) & may_link(p, "", "_l"))
    return pairs.select(F.least("doc_id", "doc_id_l").alias("a"), F.greatest("doc_id", "doc_id_l").alias("b"))


def met(lists: DataFrame, p: Params) -> DataFrame:
    """Of each list, all pairs of members in different components."""
    x, y = (lists.select("key", *(F.col(c).alias(c + s) for c in ROW)) for s in ("_x", "_y"))
    pairs = x.join(y, "key").where((F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("label_x") != F.col("label_y")) & may_link(p, "_x", "_y"))
    return pairs.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"))


def sharing(pairs: DataFrame, sets: DataFrame, classes, p: Params) -> DataFrame:
    """The pairs whose prefixes allow a link under every order."""
    mine = signatures(of_pairs(sets, pairs, p), classes, p)
    both = pairs.join(mine.toDF("b", "n_b", "orders_b"), "b").join(mine.toDF("a", "n_a", "orders_a"), "a").select("a", "b", "n_a", "n_b", "orders_a", "orders_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        view = lambda x: np.frombuffer(x, np.uint32)
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = [i for i, (n, m, x, y) in enumerate(rows) if all(may_share(view(s), view(t), n, m, p.percent) for s, t in zip(x, y, strict=True))]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """a, b and both sets."""
    mine = of_pairs(sets, pairs, p).select("doc_id", "tokens")
    return pairs.join(mine.toDF("b", "tokens_b"), "b").join(mine.toDF("a", "tokens_a"), "a").select("a", "b", "tokens_a", "tokens_b")


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        view = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if links(view(x), view(y), p.percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return with_sets(pairs, sets, p).mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame, classes, p: Params) -> DataFrame:
    """Of pairs (a leader, b member): what the member's difference says, and the keys of its lists: a hash of leader and token."""
    schema = "a long, b long, n long, linked boolean, far boolean, need long, size long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        table, names = classes.value, [x.split()[0] for x in schema.split(", ")]
        view = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            out, n = [], []
            for leader, c, x in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                c, x = view(c), view(x)
                d = difference(x, c, class_of(table, x), class_of(table, c), p.percent, p.near)
                n.append(len(x))
                salt = mixed(np.array([leader], np.int64).astype(np.uint64))
                out.append((d.linked, d.far, d.need, d.size, mixed(d.tokens ^ salt).view(np.int64)))
            rest = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), *(pa.array(list(v), k) for v, k in zip(rest, kinds, strict=True))], names=names)

    return with_sets(pairs, sets, p).mapInArrow(run, schema)


def bands_for(members: int, p: Params) -> tuple[int, int]:
    """Orders a key and number of bands: members with half their shingles in common should meet by chance some times at most."""
    orders = min(max(4, int(np.ceil(np.log2(max(members, 1) / 8)))), p.band_orders)
    return orders, int(np.ceil(np.log(p.escape) / np.log1p(-((p.percent / 100) ** orders))))


def band_keys(tokens: np.ndarray, orders: int, bands: int) -> np.ndarray:
    """Of each band the hash of the set's first tokens under its orders."""
    seeds = mixed(np.arange(1, bands * orders + 1, dtype=np.uint64) * np.uint64(ORDERS[0]))
    rows = max(1, (1 << 18) // len(tokens))
    first = np.concatenate([mixed(tokens[None, :] ^ seeds[k : k + rows, None]).min(1) for k in range(0, len(seeds), rows)]).reshape(bands, orders)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(orders):
        out = mixed(out ^ first[:, k]) * np.uint64(0x9E3779B185EBCA87)
    return out


def in_bands(sets: DataFrame, members: int, p: Params) -> DataFrame:
    """Rows of the lists of bands. All of a set may be shared, so that only lengths speak against a pair."""
    orders, bands = bands_for(members, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        for batch in batches:
            made = [band_keys(np.frombuffer(t.as_buffer(), np.uint64), orders, bands).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "n", "keys"])

    x = sets.select("doc_id", "n", "tokens").mapInArrow(run, "doc_id long, n long, keys array<long>")
    none = F.lit(0).cast("long")
    return x.select(F.explode("keys").alias("key"), "doc_id", "n", none.alias("at"), F.col("n").alias("rest"), (2 * p.percent * F.col("n")).cast("long").alias("need"))


def next_lists(led_by: DataFrame, apart: DataFrame, sets: DataFrame, p: Params, cut_here) -> DataFrame:
    """Lists of the differences' tokens, and the old lists' members that are far from their leader: as they are if there are few, else in bands."""
    x = apart.select(F.col("b").alias("doc_id"), "n", "size", "need", F.posexplode("keys").alias("at", "key"))
    columns = ("key", "doc_id", "n", "at", "rest", "need")
    of_tokens = x.withColumn("rest", F.col("size") - F.col("at")).select(*columns)
    gone = apart.where("far").select(F.col("a").alias("doc_id_l"), F.col("b").alias("doc_id"))
    far = cut_here(sized(led_by.join(gone, ["doc_id_l", "doc_id"], "left_semi").select(*columns)), "far")
    out = of_tokens.unionByName(far.where(F.col("size") <= p.short_far).select(*columns))
    many = cut_here(far.where(F.col("size") > p.short_far).select("doc_id").distinct(), "many")
    members = many.count()
    if members:
        out = out.unionByName(in_bands(of_ids(sets, many, p), members, p))
    return sized(out)


def components(edges: DataFrame) -> DataFrame:
    """doc_id and the least doc_id of its component, of all ends of edges (a, b). Each round takes the neighbours' least label, then that label's label."""
    two = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(two.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("doc_id"), F.min("b")).alias("label")), "labels")
    while True:
        near = two.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label", "left").select("doc_id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        drop_cut(labels)
        labels = new
        if labels.where("label != old").isEmpty():
            drop_cut(two)
            out = labels.select("doc_id", "label")
            out._repolith_path = labels._repolith_path  # type: ignore[attr-defined]
            return out


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels after more edges: components of the components."""
    if edges.isEmpty():
        return labels
    if labels is None:
        return components(edges)
    known = labels.select(F.col("doc_id").alias("__id"), F.col("label").alias("__label"))
    for end in ("a", "b"):
        edges = edges.join(known, edges[end] == known["__id"], "left").withColumn(end, F.coalesce("__label", end)).drop("__id", "__label")
    upper = components(edges.where("a != b"))
    over = upper.toDF("__id", "__top")
    moved = labels.join(over, F.col("label") == F.col("__id"), "left").select("doc_id", F.coalesce("__top", "label").alias("label"))
    out = cut(moved.unionByName(upper.join(labels, "doc_id", "left_anti")), "labels")
    drop_cut(upper)
    drop_cut(labels)
    return out


def connected(lists: DataFrame, sets: DataFrame, classes, p: Params) -> DataFrame | None:
    """doc_id and label of all documents that link with others; None if there are no links."""
    labels = None
    for level in range(p.levels + 1):
        last = level == p.levels
        is_long = F.lit(False) if last else F.col("size") > (p.short_later if level else p.short)
        with cuts() as cut_here:
            mine = unfinished(labelled(lists, labels)) if level else labelled(lists, labels)
            pairs = cut_here(met(mine.where(~is_long), p).unionByName(led(mine.where(is_long), p)).distinct(), "pairs")
            if not pairs.isEmpty():
                near = cut_here(sharing(pairs, sets, classes, p), "near")
                labels = merged(labels, cut_here(verified(near, sets, p), "links"))
            left = None if last else cut_here(unfinished(labelled(lists.where(is_long), labels)), "left")
            if left is None or left.isEmpty():
                drop_cut(lists)
                return labels
            led_by = cut_here(with_leader(left).where("doc_id != doc_id_l"), "led")
            apart = cut_here(differences(led_by.select(F.col("doc_id_l").alias("a"), F.col("doc_id").alias("b")).distinct(), sets, classes, p), "apart")
            labels = merged(labels, apart.where("linked").select("a", "b"))
            shorter = cut(next_lists(led_by, apart, sets, p, cut_here), "lists")
        drop_cut(lists)
        lists = shorter
        release(sets.sparkSession)
    return labels


def jaccard_components(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    # Sets are wide, and all that runs in Python ends in here; tasks that read less of a shuffle sort in less memory.
    with arrow_bytes(documents.sparkSession, "4m"), settings(documents.sparkSession, spark__sql__adaptive__advisoryPartitionSizeInBytes="8m"):
        return _components(documents, p)


def _components(documents: DataFrame, p: Params) -> DataFrame:
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiled = cut(profile(texts, p), "profile")
    classes = spark.sparkContext.broadcast(frequency_classes(profiled.where("block is not null").select("block", "task", "counts"), p))  # counters bytes
    rows = profiled.where("block is null").select("doc_id", "n", "digest")
    known = rows.where("digest is not null and doc_id is not null")
    groups = cut(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "representatives")

    # Prefixes of representatives alone; dealt by id and digest, so that many equal texts don't meet.
    mine = groups.toDF("rep_digest", "rep")
    first = prefixes(texts.where("doc_id is not null"), classes, p)
    first = first.join(mine, (first["doc_id"] == mine["rep"]) & (first["digest"] == mine["rep_digest"]), "left_semi")
    postings = cut(first.select(F.posexplode("prefix").alias("at", "key"), "doc_id", F.col("n").cast("int").alias("n")), "postings")
    release(spark)
    lists = sized(postings).select("key", "doc_id", F.col("n").cast("long"), F.col("at").cast("long"), (F.col("n") - F.col("at")).cast("long").alias("rest"), (2 * p.percent * F.col("n")).cast("long").alias("need"), "size")
    lists = cut(lists, "lists")
    drop_cut(postings)
    release(spark)
    # Whole sets are made of documents in lists only: most are alone with their rare shingles.
    listed = cut(lists.select("doc_id").distinct(), "listed")
    sets = cut(whole_sets(of_ids(texts, listed, p), p), "sets")
    labels = connected(lists, sets, classes, p)
    drop_cut(sets)
    drop_cut(listed)

    # Rows with equal ids and different texts are one node.
    repeated = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("doc_id")
    same = cut(known.join(repeated, "doc_id", "left_semi").join(groups, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b").distinct(), "same")
    labels = labels if same.isEmpty() else merged(labels, same)

    out = rows.join(groups, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if labels is not None:
        top = labels.toDF("__id", "__top")
        out = out.join(top, out["component_id"] == top["__id"], "left").select("doc_id", "n_shingles", F.coalesce("__top", "component_id").alias("component_id"))
    return out


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reach JOIN two ON other = a),
least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON doc_id = node
"""
