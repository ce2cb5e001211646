"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding takes the segmentation with the largest total score of the model's
pieces (ties: fewer pieces, then the longer last piece). The search keeps the
scores of a window of positions, as many as the longest piece has characters,
and the backpointers since the last boundary that was committed. Once the paths
of all surviving positions converge on one boundary, the pieces before it are
committed and forgotten. Scores never exceed the window. Backpointers are kept
while paths disagree: a few pieces' worth in most texts; in a run of one
character, whose paths never meet, a number for each character.

There are two forms of this search, with equal results and the same window. stream()
follows one text and asks converged() where the surviving paths meet.
Stretch.ids() takes many short words at once in numpy: all go on a character at a
time, each with its window of scores, and every few characters and at their ends
converged() says for all of them how far their paths agree; those pieces are
committed. Words of more than LONG characters go through stream(). In a
vocabulary where no piece has the word mark behind another character, all paths
meet before each mark that follows another character: there a text is cut into
words, and each distinct word of a batch is searched once. With other
vocabularies whole texts go through stream().

A character that no piece covers takes its UTF-8 bytes' pieces, or the unknown
id where the model has no byte pieces. Scores are added exactly, as whole
numbers, so results don't depend on the order of additions; the
library adds in single precision. A model of merge rules is read by its scores
alone, which is not what the library does with such a model: see the README.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from repolith.llm.common import slices
from repolith.llm.units import Table, gather

MARK = "▁"
UNKNOWN_PENALTY = 10


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.text_of = [p.piece for p in model.pieces]
        kinds = pb.ModelProto.SentencePiece
        self.special = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.trainer_spec.unk_id
        # Single-precision scores are whole numbers over a power of two: scaled, they add exactly. Below them there is
        # room for a count, so that one number compares first by score and then by fewer pieces.
        scale = max(Fraction(p.score).denominator for p in model.pieces)
        key = lambda score: (int(Fraction(score) * scale) << 40) - 1
        self.pieces = {p.piece: (i, key(p.score)) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.longest = max(map(len, self.pieces))
        self.unknown_key = key(min(p.score for p in model.pieces if p.type == kinds.NORMAL) - UNKNOWN_PENALTY)
        #: By their first three characters, the sizes of longer pieces: few lookups a position.
        self.sizes: dict[str, list[int]] = {}
        for p in self.pieces:
            if len(p) > 2:
                self.sizes.setdefault(p[:3], []).append(len(p))
        self.sizes = {c: sorted(set(n)) for c, n in self.sizes.items()}
        marks_lead = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})") if marks_lead and self.prefix else None
        #: No piece joins a line end to anything: paths meet before and behind it.
        self.lines = not any("\n" in p and len(p) > 1 for p in self.pieces)
        self.stretch = Stretch(self)

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a normalised text, given out as soon as they are certain."""
        n, longest, wide = len(text), self.longest, self.longest + 1
        piece_at, sizes_at, unknown = self.pieces.get, self.sizes.get, (-1, self.unknown_key)
        # The window: keys of the positions from i to i + longest, by position modulo its width. None: not reached.
        window: list[int | None] = [None] * wide
        window[0] = 0
        # Of the positions behind done: the last piece's start and its id (-1: unknown character).
        done, back, check = 0, [(0, -1)], 8
        self.held = 0
        for i in range(n):
            here, window[i % wide] = window[i % wide], None
            while len(back) <= min(i + longest, n) - done:
                back.append((0, -1))
            # Starts come in rising order and only a better key replaces one: of equals, the longer last piece stays.
            for size in (1, 2, *sizes_at(text[i : i + 3], ())):
                if i + size > n:
                    break
                found = piece_at(text[i : i + size]) or (unknown if size == 1 else None)
                if found:
                    old = window[(i + size) % wide]
                    if old is None or here + found[1] > old:
                        window[(i + size) % wide] = here + found[1]
                        back[i + size - done] = (i, found[0])
            self.held = max(self.held, len(back))
            if i + 1 < min(check, n):
                continue
            at = self.converged([k for k in range(i + 1, min(i + longest, n) + 1) if window[k % wide] is not None], back, done)
            if at > done:
                ids, k = [], at
                while k > done:
                    start, piece = back[k - done]
                    ids.append((start, piece))
                    k = start
                for start, piece in reversed(ids):
                    yield from (piece,) if piece >= 0 else self.spelt(text[start])
                # What lies before the boundary is forgotten, and keys are counted from the least one, so that they stay small.
                back, done = back[at - done :], at
                least = min(k for k in window if k is not None)
                window = [None if k is None else k - least for k in window]
            check = i + 1 + max(8, i + 1 - done)  # paths that don't meet are followed again once twice as much is held

    def spelt(self, character: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte_id[b] for b in character.encode("utf-8", "replace")] if self.byte_id else [self.unknown]

    @staticmethod
    def converged(alive: list[int], back: list, done: int) -> int:
        """The last boundary that the paths of all positions that are reached and not yet passed have in common."""
        ends = set(alive)
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(back[far - done][0] if far > done else done)
        return ends.pop()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits) of texts, one after another, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        if self.cut is None:
            return self.flat([self.normalise(t) for t in texts.to_pylist()])
        # Words are cut before marks; a line end begins a word too, one without a mark. Marks in a row may join: such texts are cut one by one.
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{MARK}"), pc.equal(texts, ""))
        if pc.any(odd).as_py():
            words = [self.cut.split(self.normalise(t)) if o and t else [] if o else self.words(t) for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            return gather(pa.array(words, pa.list_(pa.string())), lambda words: self.stretch.ids(words.to_pylist()))
        spaced = pc.replace_substring(texts, "\n", " \n") if self.lines else texts
        return gather(pc.split_pattern(spaced, " "), lambda words: self.stretch.ids([w if w[:1] == "\n" and self.lines else MARK + w for w in words.to_pylist()]))

    def words(self, text: str) -> list[str]:
        words = (text.replace("\n", " \n") if self.lines else text).split(" ")
        return [w if w[:1] == "\n" and self.lines else MARK + w for w in words]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self.stretch.ids(texts)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def encode(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one each."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "replace"))
                run.clear()
            if i >= 0 and i not in self.special:
                out.append(self.text_of[i])
        text = "".join(out)
        return text.removeprefix(self.prefix).replace(MARK, " ") if self.prefix else text.replace(MARK, " ")


class Stretch:
    """The search for many short words at once."""

    #: Longer words go through stream().
    LONG = 24
    AT_ONCE = 60_000
    #: Paths are followed back each time so many characters have been read, and at words' ends.
    CHECK = 8

    def __init__(self, c: Codec):
        self.c = c
        nodes: dict[str, int] = {"": 0}
        for p in c.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        step = [(nodes[x[:-1]] << 21 | ord(x[-1]), i) for x, i in nodes.items() if x]
        self.next = Table(np.array([k for k, _ in step], np.int64), np.array([i for _, i in step], np.int32))
        self.piece = np.full(len(nodes), -1, np.int32)
        # Keys of stream() in fewer bits: a word's number of pieces fits in 5. Without that room for a sum, all go through stream().
        self.key = np.zeros(len(nodes), np.int64)
        keys = {p: ((k + 1 >> 40) << 5) - 1 for p, (_, k) in c.pieces.items()}
        self.unknown = ((c.unknown_key + 1 >> 40) << 5) - 1
        self.fits = max(map(abs, [*keys.values(), self.unknown])) < 1 << 57
        for p, (i, _) in c.pieces.items():
            self.piece[nodes[p]] = i
            self.key[nodes[p]] = keys[p] if self.fits else 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, one after another, and each text's number. Some texts at a time, whose arrays stay in the processor's cache."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        part = np.cumsum(size) // self.AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        some = [self.some(texts[a:b], size[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        return tuple(np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.uint32), size)

    def some(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = (size <= self.LONG) & self.fits
        words = [t for t, s in zip(texts, short.tolist(), strict=True) if s]
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chosen, pieces = self.in_step(chars, size[short])
        # Unknown characters have several ids, long words theirs from stream(): both are put in where they begin.
        first = np.cumsum(size) - size
        place = (first[short] - (np.cumsum(size[short]) - size[short])).repeat(size[short])[chosen] + chosen
        spelt = {int(place[k]): self.c.spelt(chr(chars[chosen[k]])) for k in np.flatnonzero(pieces == -1)}
        for k in np.flatnonzero(~short).tolist():
            spelt[int(first[k])] = list(self.c.stream(texts[k]))
        starts = np.sort(np.concatenate([place, first[~short]]))
        out = np.full(int(size.sum()), -1, np.int64)
        out[place] = pieces
        out, count = out[starts], np.ones(len(starts), np.int64)
        odd = np.searchsorted(starts, np.fromiter(spelt, np.int64, len(spelt)))
        count[odd] = [len(x) for x in spelt.values()]
        ids = np.repeat(out, count).astype(np.uint32)
        at = np.cumsum(count) - count
        for k, x in zip(odd.tolist(), spelt.values(), strict=True):
            ids[at[k] : at[k] + len(x)] = x
        owner = np.searchsorted(np.cumsum(size), starts, "right")
        return ids, np.bincount(owner, count, len(texts)).astype(np.int64)

    def matches(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the text: start, length and node. A walk down the pieces' tree from all positions at once."""
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for size in range(1, self.c.longest + 1):
            if size > 1:
                ok = at + size <= end[at]
                at, node = at[ok], node[ok]
            node = self.next.get(node << 21 | chars[at + size - 1]).astype(np.int64)
            ok = node >= 0
            at, node = at[ok], node[ok]
            is_piece = self.piece[node] >= 0
            found.append((at[is_piece], np.full(int(is_piece.sum()), size), node[is_piece]))
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def in_step(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chosen pieces of words begin and their ids (-1: unknown character)."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ends = np.cumsum(size)
        begin, word_of = ends - size, np.repeat(np.arange(len(size)), size)
        starts, lengths, nodes = self.matches(chars, np.repeat(ends, size))
        known = np.zeros(n, bool)
        known[starts[lengths == 1]] = True
        bare = np.flatnonzero(~known)
        starts, lengths = np.concatenate([bare, starts]), np.concatenate([np.ones(len(bare), np.int64), lengths])
        ids = np.concatenate([np.full(len(bare), -1, np.int32), self.piece[nodes]])
        keys = np.concatenate([np.full(len(bare), self.unknown), self.key[nodes]])
        word, offset = word_of[starts], starts - begin[word_of[starts]]
        order = np.argsort(offset.astype(np.int16), kind="stable")
        word, lengths, ids, keys = word[order], lengths[order], ids[order], keys[order]
        longest, wide, none = int(size.max()), self.c.longest + 1, np.iinfo(np.int64).min
        bounds = np.searchsorted(offset[order], np.arange(longest + 1))
        # Each word's window: keys of the positions from i to i + the longest piece, by position modulo its width.
        window = np.full((len(size), wide), none)
        window[:, 0] = 0
        back, last = np.zeros((len(size), longest + 1), np.int16), np.full((len(size), longest + 1), -1, np.int32)
        done = np.zeros(len(size), np.int64)
        piece = np.full(n, -2, np.int32)
        for i in range(longest):  # starts in rising order, of each end one: only a better key replaces one
            some = slice(bounds[i], bounds[i + 1])
            w, e = word[some], i + lengths[some]
            key = window[w, i % wide] + keys[some]
            window[:, i % wide] = none
            better = key > window[w, e % wide]
            w, e = w[better], e[better]
            window[w, e % wide], back[w, e], last[w, e] = key[better], i, ids[some][better]
            rows = np.flatnonzero(size == i + 1) if (i + 1) % self.CHECK else np.flatnonzero(size > i)
            if len(rows):
                at = self.converged(window, back, rows, i, size)
                self.commit(rows, at, done, back, last, begin, piece)
        chosen = np.flatnonzero(piece != -2)
        return chosen, piece[chosen]

    @staticmethod
    def converged(window: np.ndarray, back: np.ndarray, rows: np.ndarray, i: int, size: np.ndarray) -> np.ndarray:
        """Of each row the last boundary that the paths of all positions that are reached and not yet passed have in common. The
        next position is always reached, as any character has an id."""
        wide = window.shape[1]
        ahead = i + 1 + np.arange(wide - 1)
        alive = (ahead <= size[rows, None]) & (window[rows[:, None], ahead % wide] > np.iinfo(np.int64).min)
        ends = np.where(alive, ahead, i + 1)
        left = np.flatnonzero(ends.max(1) > ends.min(1))
        while len(left):  # the farthest steps back along its path
            mine = ends[left]
            far = mine.max(1)
            mine = np.where(mine == far[:, None], back[rows[left], far][:, None], mine)
            ends[left] = mine
            left = left[mine.max(1) > mine.min(1)]
        return ends[:, 0]

    @staticmethod
    def commit(rows: np.ndarray, at: np.ndarray, done: np.ndarray, back: np.ndarray, last: np.ndarray, begin: np.ndarray, piece: np.ndarray) -> None:
        """Gives out the pieces between the last boundary and the new one, where they are certain."""
        on = at > done[rows]
        rows, at = rows[on], at[on]
        stop = done[rows]
        done[rows] = at
        while len(rows):
            start = back[rows, at].astype(np.int64)
            piece[begin[rows] + start] = last[rows, at]
            on = start > stop
            rows, at, stop = rows[on], start[on], stop[on]


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids, bounds = c.batch(batch.column(1)[low:high])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Of every text: number of ids, CRC-32 of the ids (little-endian, 32 bits each), and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        back = Decoder(c)
        for batch in batches:
            n, crc, same = [], [], []
            for low, high in slices(batch.column(1)):
                texts = batch.column(1)[low:high]
                ids, bounds = c.batch(texts)
                n += np.diff(bounds).tolist()
                crc += [zlib.crc32(ids[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                same += [x == (t or "") for x, t in zip(back.texts(ids, bounds), texts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


class Decoder:
    """Decoding of many texts by one gathering of the pieces' bytes; like Codec.decode() for ids that an encoding made."""

    def __init__(self, c: Codec):
        self.prefix = c.prefix.replace(MARK, " ")
        of = [bytes([c.byte_of[i]]) if i in c.byte_of else b"" if i in c.special else p.replace(MARK, " ").encode() for i, p in enumerate(c.text_of)]
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(of), np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.pool[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], n)].tobytes()
        at = ends[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(self.prefix) for a, b in zip(at, at[1:], strict=False)]


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
