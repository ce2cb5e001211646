"""Merge rules of a byte-level tokenizer, applied to many words at once in numpy."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from repolith.llm.units import Table

#: The characters by which byte-level tokenizers write bytes: printable Latin-1 as itself, the others from 256 on.
_plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_plain))}
NONE = np.int32(2**31 - 1)


class Merges:
    """Ids of words: again and again the pair with the least rank, of equals the leftmost, becomes one symbol."""

    #: Words of more bytes aren't taken.
    LONGEST = 32
    AT_ONCE = 16_384

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = Table(np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64), np.arange(len(pairs), dtype=np.int32))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        chars = [chr(BYTE_CHARS.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab.get(c + x, -1) for c in chars], np.int32) for x in ("", end))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.ranks.get(a.astype(np.int64) << 24 | b)
        return np.where(r < 0, NONE, r)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (not empty, of LONGEST bytes at most), one after another, and each word's number."""
        n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        first = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
        out = np.full((len(words), self.LONGEST), -1, np.int32)
        order = np.argsort(n, kind="stable")  # words of about one length go together
        for low in range(0, len(order), self.AT_ONCE):
            rows = order[low : low + self.AT_ONCE]
            size = n[rows]
            width = int(size[-1])
            cols = np.arange(width)
            inside = cols < size[:, None]
            byte = data[np.where(inside, first[rows][:, None] + cols, first[rows][:, None])]
            symbols = np.where(cols == size[:, None] - 1, self.last[byte], self.inner[byte])
            symbols[~inside] = -1
            self.merge(symbols, rows, out)
        count = (out >= 0).sum(1)
        return out[out >= 0].astype(np.uint32), count

    def merge(self, symbols: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if symbols.shape[1] > 1:
            rank = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
            rank[symbols[:, 1:] < 0] = NONE
        else:
            rank = np.full((len(symbols), 1), NONE)
        while len(symbols):
            k = rank.argmin(1)
            least = rank[np.arange(len(k)), k]
            ready = least == NONE
            if ready.any():
                out[rows[ready], : symbols.shape[1]] = symbols[ready]
                left = ~ready
                symbols, rank, rows, k, least = symbols[left], rank[left], rows[left], k[left], least[left]
                if not len(symbols):
                    return
            at, cols = np.arange(len(k)), np.arange(symbols.shape[1])
            symbols[at, k] = self.made[least]
            behind = cols[:-1] > k[:, None]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(behind[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            self.again(symbols, rank, at, k)
            self.again(symbols, rank, at[k > 0], k[k > 0] - 1)

    def again(self, symbols: np.ndarray, rank: np.ndarray, at: np.ndarray, k: np.ndarray) -> None:
        """New ranks of the pairs at k."""
        after = np.where(k + 1 < symbols.shape[1], symbols[at, np.minimum(k + 1, symbols.shape[1] - 1)], -1)
        here = after >= 0
        new = np.full(len(k), NONE)
        new[here] = self.rank(symbols[at[here], k[here]], after[here])
        rank[at, np.minimum(k, rank.shape[1] - 1)] = np.where(k < rank.shape[1], new, rank[at, np.minimum(k, rank.shape[1] - 1)])
