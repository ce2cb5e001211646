"""License scans: identifier tags and notice phrases, and what licence expressions say.

Texts lie one after another in a UTF-8 buffer. Lookup tables turn it into words
(runs of digits, letters and bytes above 127, A-Z in lower case) with one space
between words and a line feed between texts; an Aho-Corasick automaton goes over
that once and finds all phrases, overlapping ones too. A find counts where it
begins and ends with whole words, so that a phrase stands wherever its words stand
consecutively, whatever is between them.

An identifier tag is followed by a colon and an expression of licence names, and,
or, with and brackets, up to the end of the line or to what can't go on. A
shunting-yard parser (with binds closer than and, and closer than or) evaluates it
while it reads: a value is the families that are named, whether all names are
known, and whether a choice allows permissive terms only (or: one side does; and:
both do; with: as the licence before it). Broken expressions give no labels.

Labels are the families of phrases and of sound expressions. score is one minus
the product of (1 - weight) over the distinct phrases and labels of expressions.

A null text counts as empty: no words, labels '' and score 0. Repeated rows and
null ids are scanned like any others; very long texts are read whole, one at a
time. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from repolith.llm.common import slices
from repolith.llm.source_divergence import buffer_of

#: Phrases that the contract fixes.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases: label and weight.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.8),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "isc license": ("isc", 0.8),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.3),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
#: Names of licences by what they begin with; the longest that fits counts.
FAMILIES = ("mit", "apache", "gpl", "lgpl", "agpl", "bsd", "0bsd", "mpl", "epl", "isc", "zlib", "unlicense", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd")
PERMISSIVE = {"mit", "apache", "bsd", "0bsd", "isc", "zlib", "unlicense", "cc0", "cc-by"}

_byte = np.arange(256, dtype=np.uint8)
_capital = (_byte >= 0x41) & (_byte <= 0x5A)
IN_WORD = _capital | ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
WORDS = np.where(_capital, _byte + 32, np.where(IN_WORD, _byte, 0x20)).astype(np.uint8)


# --- expressions ----------------------------------------------------------------------


class Value(NamedTuple):
    families: frozenset
    known: bool
    permissive: bool
    single: bool = False  # one name, so that `with` may follow


def family(name: str) -> str | None:
    name = name.removesuffix("+")
    fits = [f for f in FAMILIES if name == f or name.startswith(f + "-")]
    return max(fits, key=len, default=None)


def name_value(name: str) -> Value:
    found = family(name)
    return Value(frozenset([found] if found else []), found is not None, found in PERMISSIVE, True)


BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+:_-]*)")


def tokens(line: bytes, at: int = 0) -> Iterator[str]:
    while found := TOKEN.match(line, at):
        yield found[1].decode()
        at = found.end()


def expression(words: Iterator[str]) -> tuple[Value, str] | None:
    """The value of an expression and its parts in postfix order; None if it is broken. It ends before a token that can't follow."""
    values: list[Value] = []
    waiting: list[str] = []
    postfix: list[str] = []
    depth, wants = 0, True  # wants a name

    def apply() -> bool:
        op = waiting.pop()
        right, left = values.pop(), values.pop()
        postfix.append(op)
        if op == "with":
            values.append(left._replace(single=False))
            return left.single and right.single
        both = left.permissive and right.permissive if op == "and" else left.permissive or right.permissive
        values.append(Value(left.families | right.families, left.known and right.known, both))
        return True

    for word in words:
        if wants:
            if word == "(":
                waiting.append(word)
                depth += 1
            elif word == ")" or word in BINDS:
                return None
            else:
                values.append(name_value(word))
                postfix.append(word)
                wants = False
        elif word == ")" and depth:
            while waiting[-1] != "(":
                if not apply():
                    return None
            waiting.pop()
            values[-1] = values[-1]._replace(single=False)
            depth -= 1
        elif word in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                if not apply():
                    return None
            waiting.append(word)
            wants = True
        else:
            break
    if wants or depth:
        return None
    while waiting:
        if not apply():
            return None
    return values[0], " ".join(postfix)


# --- scan -----------------------------------------------------------------------------


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {TAG, *BASE, *NOTICES}:
        found.add_word(phrase, phrase)
    found.make_automaton()
    return found


class Find(NamedTuple):
    doc: int
    word: int
    words: int
    phrase: str
    value: Value | None = None
    postfix: str = ""


def scan_texts(texts: pa.Array) -> tuple[np.ndarray, list[Find]]:
    """The number of words of each text, and what is found in them, by text and place."""
    data, bounds = buffer_of(texts)
    if not len(texts):
        return np.zeros(0, np.int64), []
    ends = bounds[1:] + np.arange(len(texts))  # a text's end mark, once each has one
    marked = np.insert(data, bounds[1:], 0)
    inside = IN_WORD[marked]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[ends] = True
    plain = WORDS[marked]
    plain[ends] = 0x0A
    raw_first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    doc_of = np.searchsorted(ends, raw_first)
    n_words = np.bincount(doc_of, minlength=len(texts))
    before = np.cumsum(n_words) - n_words
    line = plain[keep]
    wordy = inside[keep]
    first = np.flatnonzero(wordy & ~np.concatenate([[False], wordy[:-1]]))
    text = line.tobytes().decode("latin-1")  # a character for each byte
    raw, finds = marked.tobytes(), []
    for last, phrase in automaton().iter(text):
        start = last - len(phrase) + 1
        if (start and text[start - 1] not in " \n") or text[last + 1] not in " \n":
            continue
        word = int(np.searchsorted(first, start))
        doc = int(doc_of[word])
        place, n = word - int(before[doc]), phrase.count(" ") + 1
        if phrase != TAG:
            finds.append(Find(doc, place, n, phrase))
            continue
        found = read_tag(raw, int(raw_first[word + n - 1]), int(ends[doc]))
        if found:
            finds.append(Find(doc, place, n, TAG, *found))
    return n_words, sorted(finds, key=lambda f: (f.doc, f.word, f.phrase))


def read_tag(raw: bytes, last_word: int, end: int) -> tuple[Value, str] | None:
    """The expression behind a tag whose last word begins at last_word."""
    found = re.compile(rb"[a-zA-Z]+[ \t]*:").match(raw, last_word, end)
    if not found:
        return None
    stop = raw.find(b"\n", found.end(), end)
    return expression(tokens(raw[found.end() : end if stop < 0 else stop].lower()))


def judged(finds: list[Find]) -> tuple[set[str], set[str], float]:
    """Labels of base phrases, all labels, and the score."""
    base = {BASE[f.phrase] for f in finds if f.phrase in BASE}
    weights: dict[str, float] = {}
    labels = set(base)
    for f in finds:
        if f.value is not None:
            labels |= f.value.families
            weights |= {f"tag {x}": TAG_WEIGHT for x in f.value.families}
        elif f.phrase in BASE:
            weights[f.phrase] = BASE_WEIGHT
        else:
            label, weights[f.phrase] = NOTICES[f.phrase]
            labels.add(label)
    return base, labels, 1.0 - math.prod(1.0 - weights[k] for k in sorted(weights))


FOUND = "array<struct<start:long,words:int,phrase:string,labels:array<string>,permissive:boolean,postfix:string>>"
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, spans: bool = False) -> DataFrame:
    """A row for each document; with spans also `found`: all phrases and sound tags with their places, expressions in postfix order."""
    schema = StructType([StructField("doc_id", documents.schema["doc_id"].dataType), *StructType.fromDDL(SCHEMA + (f", found {FOUND}" if spans else ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(text):
                n_words, finds = scan_texts(text[a:b])
                mine: list[list[Find]] = [[] for _ in range(b - a)]
                for f in finds:
                    mine[f.doc].append(f)
                rows = []
                for doc_id, n, found in zip(ids[a:b], n_words.tolist(), mine, strict=True):
                    starts = [f.word for f in found if f.phrase in BASE]
                    base, labels, score = judged(found)
                    row = {"doc_id": doc_id, "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score}
                    if spans:
                        row["found"] = [{"start": f.word, "words": f.words, "phrase": f.phrase, "labels": sorted(judged([f])[1]), "permissive": f.value and f.value.permissive, "postfix": f.postfix or None} for f in found]
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
