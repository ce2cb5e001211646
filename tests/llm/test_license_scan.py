"""License scans against word-by-word search and a recursive evaluation of expressions."""

import itertools
import random
import re

import pyarrow as pa

from repolith.llm import license_scan as ls

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
DOWN = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words_of(text):
    return [w.translate(DOWN) for w in WORD.findall(text or "")]


def places(words, phrase):
    p = phrase.split()
    return [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]


def expected(text):
    words = words_of(text)
    starts = [k for p in ls.BASE for k in places(words, p)]
    base = {label for p, label in ls.BASE.items() if places(words, p)}
    labels = base | {label for p, (label, _) in ls.NOTICES.items() if places(words, p)}
    left = [1 - ls.BASE_WEIGHT for p in ls.BASE if places(words, p)] + [1 - w for p, (_, w) in ls.NOTICES.items() if places(words, p)]
    tagged = set()
    for found in re.finditer(r"(?<![0-9a-z\x80-\U0010ffff])spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:(?=([^\n]*))", (text or "").translate(DOWN)):
        value = grammar(found[1])
        tagged |= value[0] if value else set()
    score = 1.0
    for x in left + [1 - ls.TAG_WEIGHT] * len(tagged):
        score *= x
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels | tagged)), round(1 - score, 9))


def grammar(line):
    """(families, permissive) by recursive descent over the longest run of tokens that can stand there, or None."""
    tokens, at, depth, wants = [], 0, 0, True
    pattern = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:_-]*)")
    while found := pattern.match(line, at):
        t, at = found[1], found.end()
        if wants:
            if t == "(":
                depth += 1
            elif t in (")", "or", "and", "with"):
                return None
            else:
                wants = False
        elif t == ")" and depth:
            depth -= 1
        elif t in ("or", "and", "with"):
            wants = True
        else:
            break
        tokens.append(t)
    if wants or depth:
        return None
    left = list(tokens)

    def some(level):
        if level == 3:
            t = left.pop(0)
            if t != "(":
                f = ls.family(t)
                return ({f} if f else set()), f in ls.PERMISSIVE, True
            out = some(0)
            left.pop(0)
            return out[0], out[1], False
        out = some(level + 1)
        while left and left[0] == ("or", "and", "with")[level]:
            left.pop(0)
            more = some(level + 1)
            if level == 2:
                if not (out[2] and more[2]):
                    raise ValueError
                out = out[0], out[1], False
            else:
                out = out[0] | more[0], (out[1] or more[1]) if level == 0 else (out[1] and more[1]), False
        return out

    try:
        return some(0)[:2]
    except ValueError:
        return None


def test_expressions_are_the_grammar():
    names = ["mit", "apache-2.0", "gpl-2.0+", "foo-1", "llvm-exception", "and", "or", "with", "(", ")", "*/"]
    some = list(itertools.product(names, repeat=3)) + [tuple(random.Random(k).choices(names, [4, 3, 3, 2, 2, 5, 5, 3, 4, 4, 1], k=9)) for k in range(6000)]
    sound = 0
    for parts in some:
        line = " ".join(parts)
        got, want = ls.expression(ls.tokens(line.encode())), grammar(line)
        assert (got and (set(got[0].families), got[0].permissive)) == want, line
        sound += want is not None
    assert sound > 500


def test_precedence():
    value, postfix = ls.expression(ls.tokens(b"gpl-2.0 with classpath-exception-2.0 and mit or (apache-2.0 and isc) extra words"))
    assert postfix == "gpl-2.0 classpath-exception-2.0 with mit and apache-2.0 isc and or"
    assert value.permissive and value.families == {"gpl", "mit", "apache", "isc"} and not value.single
    assert ls.expression(ls.tokens(b" (mit or isc) with x")) is None


TEXTS = [
    None, "", "MIT License", "the MIT\n\n-- License, mit license.mit  license", "permit license", "mit licenses", "MIT", "license", "éMIT License", "mit_license", "mit9license",
    "GNU Lesser General Public License", "Apache License, Version 2.0. SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause", "// SPDX-License-Identifier: MIT and\nmit",
    "spdx license identifier mit", "xspdx-license-identifier: mit", "SPDX-License-Identifier: ISC */ Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier:CC-BY-NC-4.0 SPDX-License-Identifier: mit",
    "mit license " * 5000, "a\x00mit\x00license\x00", "All rights reserved", "mit general public license mit license", "日本 mit license 日本mit license",
]


def summaries(rows):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows]


def test_scan_is_the_search_by_words(spark):
    rng = random.Random(8)
    parts = ["mit", "license", "MIT License", "apache", "general public", "public", "general", "\n", ", ", "é", "cc", "by", "nc", "spdx-license-identifier: ", "spdx", "SPDX-License-Identifier:", "or", "and", "(", ")", "isc", "bsd", "x1"]
    texts = TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " - "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(ls.scan(df).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for t, got in zip(texts, summaries(rows), strict=True):
        assert got == expected(t), t


def test_a_texts_words_dont_reach_into_the_next():
    n, finds = ls.scan_texts(pa.array(["x", "mit", "license", None, "spdx-license", "identifier: mit"]).slice(1))
    assert n.tolist() == [1, 1, 0, 2, 2] and finds == []


def test_spans_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "mit license", 1, 2), (1, "SPDX-License-Identifier: mit or x", 1, 2), (1, None, 1, 2), (1, None, 1, 2)], "doc_id long, text string, n_words long, labels long")
    rows = ls.scan(df, spans=True).collect()
    assert len(rows) == 4 and sorted(r.labels for r in rows) == ["", "", "mit", "mit"]
    assert [(f.start, f.words, f.phrase, f.labels, f.permissive, f.postfix) for r in rows for f in r.found] == [(0, 2, "mit license", ["mit"], None, None), (0, 3, ls.TAG, ["mit"], True, "mit x or")]
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    from repolith.llm.entry import queries

    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries()["op13_license_scan"](spark, at).collect()
    assert len(rows) == len(texts)
    for r, got in zip(rows, summaries(rows), strict=True):
        assert got == expected(texts[r.doc_id])
