"""TypeScript by tokens, other languages by blocks, and where imports lead."""

import random

import pytest
from pyspark.sql import functions as F

from repolith.functions import blocks
from repolith.functions.ecma import Source
from repolith.operators import extract


def kinds(text):
    return [(t, n) for t, n, *_ in Source(text).nodes]


def called(text):
    return [(a, b) for a, b, _ in Source(text).calls]


@pytest.mark.parametrize("text,want", [
    ("import a, * as b from 'm';\nimport { c, d as e, type F } from \"n\"\nimport 'side'\nimport type { G } from './g'", [("m", ["a", "b"]), ("n", ["c", "e", "F"]), ("side", []), ("./g", ["G"])]),
    ("import {\n  one, // from 'no'\n  two as deux,\n} from './multi' with { type: 'json' };\nx()", [("./multi", ["one", "deux"])]),
    ("const a = require('./a'), { b } = require(\"../b\");\nvar c = require('./c.js')\nmodule.exports = { a }", [("./a", []), ("../b", []), ("./c.js", [])]),
    ("const n = './x'; const m = require(n); require.resolve('./y'); import('./z'); x.require('./w'); require(`./t`); // require('./v')", []),
    ("describe('x', () => { const y = require('./inner') })", [("./inner", [])]),
    ("import fs = require('fs');", [("fs", ["fs"])]),
])
def test_imports(text, want):
    assert [(n, names) for t, n, _, _, _, names in Source(text).nodes if t == "import"] == want


def test_assigned_methods():
    text = """var res = exports = module.exports = {};
res.one = function one(body) { return body; };
res.two =
res.three = function (type) { return type; };
A.prototype.four = async (name, value) => ({ name, value });
res.MAX = 3600;
res.copy = res.one;
res['five'] = function () {};
local = () => 1
"""
    assert [(n, a, b) for t, n, _, a, b, _ in Source(text).nodes if t == "method"] == [("one", 2, 2), ("two", 3, 4), ("three", 4, 4), ("four", 5, 5)]


def test_declarations_and_their_ends():
    text = """export default class extends B {}
export abstract class A<T extends { a: B }> implements I {
  @In({ x: '}' }) private m: Map<string, number> = new Map<string, number>();
  static #p = make()
  static { boot(); }
  over(a: string): void;
  over(a: any) {
    return `}${a}`;
  }
}
export interface I { f(a: string): void }
declare function only(a: string): void;
function plain(a: { b: C } = {}): Array<{ x: Y }> {
  return /[/}]{/.test(a) ? 1 / 2 : { nested() {} };
}
export const f = async (a: number): Promise<void> => {
  await g(a)
}, h = x => x
  + 1
let v: { a: () => void } = w
export { f as g, h } from './h'
export * as all from "./all"
export default connect(a)(b);
if (a) { function inner() {} }
"""
    got = [(t, n, a, b) for t, n, _, a, b, _ in Source(text).nodes]
    assert got == [
        ("export_default", "default", 1, 1), ("class", "A", 2, 10), ("interface", "I", 11, 11), ("function", "plain", 13, 15), ("arrow_function", "f", 16, 18), ("arrow_function", "h", 18, 19),
        ("export", "./h", 21, 21), ("export", "./all", 22, 22), ("export_default", "connect", 23, 23), ("function", "inner", 24, 24),
    ]
    methods = next(x[5] for x in Source(text).nodes if x[1] == "A")
    assert methods == ["@In({ x: '}' }) private m: Map<string, number> = new Map<string, number>()", "static #p = make()", "over(a: any)"]


def test_calls_are_calls():
    text = """top(); // no()
const s = "no(1)" + 'no(2)' + `no(3) ${yes(`${deep(4)} no(5)`)} no(6)` + /no(7)\\/no(8)[/(]/.source;
function f(a = first()) { if (a) while (b(a)) a.b?.c().d(e); return new Foo.Bar(x); }
class K { constructor() { super(); this.go() } static get v() { return gen<T>(1) } no(a): void; async *it() { yield* more() } }
const o = { m(x) { return one(x) }, k: two(), n: function named() { three() }, async p() { four() } };
interface No { no(a: string): void }
type Nope = { no(a: B): C };
const arrow = (x) => tag`a${inner(x)}`;
list
  .map(x => x)
  .filter(y);
cond ? five() : { six: seven() };
import('no'); obj?.(1); (0, eight)(9); call()(2)
"""
    assert called(text) == [
        ("", "top"), ("", "yes"), ("", "deep"), ("f", "first"), ("f", "b"), ("f", "c"), ("f", "d"), ("f", "Bar"), ("constructor", "go"), ("v", "gen"), ("it", "more"), ("m", "one"), ("", "two"),
        ("named", "three"), ("p", "four"), ("arrow", "tag"), ("arrow", "inner"), ("", "map"), ("", "filter"), ("", "five"), ("", "seven"), ("", "obj"), ("", "call"),
    ]
    assert [line for _, n, line in Source(text).calls if n in ("map", "filter")] == [9, 9]


@pytest.mark.parametrize("text", ["", "\n", "#!/usr/bin/env node", "`", "`${", "'", "/*", "function", "class", "class A", "import", "import {", "export", "export default", "const", "const a =", "a.b =", "}", ")(", "x = /", "f(", "@", "const {", "import x from", "let a:", "interface I", "a ?. b", "=>", "async", "export * from"])
def test_broken_texts_end(text):
    for cut in (text, text + "\n" + text, text + " x", "{" + text):
        s = Source(cut)
        assert isinstance(s.nodes, list) and isinstance(s.calls, list)


def test_any_tokens_end():
    rng = random.Random(4)
    words = ["import", "export", "default", "class", "function", "const", "=", "=>", "(", ")", "{", "}", "[", "]", "<", ">", ",", ";", ":", ".", "a", "b", "'s'", "`", "${", "\n", "/", "async", "interface", "type", "from", "as", "require", "*", "@", "?", "new", "//", "/*"]
    for _ in range(1500):
        s = Source(" ".join(rng.choice(words) for _ in range(rng.randrange(40))))
        assert isinstance(s.nodes, list) and isinstance(s.calls, list)
    for one in ("(", "{", "a.", "<", "`${", "class A {", "x = y =", "f(", "a<"):  # long runs take no quadratic time
        s = Source(one * 3000)
        assert isinstance(s.nodes, list)


def test_blanks_keep_places():
    for fam, text in (("go", 'a "}" `{\n}` // {\n/* { */ b'), ("rs", "let c = '{'; r#\"}\"#; 'a // }"), ("rb", "x = '#' # end\n\"a#{b}\""), ("php", "# {\n#[Attr]\n'}'")):
        code = blocks.blanked(text, fam, True)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert not set(code) & set("{}") or fam == "rs"
    assert "[Attr]" in blocks.blanked("# {\n#[Attr]\n'}'", "php", True) and "'}'" in blocks.blanked("# {\n'}'", "php", False)


def test_vue_scripts_keep_their_lines(spark):
    text = "<template>\n  <a/>\n</template>\n<script setup>\nimport x from './x'\nfunction f() { g() }\n</script>\n"
    files = spark.createDataFrame([("a.vue", text)], "path string, content string")
    assert [(r.type, r.name, r.start_line) for r in extract.definitions(files).collect()] == [("import", "./x", 5), ("function", "f", 6)]
    assert [(r.caller_symbol, r.callee_symbol, r.line) for r in extract.calls(files).collect()] == [("f", "g", 6)]


def test_grouped_php_uses(spark):
    files = spark.createDataFrame([("x.php", "<?php\nuse A\\{B, C as D,\n  E\\F};\nuse G\\H as I;\n$f = function() use ($y) {};")], "path string, content string")
    assert sorted(r.specifier for r in extract.raw_imports(files).collect()) == ["A\\B", "A\\C", "A\\E\\F", "G\\H"]


def test_paths_out_of_the_root_and_own_files(spark):
    rows = [("a.py", "py", ".", True), ("p/__init__.py", "py", ".", True), ("x.zig", "zig", "../../y.zig", True), ("m.rs", "rs", "crate::m", False)]
    imports = spark.createDataFrame(rows, "path string, family string, specifier string, is_relative boolean")
    paths = spark.createDataFrame([("__init__.py",), ("p/__init__.py",), ("y.zig",), ("m.rs",)], "path string")
    assert [(r.src, r.dst) for r in extract.resolve_imports(imports, paths).collect()] == [("a.py", "__init__.py")]
    assert imports.select(F.size(extract.candidates(F.col("family"), F.col("path"), F.col("specifier"))).alias("n")).where("n is null").count() == 0


def test_rows_of_a_large_batch_are_handed_on_in_slices():
    import pyarrow as pa

    text = "function f(a) { return g(a); }\n" * 2000
    batch = pa.RecordBatch.from_pydict({"path": [f"p{k}.ts" for k in range(200)], "family": ["ts"] * 200, "content": [text] * 200})
    read = lambda path, fam, text: [(path, "f", "g", len(text))] * 3
    out = list(extract._read_batches(iter([batch]), extract.CALL_SCHEMA, read))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 600 and max(b.num_rows for b in out) <= 3 * 64
    assert [b.num_rows for b in extract._read_batches(iter([batch.slice(0, 1)]), extract.CALL_SCHEMA, read)] == [3]
