"""Queries over source texts that Spark derives from the driver's tables: what a file's text says must be what the tables said."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators import extract
from repolith.operators.lineage import cut, shared_dir
from repolith.plans.catalog import query
from repolith.sources.adapters import SUPPLIER_EDGES, SUPPLIER_PATHS, Tables
from repolith.sources.index import CodeIndex


def _filled(template: str, **values: Column) -> Column:
    """A text with <name> replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


# --- TypeScript -------------------------------------------------------------------------

_IMPORT = "import def, { one, two as alias } from '../../<dst>'; // import x from './no'"
_HEAD = "const lib = require('./lib'), text = \"require('./quoted')\";"
_PART = """/* function hidden_<key>() { */
export async function part_<key><T>(a: { b: T[] }, c = '}'): Promise<{ d: T }> {
  const out = `used(${inner_<key>(a)}) ${'}'}` + "quoted(1)"; // noted(2)
  return await this.next.run(out, /\\{(/g, () => { deep_<key>(); });
}"""
_CLASS = """export class S<key> extends Base<{ x: string }> {
  private kept = make();
  run(a: string): { y: number } { return helper(a); }
  open(a: string): void;
}
export default S<key>;
interface I<key> {
  of(a: string): number;
}"""
_PARTS_OF = "parts AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS j FROM (SELECT l_partkey AS p, max(struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)).c AS s FROM lineitem GROUP BY 1) WHERE s IN (SELECT s_suppkey FROM spath))"
_PLACED = f"{SUPPLIER_PATHS}, {SUPPLIER_EDGES}, {_PARTS_OF}, size AS (SELECT path || '.ts' AS path, s_suppkey AS s, (SELECT count(*) FROM sedges WHERE src = path) AS ni, (SELECT count(*) FROM parts WHERE s = s_suppkey) AS np FROM spath), f AS (SELECT size.*, p, ni + 1 + 5 * (j - 1) + 2 AS lno FROM size JOIN parts USING (s)), c AS (SELECT *, ni + 5 * np + 2 AS lno FROM size)"


def _modules(t: Tables) -> DataFrame:
    """path, content: a module for each supplier that imports its neighbours and has a function for each of its parts, with code in strings, comments and templates."""
    last = t.raw("lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"].alias("s_suppkey"))
    functions = last.groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda k: _filled(_PART, key=k.cast("string"))).alias("functions"))
    lines = t.supplier_edges().groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list("dst")), lambda d: _filled(_IMPORT, dst=d)).alias("imports"))
    x = t.supplier_paths().join(lines, "path", "left").join(functions, "s_suppkey", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce("imports", none), F.array(F.lit(_HEAD)), F.coalesce("functions", none), F.array(_filled(_CLASS, key=F.col("s_suppkey").cast("string"))))
    return x.select(F.concat("path", F.lit(".ts")).alias("path"), F.array_join(parts, "\n").alias("content"))


@query(f"""WITH {_PLACED} SELECT path, type, name, start_line, end_line, names FROM (
SELECT src || '.ts' AS path, 'import' AS type, '../../' || dst AS name, row_number() OVER (PARTITION BY src ORDER BY dst) AS start_line, row_number() OVER (PARTITION BY src ORDER BY dst) AS end_line, 'def|one|alias' AS names FROM sedges
UNION ALL SELECT path, 'import', './lib', ni + 1, ni + 1, '' FROM size
UNION ALL SELECT path, 'function', 'part_' || p, lno, lno + 3, '' FROM f
UNION ALL SELECT path, 'class', 'S' || s, lno, lno + 4, 'private kept = make()|run(a: string): {{ y: number }}' FROM c
UNION ALL SELECT path, 'export_default', 'S' || s, lno + 5, lno + 5, '' FROM c
UNION ALL SELECT path, 'interface', 'I' || s, lno + 6, lno + 8, '' FROM c)""")
def ts_nodes(t: Tables) -> DataFrame:
    """Imports, exports and definitions of TypeScript files, by tokens."""
    return extract.definitions(cut(_modules(t), "modules")).select("path", "type", "name", "start_line", "end_line", F.array_join("methods", "|").alias("names"))


@query(f"""WITH {_PLACED} SELECT path, '' AS caller_symbol, 'require' AS callee_symbol, ni + 1 AS line FROM size
UNION ALL SELECT path, 'part_' || p, unnest(['inner_' || p, 'run', 'deep_' || p]), lno + unnest([1, 2, 2]) FROM f
UNION ALL SELECT path, '', 'make', lno + 1 FROM c UNION ALL SELECT path, 'run', 'helper', lno + 2 FROM c""")
def ts_calls(t: Tables) -> DataFrame:
    """Calls of TypeScript files: neither strings, comments and regular expressions nor declarations count, code in templates does."""
    return extract.calls(cut(_modules(t), "modules"))


@query(f"""WITH {_PLACED}, lines AS (
SELECT src || '.ts' AS path, row_number() OVER (PARTITION BY src ORDER BY dst) AS lno, 'import def, {{ one, two as alias }} from ''../../' || dst || '''; // import x from ''./no''' AS line FROM sedges
UNION ALL SELECT path, ni + 1, 'const lib = require(''./lib''), text = "require(''./quoted'')";' FROM size
UNION ALL SELECT path, lno, 'export async function part_' || p || '<T>(a: {{ b: T[] }}, c = ''}}''): Promise<{{ d: T }}>;' FROM f
UNION ALL SELECT path, lno, 'class S' || s || ' {{' || chr(10) || '  private kept = make();' || chr(10) || '  run(a: string): {{ y: number }};' || chr(10) || '}}' FROM c
UNION ALL SELECT path, lno + 5, 'export default S' || s || ';' FROM c
UNION ALL SELECT path, lno + 6, 'interface I' || s || ' {{' || chr(10) || '  of(a: string): number;' || chr(10) || '}}' FROM c)
SELECT path, sha256(string_agg(line, chr(10) ORDER BY lno)) AS skeleton_sha256, CAST(length(string_agg(line, chr(10) ORDER BY lno)) AS INTEGER) AS n_chars FROM lines GROUP BY path""")
def ts_skeletons(t: Tables) -> DataFrame:
    """Whole skeletons, line by line in order: imports and interfaces verbatim, functions and methods without bodies."""
    files = cut(_modules(t), "modules")
    shown = extract.skeletons(files, extract.definitions(files))
    return shown.select("path", F.sha2("skeleton", 256).alias("skeleton_sha256"), F.length("skeleton").alias("n_chars"))


# --- languages with blocks --------------------------------------------------------------

#: Extension, text for a key, and the nodes that it has: type, name, first and last line.
_BLOCKS = {
    "go": ('package p\n// import "no"\nimport (\n\t"a/b<key>"\n\tm "c"\n)\nfunc (r *T) F<key>(a struct{}) string {\n\ts := "}" + `{`\n\treturn s\n}\ntype I<key> interface {\n\tM()\n}\n',
           [("import", "a/b<key>", 3, 6), ("import", "a/b<key>", 4, 4), ("import", "c", 5, 5), ("function", "F<key>", 7, 10), ("interface", "I<key>", 11, 13)]),
    "rs": ("use a::b<key>;\nmod x<key>;\npub fn f<key><'a>(s: &'a str) -> char {\n  let c = '{'; /* } */ \"{{\";\n  c\n}\nstruct P<key>;\npub trait T<key> {\n  // fn no() {}\n}\n",
           [("import", "a::b<key>", 1, 1), ("import", "x<key>", 2, 2), ("function", "f<key>", 3, 6), ("class", "P<key>", 7, 7), ("interface", "T<key>", 8, 10)]),
    "java": ('import a.b.C<key>;\npublic class W<key> {\n  // class No {\n  public int f<key>(int a) {\n    return "}".length() + \'{\';\n  }\n}\ninterface V<key> { void g(); }\n',
             [("import", "a.b.C<key>", 1, 1), ("class", "W<key>", 2, 7), ("function", "f<key>", 4, 6), ("interface", "V<key>", 8, 8)]),
    "cs": ('using A.B<key>;\npublic class W<key>\n{\n    public static int F<key>(int a)\n    {\n        return @"}"".{".Length;\n    }\n}\npublic interface IV<key> { }\n',
           [("import", "A.B<key>", 1, 1), ("class", "W<key>", 2, 8), ("function", "F<key>", 4, 7), ("interface", "IV<key>", 9, 9)]),
    "rb": ("require 'a<key>'\nrequire_relative 'b/c'\nmodule M<key>\n  # def no\n  def f<key>(x)\n    if x then \"end\" end\n  end\nend\n",
           [("import", "a<key>", 1, 1), ("import", "b/c", 2, 2), ("class", "M<key>", 3, 8), ("function", "f<key>", 5, 7)]),
    "kt": ('import a.B<key>\nclass C<key> {\n  fun f<key>(a: Int): Int {\n    return """ } " { """.length\n  }\n  fun g<key>() = 1\n}\nobject O<key>\n',
           [("import", "a.B<key>", 1, 1), ("class", "C<key>", 2, 7), ("function", "f<key>", 3, 5), ("function", "g<key>", 6, 6), ("class", "O<key>", 8, 8)]),
    "swift": ('import Lib<key>\nprotocol P<key> {\n  func no<key>()\n}\nclass C<key> {\n  func f<key>() -> String {\n    return "}" // {\n  }\n}\n',
              [("import", "Lib<key>", 1, 1), ("interface", "P<key>", 2, 4), ("function", "no<key>", 3, 3), ("class", "C<key>", 5, 9), ("function", "f<key>", 6, 8)]),
    "php": ("<?php\nuse A\\B<key>;\nuse function L\\m;\n# function no() {\nfunction f<key>($x) {\n  return '}' . \"{\";\n}\nclass C<key> {\n}\ninterface I<key> {}\n",
            [("import", "A\\B<key>", 2, 2), ("import", "L\\m", 3, 3), ("function", "f<key>", 5, 7), ("class", "C<key>", 8, 9), ("interface", "I<key>", 10, 10)]),
    "dart": ("import 'a<key>.dart';\nexport 'b.dart';\nclass C<key> {\n  // }\n}\nint f<key>(int a) {\n  return '}'.length;\n}\n",
             [("import", "a<key>.dart", 1, 1), ("import", "b.dart", 2, 2), ("class", "C<key>", 3, 5), ("function", "f<key>", 6, 8)]),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_BLOCK_NODES = _values([(ext, *node) for ext, (_, nodes) in _BLOCKS.items() for node in nodes])


@query(f"SELECT 'p' || p_partkey || '/x.' || ext AS path, type, replace(name, '<key>', CAST(p_partkey AS VARCHAR)) AS name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM part, (VALUES {_BLOCK_NODES}) v(ext, type, name, a, b)")
def block_nodes(t: Tables) -> DataFrame:
    """Definitions and imports of the other languages, with brackets in strings and definitions in comments: a file for each part and language."""
    texts = F.explode(F.array(*(F.struct(F.lit(ext).alias("ext"), F.lit(text).alias("text")) for ext, (text, _) in _BLOCKS.items())))
    files = t.part_keys().select("p_partkey", texts.alias("x")).select(F.concat(F.lit("p"), "p_partkey", F.lit("/x."), "x.ext").alias("path"), F.replace(F.col("x.text"), F.lit("<key>"), F.col("p_partkey").cast("string")).alias("content"))
    return extract.definitions(files).select("path", "type", "name", "start_line", "end_line")


#: Importer, statement, specifier and the files it may mean, first to last. <n> is the number of a case, so that cases don't meet.
_RESOLVED = [
    ("<n>/a/x.py", "from <n>.sub.mod import y", "<n>.sub.mod", ["<n>/sub/mod.py", "<n>/sub/mod/__init__.py", "src/<n>/sub/mod.py", "src/<n>/sub/mod/__init__.py"]),
    ("<n>/a/b/y.py", "from ..sub.mod import y", "..sub.mod", ["<n>/a/sub/mod.py", "<n>/a/sub/mod/__init__.py"]),
    ("<n>/a/c/z.py", "from . import y", ".", ["<n>/a/c/__init__.py"]),
    ("<n>/a/x.rs", "mod deep;", "deep", ["<n>/a/deep.rs", "<n>/a/deep/mod.rs"]),
    ("<n>/a/X.java", "import j<n>.org.Foo;", "j<n>.org.Foo", ["j<n>/org/Foo.java", "<n>/a/Foo.java"]),
    ("<n>/a/X.cs", "using C<n>.Org.Foo;", "C<n>.Org.Foo", ["C<n>/Org/Foo.cs", "<n>/a/Foo.cs"]),
    ("<n>/a/X.kt", "import k<n>.org.Foo", "k<n>.org.Foo", ["k<n>/org/Foo.kt", "k<n>/org/Foo.kts", "<n>/a/Foo.kt"]),
    ("<n>/a/X.scala", "import s<n>.org.Foo", "s<n>.org.Foo", ["src/main/scala/s<n>/org/Foo.scala", "s<n>/org/Foo.scala", "<n>/a/Foo.scala"]),
    ("<n>/a/x.rb", "require_relative '../lib/foo'", "../lib/foo", ["<n>/lib/foo.rb", "<n>/lib/foo"]),
    ("<n>/a/x.php", "<?php\nuse P<n>\\Models\\User;", "P<n>\\Models\\User", ["src/P<n>/Models/User.php", "P<n>/Models/User.php", "<n>/a/User.php"]),
    ("<n>/a/y.php", "<?php\nuse Q<n>\\{One, Two as T};", "Q<n>\\Two", ["src/Q<n>/Two.php", "Q<n>/Two.php", "<n>/a/Two.php"]),
    ("<n>/a/z.php", "<?php\nrequire_once('../inc/z.php');", "../inc/z.php", ["<n>/inc/z.php"]),
    ("<n>/a/x.dart", "import '../foo.dart';", "../foo.dart", ["<n>/foo.dart"]),
    ("<n>/a/x.c", '#include "h<n>/foo.h"', "h<n>/foo.h", ["<n>/a/h<n>/foo.h", "h<n>/foo.h"]),
    ("<n>/a/x.lua", 'require("l<n>.foo")', "l<n>.foo", ["<n>/a/l<n>/foo.lua", "l<n>/foo.lua", "l<n>/foo/init.lua"]),
    ("<n>/a/x.ex", "alias E<n>.AppWeb.UserView", "E<n>.AppWeb.UserView", ["lib/e<n>/app_web/user_view.ex", "lib/e<n>/app_web/user_view.exs", "e<n>/app_web/user_view.ex", "e<n>/app_web/user_view.exs", "<n>/a/user_view.ex"]),
    ("<n>/a/x.zig", '@import("../foo.zig")', "../foo.zig", ["<n>/foo.zig"]),
    ("<n>/a/x.js", "import '../m/foo.js'", "../m/foo.js", [f"<n>/m/foo{e}" for e in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")]),
    ("<n>/a/x.vue", "<script>\nimport f from './w'\n</script>", "./w", [f"<n>/a/w{e}" for e in ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.js")]),
]
_CASES = [(importer, statement, spec, places[k:]) for importer, statement, spec, places in _RESOLVED for k in range(len(places))]
_WINNERS = _values([(k, importer, spec, places[0]) for k, (importer, _, spec, places) in enumerate(_CASES)])


@query(f"SELECT replace(src, '<n>', 'n' || p_partkey) AS src, replace(spec, '<n>', 'n' || p_partkey) AS specifier, replace(dst, '<n>', 'n' || p_partkey) AS dst FROM part JOIN (VALUES {_WINNERS}) v(k, src, spec, dst) ON p_partkey % {len(_CASES)} = k")
def import_resolution_all(t: Tables) -> DataFrame:
    """From texts to edges in all families: each part is a case, in which the first so many places that a specifier may mean hold no file."""
    struct = lambda importer, statement, places: F.struct(F.lit(importer).alias("src"), F.lit(statement).alias("text"), F.array(*map(F.lit, places)).alias("places"))
    cases = F.array(*(struct(i, s, p) for i, s, _, p in _CASES))
    named = lambda c: F.replace(c, F.lit("<n>"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")))
    x = t.part_keys().select("p_partkey", F.get(cases, (F.col("p_partkey") % len(_CASES)).cast("int")).alias("c"))
    importers = x.select(named(F.col("c.src")).alias("path"), named(F.col("c.text")).alias("content"))
    files = cut(importers.unionByName(x.select(F.explode("c.places").alias("path"), "p_partkey").select(named(F.col("path")).alias("path"), F.lit("").alias("content"))), "files")
    return extract.resolve_imports(extract.raw_imports(files), files.select("path"))


# --- the index --------------------------------------------------------------------------

_INDEXED = f"""{SUPPLIER_PATHS}, {SUPPLIER_EDGES}, {_PARTS_OF}, there AS (SELECT s_suppkey AS s, path FROM spath WHERE s_suppkey % 5 <> 0),
links AS (SELECT src, dst FROM sedges JOIN there ON src = there.path WHERE s % 5 <> 1 UNION SELECT src, min(dst) FROM sedges JOIN there ON src = there.path WHERE s % 5 = 1 GROUP BY src)"""


def _small_modules(t: Tables, changed: bool) -> DataFrame:
    """path, s, content: a module for each supplier with its neighbours' imports and a function for each part; changed ones import the first neighbour alone."""
    last = t.raw("lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))["l_suppkey"].alias("s_suppkey"))
    part = "function part_<key>() {\n  call_<key>();\n}" if not changed else "function again_<key>() {\n  recall_<key>();\n}"
    functions = last.groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda k: _filled(part, key=k.cast("string"))).alias("functions"))
    neighbours = F.array_sort(F.collect_list("dst"))
    lines = t.supplier_edges().groupBy(F.col("src").alias("path")).agg((F.slice(neighbours, 1, 1) if changed else neighbours).alias("dsts"))
    none = F.array().cast("array<string>")
    x = t.supplier_paths().join(lines, "path", "left").join(functions, "s_suppkey", "left")
    imports = F.transform(F.coalesce("dsts", none), lambda d: F.concat(F.lit("import '../../"), d, F.lit("';")))
    return x.select(F.concat("path", F.lit(".ts")).alias("path"), F.col("s_suppkey").alias("s"), F.array_join(F.concat(imports, F.coalesce("functions", none)), "\n").alias("content"))


def _index(t: Tables) -> CodeIndex:
    """An index that was built, compacted, and then took in two changes: files that others import go, come and are written anew."""
    first, second = cut(_small_modules(t, False), "modules"), cut(_small_modules(t, True), "modules")
    index = CodeIndex(t.spark, f"{shared_dir(t.spark)}/repolith-index-{uuid.uuid4().hex[:12]}", buckets=16)
    change = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), "content")
    index.apply(change(first.where("s % 5 != 2"), "add"))
    index.compact()
    index.apply(change(second.where("s % 5 = 1"), "change").unionByName(change(first.where("s % 5 = 0"), "unlink")))
    index.apply(change(first.where("s % 5 = 2"), "add"))
    return index


@query(f"""WITH {_INDEXED} SELECT 'file' AS kind, path || '.ts' AS path, '' AS a, '' AS b FROM there
UNION ALL SELECT 'edge', src || '.ts', '../../' || dst, dst || '.ts' FROM links WHERE dst IN (SELECT path FROM there)
UNION ALL SELECT 'import', src || '.ts', '../../' || dst, '' FROM links
UNION ALL SELECT 'symbol', path || '.ts', 'function', CASE s % 5 WHEN 1 THEN 'again_' ELSE 'part_' END || p FROM there JOIN parts USING (s)
UNION ALL SELECT 'call', path || '.ts', CASE s % 5 WHEN 1 THEN 'again_' ELSE 'part_' END || p, CASE s % 5 WHEN 1 THEN 'recall_' ELSE 'call_' END || p FROM there JOIN parts USING (s)""")
def index_refresh(t: Tables) -> DataFrame:
    """Files, imports, resolved edges, symbols and calls of an index after changes: the same as built from the files that are left."""
    index, none = _index(t), F.lit("")
    row = lambda table, kind, a, b: index.read(table).select(F.lit(kind).alias("kind"), "path", F.col(a).alias("a") if isinstance(a, str) else a.alias("a"), F.col(b).alias("b") if isinstance(b, str) else b.alias("b"))
    out = row("files", "file", none, none).unionByName(row("edges", "edge", "specifier", "dst")).unionByName(row("imports", "import", "specifier", none))
    return out.unionByName(row("symbols", "symbol", "type", "name")).unionByName(row("calls", "call", "caller_symbol", "callee_symbol"))
