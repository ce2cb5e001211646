"""Extraction from source texts: imports, definitions, calls, skeletons; and the resolution of imports to files."""

from __future__ import annotations

import ast
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import blocks, ecma
from repolith.operators.lineage import joined_in_blocks

#: Extension -> language family.
LANGUAGES = {
    "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "mts": "ts", "cts": "ts", "vue": "ts", "py": "py", "go": "go", "rs": "rs", "java": "java", "kt": "kt", "kts": "kt",
    "cs": "cs", "rb": "rb", "php": "php", "dart": "dart", "scala": "scala", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hh": "c", "hpp": "c", "hxx": "c",
    "lua": "lua", "ex": "ex", "exs": "ex", "zig": "zig", "swift": "swift",
}

#: Import patterns by family; group 1 is the specifier.
IMPORTS = {
    "ts": [r"""(?m)^[ \t]*(?:import|export)\b[^'";]*?\bfrom\s*['"]([^'"]+)['"]""", r"""(?m)^[ \t]*import\s*['"]([^'"]+)['"]""", r"""\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""],
    "py": [r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b", r"(?m)^[ \t]*import[ \t]+([\w.]+)"],
    "go": [r"""(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"]+)\"""", r"""(?m)^[ \t]+(?:[\w.]+[ \t]+)?"([^"\s]+)"[ \t]*$"""],
    "rs": [r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([\w:]+)"],
    "java": [r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"],
    "kt": [r"(?m)^[ \t]*import[ \t]+([\w.]+(?:\.\*)?)"],
    "scala": [r"(?m)^[ \t]*import[ \t]+((?:\w+\.)*\w+)"],
    "cs": [r"(?m)^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"],
    "rb": [r"""(?m)\brequire_relative[ \t(]+['"]([^'"]+)['"]"""],
    "php": [r"(?m)^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?([\w\\]+)(?<!\\)(?=[ \t]*[;,]|[ \t]+as\b)", r"""\b(?:require|include)(?:_once)?[ \t(]+['"]([^'"]+)['"]"""],
    "dart": [r"""(?m)^[ \t]*import[ \t]+['"](\.[^'"]+)['"]"""],
    "c": [r"""(?m)^[ \t]*#[ \t]*include[ \t]+"([^"]+)\""""],
    "lua": [r"""\brequire[ \t]*\(?[ \t]*['"]([^'"]+)['"]"""],
    "ex": [r"(?m)^[ \t]*(?:alias|import|use|require)[ \t]+([A-Z][\w.]*)"],
    "zig": [r"""@import\(\s*"([^"]+)"\s*\)"""],
}
#: Where a file's nodes show more imports than its edges follow.
NODE_IMPORTS = IMPORTS | {
    "rb": [r"""(?m)^[ \t]*(?:require|require_relative|load)[ \t(]+['"]([^'"]+)['"]""", r"""(?m)^[ \t]*autoload[ \t(]+:\w+,[ \t]*['"]([^'"]+)['"]"""],
    "dart": [r"""(?m)^[ \t]*(?:import|export)[ \t]+['"]([^'"]+)['"]"""],
    "swift": [r"(?m)^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:class|struct|enum|protocol|func|var|let|typealias)[ \t]+)?([\w.]+)"],
}


def php_groups(content: Column) -> Column:
    """The names of `use A\\{B, C as D};`."""
    groups = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*use[ \t]+([\w\\]+\\\{[^}]+\})"), F.lit(1))
    before, names = (lambda g: F.regexp_extract(g, r"^([\w\\]+)\{", 1)), (lambda g: F.split(F.regexp_extract(g, r"\{([^}]+)\}", 1), ","))
    one = lambda g: F.transform(names(g), lambda n: F.concat(before(g), F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), r" as \w+$", "")))
    return F.filter(F.flatten(F.transform(groups, one)), lambda n: ~n.endswith("\\"))


def family(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.get(F.array(table[ext]), 0)


def raw_imports(files: DataFrame) -> DataFrame:
    """path, specifier, is_relative, distinct. Every row is tested by its own family's patterns only."""
    fam = family(F.col("path"))
    found = F.array().cast("array<string>")
    for name, patterns in IMPORTS.items():
        texts = F.col("content")
        mine = reduce(lambda a, b: F.concat(a, b), [F.regexp_extract_all(texts, F.lit(p), F.lit(1)) for p in patterns] + ([php_groups(texts)] if name == "php" else []))
        found = F.when(fam == name, mine).otherwise(found)
    x = files.where(fam.isNotNull() & F.col("content").isNotNull()).select("path", fam.alias("family"), F.explode(F.array_distinct(found)).alias("specifier"))
    rel = F.col("specifier").startswith(".") | (F.col("family") == "c") | ((F.col("family") == "zig") & F.col("specifier").endswith(".zig"))
    return x.where("specifier != ''").select("path", "family", "specifier", rel.alias("is_relative"))


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the root."""
    kind = "array<string>"
    step = lambda s, p: F.when(s.isNull(), s).when((p == "") | (p == "."), s).when(p == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1))).otherwise(F.concat(s, F.array(p)))
    return F.aggregate(F.split(path, "/"), F.array().cast(kind), step, lambda s: F.array_join(s, "/"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


#: The order in which endings are tried, also from Vue files.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")
VUE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.js")
#: The places in which each family looks for a file, first to last. {here} is the importer's folder, {spec} the
#: specifier, {path} its parts as folders, {last} its last part, {up} the folder that a Python specifier's dots name with its parts
#: behind it; other words are as they are.
PLACES = {
    "py": ("{path}.py", "{path}/__init__.py", "src/{path}.py", "src/{path}/__init__.py"),
    "py, relative": ("{up}.py", "{up}/__init__.py"),
    "py, dots alone": ("{here}/__init__.py",),
    "rs": ("{here}/{spec}.rs", "{here}/{spec}/mod.rs"),
    "java": ("{path}.java", "{here}/{last}.java"),
    "cs": ("{path}.cs", "{here}/{last}.cs"),
    "kt": ("{path}.kt", "{path}.kts", "{here}/{last}.kt"),
    "scala": ("src/main/scala/{path}.scala", "{path}.scala", "{here}/{last}.scala"),
    "rb": ("{here}/{spec}.rb", "{here}/{spec}"),
    "php": ("src/{path}.php", "{path}.php", "{here}/{last}.php"),
    "php, relative": ("{here}/{spec}",),
    "dart": ("{here}/{spec}", "{here}/{spec}.dart"),
    "c": ("{here}/{spec}", "{spec}"),
    "lua": ("{here}/{path}.lua", "{path}.lua", "{path}/init.lua"),
    "ex": ("lib/{path}.ex", "lib/{path}.exs", "{path}.ex", "{path}.exs", "{here}/{last}.ex"),
    "zig": ("{here}/{spec}",),
}


def candidates(fam: Column, path: Column, spec: Column) -> Column:
    """The files a specifier may mean, in order of preference."""
    here, slash = directory(path), F.lit("/")
    dots = F.regexp_extract(spec, r"^(\.*)", 1)
    module = F.regexp_replace(spec, r"^\.+", "")
    snake = F.lower(F.regexp_replace(spec, "([a-z0-9])([A-Z])", "$1_$2"))
    parts = F.when(fam == "php", F.regexp_replace(spec, r"\\", "/")).when(fam == "ex", F.regexp_replace(snake, "[.]", "/")).otherwise(F.regexp_replace(spec, "[.]", "/"))
    known = {
        "here": here, "spec": spec, "path": parts, "last": F.element_at(F.split(parts, "/"), -1),
        "up": F.concat(here, slash, F.repeat(F.lit("../"), F.greatest(F.length(dots) - 1, F.lit(0))), F.regexp_replace(module, "[.]", "/")),
    }

    def place(form: str) -> Column:
        return F.concat(*(known[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", form) if x))

    def places(name: str) -> Column:
        return F.array(*map(place, PLACES[name]))

    bare = F.concat(here, slash, F.regexp_replace(spec, r"\.js$", ""))
    relative = spec.startswith(".")
    vue = F.array(F.concat(here, slash, spec), *(F.concat(bare, F.lit(e)) for e in VUE_SUFFIXES))
    out = F.when((fam == "ts") & relative, F.when(path.endswith(".vue"), vue).otherwise(F.array(*(F.concat(bare, F.lit(e)) for e in SUFFIXES), F.concat(here, slash, spec))))
    out = out.when(fam == "py", F.when((dots != "") & (module == ""), places("py, dots alone")).when(dots != "", places("py, relative")).otherwise(places("py")))
    out = out.when((fam == "php") & relative, places("php, relative")).when((fam == "rs") & F.contains(spec, F.lit("::")), F.array().cast("array<string>"))
    for name in PLACES:
        if "," not in name and name != "py":
            out = out.when(fam == name, places(name))
    return F.transform(out, normal_path)


def import_places(imports: DataFrame) -> DataFrame:
    """path, specifier, pos, candidate: the files that each import may mean, first to last."""
    c = imports.select("path", "specifier", F.posexplode(candidates(F.col("family"), F.col("path"), F.col("specifier"))).alias("pos", "candidate"), "family")
    return c.where("candidate is not null and (family != 'py' or candidate != path)").drop("family")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """src, specifier, dst: for each specifier its first candidate that is a file. An equi-join of candidates with the files; nothing is looked up in a file system."""
    hit = import_places(imports).join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    return hit.groupBy(F.col("path").alias("src"), "specifier").agg(F.min_by("candidate", "pos").alias("dst"))


def resolve_aliases(imports: DataFrame, aliases: DataFrame, paths: DataFrame) -> DataFrame:
    """src, specifier, dst through aliases (prefix, base), tried longest prefix first. Aliases are a handful of configuration rows."""
    hit = imports.join(F.broadcast(aliases), F.expr("startswith(specifier, prefix)"))
    base = F.concat("base", F.expr("substring(specifier, length(prefix) + 1)"))
    # Where the last part is a name, endings don't change what . and .. do before it: the way is normalised once for all endings.
    once = hit.select("*", base.alias("base_path")).select("*", normal_path(F.col("base_path")).alias("normal"))
    ends = lambda c: F.array(*(F.concat(F.col(c), F.lit(s)) for s in SUFFIXES))
    options = F.when(F.col("base_path").rlike(r"(^|/)\.{0,2}$"), F.transform(ends("base_path"), normal_path)).otherwise(ends("normal"))
    c = once.select("path", "specifier", (-F.length("prefix")).alias("near"), F.posexplode(options).alias("pos", "candidate")).join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    return c.groupBy(F.col("path").alias("src"), "specifier").agg(F.min_by("candidate", F.struct("near", "pos")).alias("dst"))


def tsconfig_aliases(text: str, folder: str = "") -> list[tuple[str, str]]:
    """(prefix, base) of a tsconfig's paths, for resolve_aliases(); @/ means the root where nothing else is said. Comments and commas before closing brackets are allowed, as in such files."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions") or {}
    base = "/".join(x for x in (folder.strip("/"), *options.get("baseUrl", ".").split("/")) if x not in ("", "."))
    root = f"{base}/" if base else ""
    found = [(k.removesuffix("*"), root + v.removeprefix("./").removesuffix("*")) for k, targets in (options.get("paths") or {}).items() for v in targets]
    return found if any(k == "@/" for k, _ in found) else [*found, ("@/", f"{folder.strip('/')}/" if folder.strip("/") else "")]


def go_module(text: str) -> str | None:
    """The module that a go.mod names."""
    m = re.search(r'^\s*module\s+"?([^\s"]+)"?', text, re.M)
    return m[1] if m else None


def go_edges(imports: DataFrame, paths: DataFrame, module: str) -> DataFrame:
    """An import of a package in the module is an edge to each of its files but tests."""
    pkg = imports.where((F.col("family") == "go") & F.col("specifier").startswith(module)).select(F.col("path").alias("src"), F.regexp_replace(F.expr(f"substring(specifier, {len(module) + 1})"), "^/", "").alias("dir"))
    go = paths.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("path").alias("dst"), directory(F.col("path")).alias("dir"))
    # A file lies in one directory, so that pairs of distinct rows are distinct.
    return joined_in_blocks(pkg.distinct(), go.distinct(), "dir").where("src != dst").select("src", "dst")


def go_test_links(paths: DataFrame) -> DataFrame:
    """x_test.go and x.go, both ways; a test without such a file links with all files of its directory but tests."""
    go = paths.where(F.col("path").endswith(".go")).select("path", directory(F.col("path")).alias("dir")).distinct()
    tests = go.where(F.col("path").endswith("_test.go")).withColumn("code", F.regexp_replace("path", r"_test\.go$", ".go"))
    code = go.where(~F.col("path").endswith("_test.go"))
    own = tests.join(code.select(F.col("path").alias("code")), "code").select(F.col("path").alias("src"), F.col("code").alias("dst"))
    alone = tests.join(own.select(F.col("src").alias("path")), "path", "left_anti").select(F.col("path").alias("src"), "dir")
    links = own.union(joined_in_blocks(alone, code.toDF("dst", "dir"), "dir").select("src", "dst"))
    # Tests are no code, and have either their own file or those of a directory: no pair comes twice.
    return links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.*")


def reexport_edges(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """imports: src, barrel, symbol. reexports: barrel, symbol, source. One hop: consumers get an edge to the real file."""
    return imports.join(reexports, ["barrel", "symbol"]).where("source != src AND source != barrel").select("src", F.col("source").alias("dst")).distinct()


# --- definitions and calls -------------------------------------------------------

#: For families without a parser here: patterns of definitions; group 1 is the name.
DEFINITIONS = {
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("class", r"^type\s+(\w+)\s+(?!interface\b)")],
    "rs": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")],
    "java": [("class", r"^\s*(?:[\w@]+\s+)*(?:class|enum|record)\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("function", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\], ?]+\s+)?(\w+)\s*\(")],
    "cs": [("class", r"^\s*(?:\w+\s+)*(?:class|struct|record)\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("function", r"^\s+(?:(?:public|protected|private|internal|static|async|override|virtual)\s+)+[\w<>\[\],? ]+\s+(\w+)\s*\(")],
    "rb": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(\w+)")],
    "kt": [("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|object)\s+(\w+)")],
    "swift": [("function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("interface", r"^\s*(?:\w+\s+)*protocol\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|struct)\s+(\w+)")],
    "php": [("function", r"^\s*(?!use\b)(?:\w+\s+)*function\s+&?(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|trait)\s+(\w+)")],
    "dart": [("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("function", r"^[\w<>?]+\s+(\w+)\s*\([^;]*\)\s*(?:async\s*)?[{=]")],
}

NODE_SCHEMA = "path string, type string, name string, signature string, start_line long, end_line long, methods array<string>"
CALL_SCHEMA = "path string, caller_symbol string, callee_symbol string, line long"
#: Characters of text whose rows a worker gathers before it hands them on.
SLICE = 1 << 20


def python_nodes(path: str, text: str) -> list[tuple]:
    lines, out = text.splitlines(), []
    for n in ast.parse(text).body:
        if isinstance(n, ast.Import | ast.ImportFrom):
            out.append((path, "import", ("." * n.level + (n.module or "")) if isinstance(n, ast.ImportFrom) else n.names[0].name, lines[n.lineno - 1].strip(), n.lineno, n.end_lineno, [a.asname or a.name for a in n.names if a.name != "*"]))
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((path, "function", n.name, lines[n.lineno - 1].strip().rstrip(":"), n.lineno, n.end_lineno, []))
        elif isinstance(n, ast.ClassDef):
            out.append((path, "class", n.name, lines[n.lineno - 1].strip().rstrip(":"), n.lineno, n.end_lineno, [lines[m.lineno - 1].strip().rstrip(":") for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]))
    return out


@lru_cache
def _rules(fam: str) -> tuple[list, list]:
    return [(k, re.compile(p)) for k, p in DEFINITIONS.get(fam, [])], [re.compile(p) for p in NODE_IMPORTS.get(fam, [])] if fam in DEFINITIONS else []


def pattern_nodes(path: str, text: str, fam: str) -> list[tuple]:
    """Definitions and imports of a language with blocks."""
    return [(path, *x, []) for x in blocks.nodes(text, fam, *_rules(fam))]


def script(path: Column, content: Column) -> Column:
    """A file's code: of a Vue file its script block, with line ends before it so that lines keep their numbers."""
    before = F.regexp_replace(F.regexp_extract(content, r"(?s)^(.*?<script[^>]*>)", 1), r"[^\n]", "")
    return F.when(path.endswith(".vue"), F.concat(before, F.regexp_extract(content, r"(?s)<script[^>]*>(.*?)</script>", 1))).otherwise(content)


def _read_batches(batches: Iterator[pa.RecordBatch], schema: str, read: Callable[[str, str, str], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """What read(path, family, content) gives of each file. A worker holds the rows of some MB of text, however many files a batch of Spark's has."""
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
    for batch in batches:
        rows, size = [], 0
        for low in range(0, batch.num_rows, 64):
            for path, fam, text in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True):
                try:
                    rows += read(path, fam, text)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                size += len(text)
            if rows and size > SLICE:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def _rows_of_files(files: DataFrame, schema: str, read: Callable[[str, str, str], list[tuple]]) -> DataFrame:
    f = files.select("path", family(F.col("path")).alias("family"), script(F.col("path"), F.col("content")).alias("content")).where("family is not null and content is not null")
    return f.mapInArrow(lambda batches: _read_batches(batches, schema, read), schema)


def definitions(files: DataFrame) -> DataFrame:
    """Nodes of each file: Python by its own parser, TypeScript and JavaScript by tokens, other families by patterns outside of comments
    and strings. methods has a class's signature lines, an import's or export's local names. A file that doesn't parse has none. Vue files give their script block."""

    def read(path: str, fam: str, text: str) -> list[tuple]:
        return python_nodes(path, text) if fam == "py" else [(path, *x) for x in ecma.Source(text).nodes] if fam == "ts" else pattern_nodes(path, text, fam)

    return _rows_of_files(files, NODE_SCHEMA, read)


def symbols(nodes: DataFrame, include_methods: bool = False) -> DataFrame:
    """What the symbol index holds: functions, classes, interfaces and assigned methods; class methods on request."""
    own = nodes.where(F.col("type").isin("function", "class", "interface", "method")).select("name", "path", "type", "signature", "start_line", "end_line")
    if not include_methods:
        return own
    m = nodes.where("type = 'class'").select("path", F.explode("methods").alias("signature"), "start_line", "end_line")
    return own.unionByName(m.select(F.regexp_extract("signature", r"(?:def\s+)?(\w+)\s*\(", 1).alias("name"), "path", F.lit("method").alias("type"), "signature", "start_line", "end_line"))


class _Calls(ast.NodeVisitor):
    def __init__(self):
        self.stack, self.found = [""], []

    def visit_FunctionDef(self, n):  # noqa: N802
        self.stack.append(n.name)
        self.generic_visit(n)
        self.stack.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Call(self, n):  # noqa: N802
        f = n.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.found.append((self.stack[-1], name, n.lineno))
        self.generic_visit(n)


def calls(files: DataFrame) -> DataFrame:
    """path, caller_symbol (the innermost named function, '' at the top), callee_symbol (rightmost name), line. Python by its parser, TypeScript and JavaScript by tokens; Vue files give their script block's."""

    def read(path: str, fam: str, text: str) -> list[tuple]:
        if fam == "ts":
            return [(path, *c) for c in ecma.Source(text).calls]
        v = _Calls()
        v.visit(ast.parse(text))
        return [(path, *c) for c in v.found]

    return _rows_of_files(files.where(family(F.col("path")).isin("py", "ts")), CALL_SCHEMA, read)


def call_sites_of(found: DataFrame, symbol: str, path: str | None = None) -> DataFrame:
    """path, caller_symbol, line of the calls of a symbol, in one file or in all."""
    hit = found.where(F.col("callee_symbol") == symbol)
    return (hit if path is None else hit.where(F.col("path") == path)).select("path", "caller_symbol", "line")


def skeletons(files: DataFrame, nodes: DataFrame, largest: int = 256 * 1024, mean_line: int = 1024, most: int = 1 << 20) -> DataFrame:
    """path, skeleton: a file's nodes in order, imports and interfaces verbatim, functions and classes without bodies. Very large or minified files have none."""
    lines = F.split("content", "\n", -1)
    ok = files.where((F.octet_length("content") <= largest) & (F.length("content") / F.size(lines) <= mean_line)).select("path", lines.alias("lines"))
    ends = F.col("type").isin("function", "arrow_function", "export_default", "method")
    text = F.when(ends, F.concat("signature", F.lit(";"))).when((F.col("type") == "class") & (F.size("methods") > 0), F.concat("signature", F.lit(" {\n"), F.array_join(F.transform("methods", lambda m: F.concat(F.lit("  "), m, F.lit(";"))), "\n"), F.lit("\n}"))).otherwise(F.col("signature"))
    x = nodes.withColumn("verbatim", F.col("type").isin("import", "export", "interface")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("end"), "name", "verbatim", text.alias("t")))).alias("nodes"))
    cut_out = lambda n: F.array_join(F.slice("lines", n["start_line"].cast("int"), F.greatest((-n["end"] - n["start_line"] + 1).cast("int"), F.lit(0))), "\n")
    shown = F.array_join(F.transform("nodes", lambda n: F.when(n["verbatim"], cut_out(n)).otherwise(n["t"])), "\n")
    return x.join(ok, "path").select("path", F.substring(shown, 1, most).alias("skeleton"))


def xml_skeletons(nodes: DataFrame) -> DataFrame:
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    line = F.format_string('  <%s name="%s" start="%d" end="%d">%s</%s>', "type", esc(F.col("name")), "start_line", "end_line", esc(F.col("signature")), "type")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name", line.alias("t")))), lambda s: s["t"]), "\n")
    return nodes.groupBy("path").agg(body.alias("b")).select("path", F.concat(F.lit('<file path="'), esc(F.col("path")), F.lit('">\n'), F.col("b"), F.lit("\n</file>")).alias("xml"))


#: From texts to a matrix with a row for each; load() makes one in a worker.
Model = Callable[[list[str]], np.ndarray]


def embeddings(files: DataFrame, load: Callable[[], Model], longest: int = 4096, at_once: int = 50) -> DataFrame:
    """path, vector: each text's first characters through a model, of unit length. The model is made once a task, and takes some texts at a
    time; if it fails on them it gets them again by halves, and a text on which it fails alone has a null vector."""

    def vectors(model: Model, texts: list[str]) -> list[np.ndarray | None]:
        try:
            made = np.asarray(model(texts), np.float64)
            if made.ndim != 2 or len(made) != len(texts):
                raise ValueError("a model gives a row for each text")
            return list(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12))
        except Exception:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return vectors(model, texts[:half]) + vectors(model, texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            out = []
            texts = [(t or "")[:longest] for t in pdf["content"]]
            for k in range(0, len(texts), at_once):
                out += vectors(model, texts[k : k + at_once])
            yield pd.DataFrame({"path": pdf["path"], "vector": [None if v is None else v.astype(np.float32) for v in out]})

    return files.select("path", "content").mapInPandas(run, "path string, vector array<float>")


def hashing_model(dim: int = 384) -> Callable[[], Model]:
    """A stand-in for a model: signed hashed word counts."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z0-9_]+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dim] += 1.0 if zlib.crc32(word.encode(), 1) & 1 else -1.0
        return out

    return lambda: encode


def hashed_embeddings(files: DataFrame, dim: int = 384, longest: int = 4096) -> DataFrame:
    """path, vector through the stand-in, of texts that have words."""
    return embeddings(files, hashing_model(dim), longest).where(F.exists("vector", lambda x: x != 0))


def notebook_code(files: DataFrame) -> DataFrame:
    """path, content: the code cells of .ipynb files; a cell's source is a string or a list of strings."""
    cells = F.from_json("content", "cells array<struct<cell_type:string,source:string>>")["cells"]
    code = F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"]))
    return files.where(F.col("path").endswith(".ipynb")).select("path", F.array_join(code, "\n").alias("content"))
