"""An index of source files that follows changes: a base and deltas over it, read as one.

root/base-N/TABLE holds all rows up to change N, in buckets by a hash of the
column that the table is looked up by. root/delta-N/TABLE holds the rows that
change N brought, and root/delta-N/keys the paths whose rows it replaces or takes
away. A reader takes the newest complete base and the complete deltas behind it:
of a path the rows of the last change that names it count. A change therefore
writes what it brings and nothing else; where it looks something up, it reads the
base's buckets of the paths it needs. compact() makes a new base.

A file's edges depend on which files there are. Where a change adds or removes
files, importers that might mean one of them (table places, looked up by the file
that is meant) get their edges anew too, so that the index is at all times what a
rebuild gives. A change that is applied again, as streams do after a failure, is
written anew if it wasn't complete, and left alone if it was.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import extract
from repolith.operators.lineage import cut, drop_cut
from repolith.sources.store import _fs

#: Of each table the columns, and the one that its base is bucketed by. All are replaced by path.
TABLES = {
    "files": ("path string, content string", "path"),
    "imports": ("path string, family string, specifier string, is_relative boolean", "path"),
    "places": ("path string, specifier string, pos int, candidate string", "candidate"),
    "symbols": ("path string, name string, type string, signature string, start_line long, end_line long", "path"),
    "calls": (extract.CALL_SCHEMA, "path"),
    "edges": ("path string, specifier string, dst string", "path"),
    "vectors": ("path string, vector array<float>", "path"),
}
#: These belong to a file's own text; edges go by keys of their own.
OWN = tuple(t for t in TABLES if t != "edges")


def edges_of(imports: DataFrame, paths: DataFrame) -> DataFrame:
    return extract.resolve_imports(imports, paths).select(F.col("src").alias("path"), "specifier", "dst")


def own_tables(files: DataFrame) -> dict[str, DataFrame]:
    """What the texts of files give by themselves."""
    imports = extract.raw_imports(files).select("path", "family", "specifier", "is_relative")
    return {
        "files": files.select("path", "content"), "imports": imports, "places": extract.import_places(imports).select("path", "specifier", "pos", "candidate"),
        "symbols": extract.symbols(extract.definitions(files)).select("path", "name", "type", "signature", "start_line", "end_line"),
        "calls": extract.calls(files), "vectors": extract.hashed_embeddings(files),
    }


def rebuilt(files: DataFrame) -> dict[str, DataFrame]:
    """All tables from all files, as the index should hold them."""
    own = own_tables(files)
    return own | {"edges": edges_of(own["imports"], files.select("path"))}


@dataclass
class CodeIndex:
    spark: SparkSession
    root: str
    #: Buckets of a new base: some 100,000 files each at the size it should grow to.
    buckets: int = 64
    #: So many deltas are read over a base before apply() makes a new one.
    most_deltas: int = 16

    # --- what there is ------------------------------------------------------------

    def _complete(self, kind: str) -> list[int]:
        fs, at = _fs(self.spark, self.root)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        found = [int(m[1]) for m in (re.fullmatch(kind + r"-(\d+)", n) for n in names) if m]
        return sorted(n for n in found if fs.exists(_fs(self.spark, f"{self.root}/{kind}-{n}/_COMPLETE")[1]))

    def state(self) -> tuple[int | None, list[int]]:
        """The newest base and the deltas over it."""
        bases = self._complete("base")
        base = bases[-1] if bases else None
        return base, [n for n in self._complete("delta") if base is None or n > base]

    def last(self) -> int:
        base, deltas = self.state()
        return deltas[-1] if deltas else base or 0

    def _mark(self, folder: str) -> None:
        fs, at = _fs(self.spark, f"{self.root}/{folder}/_COMPLETE")
        fs.create(at, True).close()

    def _near(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets of some keys; no more rows than there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(column)).distinct().collect())

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    # --- reading --------------------------------------------------------------------

    def read(self, table: str, near: DataFrame | None = None) -> DataFrame:
        """A table as of the last change. near: only rows whose bucket column is among its values need be there."""
        schema, by = TABLES[table]
        base, deltas = self.state()
        group = "edges" if table == "edges" else "own"
        columns = [c.split()[0] for c in schema.split(", ")]
        parts = []
        if base is not None:
            rows = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.root}/base-{base}/{table}")
            if near is not None:
                rows = rows.where(F.col("bucket").isin(self._near(near, by)))
            parts.append(rows.select(*columns, F.lit(base).cast("long").alias("__seq")))
        parts += [self.spark.read.schema(schema).parquet(f"{self.root}/delta-{n}/{table}").withColumn("__seq", F.lit(n).cast("long")) for n in deltas]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, parts)
        if deltas:
            keys = reduce(DataFrame.unionByName, [self.spark.read.schema("path string, part string").parquet(f"{self.root}/delta-{n}/keys").withColumn("__last", F.lit(n).cast("long")) for n in deltas])
            newest = keys.where(F.col("part") == group).groupBy("path").agg(F.max("__last").alias("__last"))
            rows = rows.join(newest, "path", "left").where("__last IS NULL OR __last = __seq").drop("__last")
        rows = rows.select(*columns)
        return rows if near is None else rows.join(near.select(F.col(near.columns[0]).alias(by)).distinct(), by, "left_semi").select(*columns)

    # --- changing ---------------------------------------------------------------------

    def apply(self, changes: DataFrame, seq: int | None = None) -> None:
        """Takes in changes (path, kind, content): unlinked paths go, others hold the content. One row a path."""
        seq = self.last() + 1 if seq is None else seq
        if seq <= self.last():
            return
        last = cut(changes.select("path", "kind", "content"), "changes")
        gone = last.select("path")
        fresh = last.where("kind != 'unlink' AND content IS NOT NULL").select("path", "content")
        had = cut(self.read("files", near=gone).select("path"), "had")
        # Paths that come or go change what others' imports mean.
        moved = fresh.select("path").join(had, "path", "left_anti").unionByName(had.join(fresh.select("path"), "path", "left_anti"))
        moved = cut(moved, "moved")
        others = self.read("places", near=moved.toDF("candidate")).select("path").distinct().join(gone, "path", "left_anti")
        others = cut(others, "others")

        folder = f"{self.root}/delta-{seq}"
        own = own_tables(fresh)
        imports = cut(own["imports"], "imports")
        for name, df in (own | {"imports": imports}).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        todo = imports.unionByName(self.read("imports", near=others))
        places = cut(extract.import_places(todo), "places")
        there = self.read("files", near=places.select(F.col("candidate").alias("path")).distinct()).select("path").join(gone, "path", "left_anti").unionByName(fresh.select("path"))
        edges_of(todo, there).write.mode("overwrite").parquet(f"{folder}/edges")
        keys = gone.withColumn("part", F.lit("own")).unionByName(gone.unionByName(others).withColumn("part", F.lit("edges")))
        keys.write.mode("overwrite").parquet(f"{folder}/keys")
        self._mark(f"delta-{seq}")
        for df in (last, had, moved, others, imports, places):
            drop_cut(df)
        if len(self.state()[1]) >= self.most_deltas:
            self.compact()

    def compact(self) -> None:
        """A new base of all there is; older bases and deltas go, but for the base before, which readers may still hold."""
        base, deltas = self.state()
        if not deltas:
            return
        new = deltas[-1]
        for table, (_, by) in TABLES.items():
            rows = self.read(table).withColumn("bucket", self._bucket(by))
            rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base-{new}/{table}")
        self._mark(f"base-{new}")
        for kind, n in [("base", n) for n in self._complete("base") if n < (base or 0)] + [("delta", n) for n in self._complete("delta") if n <= (base or 0)]:
            fs, at = _fs(self.spark, f"{self.root}/{kind}-{n}")
            fs.delete(at, True)


def present(spark: SparkSession, root: str) -> bool:
    return CodeIndex(spark, root).last() > 0
