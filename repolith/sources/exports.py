"""Graph and report sinks. Rows become lines in Spark; only the small frames around them are written by the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.lineage import cut, numbered


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, value: the lines of a GraphML document, to be written in order of ord."""
    frame = nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, value string")
    n = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), escaped(F.col("path")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"/>')).alias("value"))
    return frame.union(n).union(e)


def dot(edges: DataFrame, name: str = "imports") -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    frame = edges.sparkSession.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "ord int, value string")
    return frame.union(edges.select(F.lit(1), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";"))))


#: Importers from which a file counts as a hub in pictures.
HUB = 5


def svg(nodes: DataFrame, edges: DataFrame, spacing: float = 24.0) -> DataFrame:
    """ord, at, value: the lines of an SVG picture, to be written in order of ord and at: files around a circle by path, importers'
    lines between them. Places come from distributed row numbers, and the circle grows with the number of files."""
    importers = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers"))
    placed = numbered(nodes.select("path").distinct(), [F.col("path")], "at")
    n = nodes.select("path").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    radius = F.greatest(F.lit(200.0), F.col("n") * spacing / (2 * math.pi))
    place = lambda f: F.floor(radius + 120 + radius * f(2 * math.pi * (F.col("at") - 1) / F.col("n")) + 0.5)
    x = cut(placed.crossJoin(F.broadcast(n)).select("path", "at", place(F.cos).alias("x"), place(F.sin).alias("y")), "places").join(importers, "path", "left").na.fill(0, ["importers"])
    a, b = (x.select(F.col("path").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"), F.col("at").alias(f"at_{end}")) for end in ("src", "dst"))
    lines = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    side = F.floor(2 * radius + 240)
    zero = F.lit(0).cast("long")
    head = n.select(F.lit(0).alias("ord"), zero.alias("at"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', side, side).alias("value"))
    line = lines.select(F.lit(1).alias("ord"), F.col("at_src").alias("at"), F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#889"/>', "x_src", "y_src", "x_dst", "y_dst").alias("value"))
    kind = F.when(F.col("importers") >= HUB, F.lit("hub")).otherwise(F.lit("file"))
    dots = x.select(F.lit(2).alias("ord"), "at", F.format_string('<circle class="%s" cx="%d" cy="%d" r="6"><title>%s: %d importers</title></circle>', kind, "x", "y", escaped(F.col("path")), "importers").alias("value"))
    names = x.select(F.lit(3).alias("ord"), "at", F.format_string('<text x="%d" y="%d" font-size="9">%s</text>', "x", F.col("y") + 16, escaped(F.element_at(F.split("path", "/"), -1))).alias("value"))
    tail = n.select(F.lit(4).alias("ord"), zero.alias("at"), F.lit("</svg>").alias("value"))
    return head.unionByName(line).unionByName(dots).unionByName(names).unionByName(tail)


def html(nodes: DataFrame, edges: DataFrame, title: str = "Import graph") -> DataFrame:
    """ord, at, value: a page with the picture; hubs are marked, and a file's importers show over its dot."""
    style = "body { font-family: sans-serif } circle.file { fill: #46a } circle.hub { fill: #d80 }"
    spark, title = nodes.sparkSession, title.replace("&", "&amp;").replace("<", "&lt;")
    frame = [(-1, 0, f'<!DOCTYPE html><html><head><meta charset="UTF-8"><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1>'), (5, 0, "</body></html>")]
    return svg(nodes, edges).unionByName(spark.createDataFrame(frame, "ord int, at long, value string"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of lines in order of ord and at. A task sorts them, on disk where they are many; nothing is collected."""
    lines.repartition(1).sortWithinPartitions("ord", "at", "value").select("value").write.text(path)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, content: a linked note for each file."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda p: F.concat(F.lit("- [["), slug(p), F.lit("]]"))), "\n")
    x = nodes.join(out, "path", "left").join(into, "path", "left")
    return x.select(slug(F.col("path")).alias("name"), F.concat(F.lit("# "), F.col("path"), F.lit("\n\n## Imports\n"), listed(F.col("imports")), F.lit("\n\n## Imported by\n"), listed(F.col("importers")), F.lit("\n")).alias("content"))


def wiki_pages(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """slug, content, hash: a page for each community (path, community, name)."""
    files = groups.groupBy("community", "name").agg(F.array_sort(F.collect_list("path")).alias("files"))
    a, b = groups.select(F.col("path").alias("src"), F.col("community")), groups.select(F.col("path").alias("dst"), F.col("community").alias("other"), F.col("name").alias("other_name"))
    uses = edges.join(a, "src").join(b, "dst").where("community != other").groupBy("community", "other_name").agg(F.count(F.lit(1)).alias("n"))
    uses = uses.groupBy("community").agg(F.array_sort(F.collect_list(F.concat(F.col("other_name"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))).alias("uses"))
    bullets = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda p: F.concat(F.lit("- "), p)), "\n")
    x = files.join(uses, "community", "left")
    content = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n## Files\n"), bullets(F.col("files")), F.lit("\n\n## Uses\n"), bullets(F.col("uses")), F.lit("\n"))
    return x.select(slug(F.concat_ws("-", "name", "community")).alias("slug"), content.alias("content")).withColumn("hash", F.substring(F.sha2("content", 256), 1, 16))


def changed_pages(pages: DataFrame, written: DataFrame) -> DataFrame:
    """Pages whose content isn't what was written before (slug, hash)."""
    return pages.join(written.select("slug", "hash"), ["slug", "hash"], "left_anti")


BEGIN, END = "# BEGIN generated owners", "# END generated owners"


def spliced_codeowners(old: str, rules: list[tuple[str, str]], width: int = 40) -> str:
    """A CODEOWNERS text with its generated block replaced, or put at the end; what stands around it stays."""
    block = "\n".join([BEGIN, *(f"{p.ljust(width)} {o}" for p, o in sorted(rules)), END])
    if BEGIN in old and END in old:
        head, _, rest = old.partition(BEGIN)
        return head + block + rest.partition(END)[2]
    return (old.rstrip("\n") + "\n\n" if old.strip() else "") + block + "\n"
