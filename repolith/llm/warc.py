"""WARC: archives written and read back, transactions assembled.

Writing: each page becomes a request, a response (or revisit) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. Of pages
with equal payloads of at least a given size, the one with the largest page_id
is a response, the others are revisits that refer to it. A record is one text of
Spark's text writer, with the end of a WARC record as line separator, so that
the parts are gzipped WARC files.

Reading: each part is unpacked as a stream and parsed by its Content-Length
fields, one record in memory at a time. The records of a capture are brought
together by the identifier they name; the result is one nested row per capture.

A null html is an empty payload, a null url leaves its field out, a null page_id
is left out of the metadata and comes back null. Pages of one id and payload but
other urls are captures of their own. Control characters in a url are
percent-encoded. Rows repeated with page_id, url and html equal come back as
often as they were written. An empty table gives an archive without records and
no captures.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from repolith.llm.common import cut, drop_cut, remove, scratch

END = "\r\n"
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("")) for c in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def record(kind: str | Column, rid: Column, uri: Column, content_type: str, block: Column, *fields: tuple[str, Column]) -> Column:
    """A record without the two line ends that close it; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *fields, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + END), *(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(END)), F.lit("")) for k, v in lines), F.lit(END), block)


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = 256 << 20) -> None:
    """pages: page_id, url, html. Files hold some file_bytes of payload at most (a larger page has a file of its own), as readers take a file at a time:
    pages of about one size are written together, in classes of a factor of 16, and the largest of a class bounds how many go to a file."""
    mine = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    mine = mine.withColumn("n", F.octet_length("html").cast("long")).withColumn("own", record_id("capture", F.col("page_id"), F.col("digest"), F.col("url")))
    mine = mine.withColumn("class", F.when(F.col("n") < 1 << 16, 0).otherwise(F.floor(F.log2("n") / 4).cast("int")))
    narrow = mine.select("page_id", "digest", "n", "own").where(F.col("n") >= least)
    known = F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("first"), F.col("own").alias("first_own")))
    first = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.max(known).alias("x")).where("k > 1 and x is not null").select("digest", "x.*")
    # Decisions move without the payloads, and reach them by page and digest: equal payloads don't meet in one task.
    again = narrow.join(first, "digest").where("page_id is null or page_id != first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first_own").distinct()
    rows = mine.join(again, mine["page_id"].eqNullSafe(again["p"]) & (mine["digest"] == again["d"]), "left")

    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1f\\x7f]", "%00")
    revisit, own = F.col("first_own").isNotNull(), F.col("own")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    response = record(
        F.when(revisit, "revisit").otherwise("response"), own, uri, "application/http;msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.col("first_own")),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
    )
    concurrent = ("WARC-Concurrent-To", own)
    request = record("request", record_id("request", own), uri, "application/http;msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")), concurrent)
    notes = F.concat(F.lit("page_id: "), F.col("page_id").cast("string"))
    metadata = record("metadata", record_id("metadata", own), uri, "application/warc-fields", F.coalesce(notes, F.lit("")), concurrent)
    sizes = mine.groupBy("class").agg(F.max("n").alias("most")).orderBy("class").collect()  # a row for each factor of 16
    for r in sizes or [Row(**{"class": 0, "most": 0})]:
        some = rows.where(F.col("class") == r["class"]).select(F.explode(F.array(request, response, metadata)).alias("value"))
        per_file = 3 * max(1, file_bytes // max(r.most, 1 << 12))
        some.write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            # The one field that may be repeated keeps all its values.
            head[name] = f"{head[name]} {value}" if name == "warc-concurrent-to" and name in head else value
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


SCHEMA = "kind string, record_id string, concurrent_to string, refers_to string, uri string, declared string, payload_bytes long, payload_sha1 string, notes string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of an archive's files (gzipped or not). The payload is an HTTP message's body; a revisit has the size its HTTP head states."""

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, http = head.get("warc-type", ""), head.get("content-type", "").startswith("application/http")
        top, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size = re.search(rb"(?im)^content-length:\s*(\d+)", top)
        n = int(size[1]) if kind == "revisit" and size else len(body)
        notes = block.decode("utf-8", "replace") if kind == "metadata" else None
        return kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), n, hashlib.sha1(body).hexdigest(), notes, body if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [*[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                raw = pa.BufferReader(data)
                stream = gzip.GzipFile(fileobj=raw) if data.size and bytes(data[:2]) == b"\x1f\x8b" else io.BufferedReader(raw)
                rows, held = [], 0
                for head, block in parse(stream):
                    rows.append(row(head, block))
                    held += len(block) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, copies, capture, requests, metadata.

    A record belongs to the captures that it names in Concurrent-To, and to those
    that name it: archives state the tie on either side. requests and metadata
    are arrays by record_id, empty where a capture has none; records that neither
    name a capture nor are named by one are left aside. Equal records of a capture
    count once.
    """
    kept = records.where(F.col("kind").isin("response", "revisit", "request", "metadata"))
    own = F.col("kind").isin("response", "revisit")
    named = F.filter(F.split(F.coalesce("concurrent_to", F.lit("")), " +"), lambda x: x != "")
    keys = F.when(own, F.array("record_id")).otherwise(named)
    tied = kept.withColumn("capture_id", F.explode(keys)).where("capture_id IS NOT NULL")
    # Captures that name their request or metadata: few archives do, and the names come without payloads.
    back = kept.where(own).select(F.col("record_id").alias("capture_id"), F.explode(named).alias("named")).distinct()
    if not back.isEmpty():
        other = kept.where(~own)
        tied = tied.unionByName(other.join(back, other["record_id"] == back["named"]).select(*other.columns, "capture_id"))
    part = lambda kind, *cols: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct(*cols))))
    grouped = tied.groupBy(F.col("capture_id").alias("record_id_")).agg(
        F.count(F.when(own, 1)).alias("copies"),
        F.max(F.when(own, F.struct("kind", "uri", "declared", "payload_bytes", "payload_sha1", "refers_to", "payload"))).alias("capture"),
        part("request", "record_id", "uri").alias("requests"),
        part("metadata", "record_id", "notes").alias("metadata"),
    )
    return grouped.withColumnRenamed("record_id_", "record_id").where("capture is not null")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), at)
    # The archives are parsed once: what is read of them goes to a table, which captures() asks twice.
    records = cut(read(spark, at, payloads=False).drop("payload"), "records")
    remove(spark, at)
    whole = captures(records.withColumn("payload", F.lit(None).cast("binary")))
    page = F.nullif(F.regexp_extract(F.get("metadata", F.lit(0))["notes"], r"(?m)^page_id: (-?\d+)", 1), F.lit("")).cast("long")
    is_revisit = F.col("capture.kind") == "revisit"
    rows = cut(
        whole.select(
            "record_id", page.alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
            F.when(is_revisit, F.substring_index("capture.declared", ":", -1)).otherwise(F.col("capture.payload_sha1")).alias("payload_digest"),
            F.col("capture.kind").alias("record_type"), "capture.refers_to", "copies",
        ),
        "captures",
    )
    drop_cut(records)
    # A revisit refers to its response by the record's id. A response may have many revisits: the join can be split at run time.
    of = rows.join(rows.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response"))
    out = rows.join(of, "refers_to", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("response").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""
