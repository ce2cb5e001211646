"""Quotation linking: conversations without quotes, in the order of replies.

A line's quote level is the number of > marks it begins with. Neighbouring lines
of one level are a passage; level 0 is a message's own text. Passages are
normalised (lower case, white space runs as one space, trimmed) and hashed. A
quoted passage is joined to the original: the first message of the conversation
whose own text, or a line, a paragraph or a run of neighbouring lines of it, has
that hash and that stands before the message with the quote. Blank lines don't
count in runs; only runs that begin like one of the conversation's quotes and are as long are made. A message replies to the original of its least
nested linked passage; of several, to the latest. Its root is the end of that
chain, found by pointer doubling, and its depth is that chain's length. A reply
has a later turn than its original, so that conversations are in reply order by
conv_id, root_turn, turn; reply_to_turn and depth give the tree.

Hot keys: what messages offer is reduced to the first turn of each passage
before it is joined, and no conversation is gathered in one place. Null
conversations or turns link with nothing; their root is their turn. A null text
counts as empty. Rows that repeat a conversation and turn get equal links.
Blank quoted passages link with nothing. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm.common import cut, drop_cut

MARKS = "^[ \\t]*(?:>[ \\t]*)+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def with_lines(messages: DataFrame) -> DataFrame:
    """lines: an array of (level, body)."""
    mark = lambda x: F.regexp_extract(x, MARKS, 0)
    line = lambda x: F.struct(F.regexp_count(mark(x), F.lit(">")).alias("level"), F.when(x.startswith(">") | x.startswith(" ") | x.startswith("\t"), F.regexp_replace(x, MARKS, "")).otherwise(x).alias("body"))
    return messages.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line))


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as (level, text): cut between the lines where a run begins and where it ends, so that each line is looked at once."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    level = lambda i: F.get(lines, i)["level"]
    edge = lambda step: F.filter(at, lambda i: (level(i) > 0) & ~F.coalesce(level(i) == level(i + step), F.lit(False)))
    body = lambda first, last: F.array_join(F.transform(F.slice(lines, first + 1, last - first + 1), lambda x: x["body"]), "\n")
    return F.zip_with(edge(-1), edge(1), lambda first, last: F.struct(level(first).alias("level"), body(first, last).alias("text")))


def own_text(lines: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")


def full_lines(text: Column) -> Column:
    """The lines of a text that aren't blank, normalised."""
    return F.filter(F.transform(F.split(text, "\n", -1), normal), lambda x: x != "")


def line_runs(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """conv_id, turn, piece: the runs of neighbouring lines that begin like a quote of the conversation and are as long. Lines are
    looked up by their hashes, so that only those runs are made."""
    own = messages.select("conv_id", "turn", full_lines(F.col("own_text")).alias("own"))
    lines = own.select("conv_id", "turn", F.posexplode("own").alias("i", "line")).select("conv_id", "turn", "i", F.sha2("line", 256).alias("first"))
    wanted = quoting.where("n_lines > 1").select("conv_id", "first", "n_lines").distinct()
    starts = lines.join(wanted, ["conv_id", "first"]).groupBy("conv_id", "turn").agg(F.collect_set(F.struct("i", "n_lines")).alias("starts"))
    x = own.join(starts, ["conv_id", "turn"])
    return x.select("conv_id", "turn", F.explode(F.transform("starts", lambda s: F.array_join(F.slice("own", s["i"] + 1, s["n_lines"]), " "))).alias("piece"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, n_quoted, reply_to_turn, root_turn, depth of every message."""
    m = with_lines(messages.select("conv_id", "turn", "role", "text"))
    quoting = m.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", F.explode(passages(F.col("lines"))).alias("q"))
    quoting = quoting.select("conv_id", "turn", F.col("q.level").alias("level"), normal(F.col("q.text")).alias("passage"), full_lines(F.col("q.text")).alias("full")).where("passage != ''")
    quoting = quoting.select("conv_id", "turn", "level", F.sha2("passage", 256).alias("hash"), F.size("full").alias("n_lines"), F.sha2(F.get("full", F.lit(0)), 256).alias("first"))
    quoting = cut(quoting.distinct(), "quotes")

    m = m.withColumn("own_text", own_text(F.col("lines")))
    reply = None
    if not quoting.isEmpty():
        offered = F.array_union(F.array(F.col("own_text")), F.array_union(F.split("own_text", "\n"), F.split("own_text", "\n[ \\t]*\n")))
        original = m.select("conv_id", "turn", F.explode(offered).alias("piece")).select("conv_id", "turn", normal(F.col("piece")).alias("piece")).where("piece != ''").unionByName(line_runs(m, quoting))
        original = original.groupBy("conv_id", F.sha2("piece", 256).alias("hash")).agg(F.min("turn").alias("first_turn"))
        found = quoting.drop("n_lines", "first").join(original, ["conv_id", "hash"]).where("first_turn < turn")
        reply = cut(found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "first_turn")).alias("x")).select("conv_id", "turn", F.col("x.first_turn").alias("parent")), "replies")
    out = m.select("conv_id", "turn", "role", "own_text", F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    if reply is None or reply.isEmpty():
        return out.withColumns({"reply_to_turn": F.lit(None).cast("long"), "root_turn": F.col("turn"), "depth": F.lit(0).cast("long")})
    top = roots(reply)
    ends = reply.join(top, ["conv_id", "turn"]).toDF("__conv", "__turn", "reply_to_turn", "__root", "__depth")
    joined = out.join(ends, (out["conv_id"] == ends["__conv"]) & (out["turn"] == ends["__turn"]), "left")
    return joined.select(*out.columns, "reply_to_turn", F.coalesce("__root", "turn").alias("root_turn"), F.coalesce("__depth", F.lit(0)).alias("depth"))


def roots(reply: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth: each chain's end and its length. A round doubles how far each message looks."""
    at = reply.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        further = at.toDF("conv_id", "root", "next", "more")
        joined = at.join(further, ["conv_id", "root"], "left")
        new = cut(joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_cut(at)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        at = new.drop("moved")
        at._repolith_path = new._repolith_path


def op5_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked.select("conv_id", "turn", "role", F.sha2("own_text", 256).alias("own_sha256"), "n_quoted", "reply_to_turn", "root_turn", "depth")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
x AS (SELECT id, conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM m),
y AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
             regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM x),
z AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM y),
q AS (SELECT DISTINCT id, conv_id, turn, level, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '\s+', ' ', 'g')) AS passage
      FROM z WHERE level > 0 GROUP BY id, conv_id, turn, level, run),
own AS (SELECT id, conv_id, turn, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '') AS own_text, count(*) FILTER (level > 0) AS n_quoted
        FROM y GROUP BY id, conv_id, turn),
full_lines AS (SELECT id, conv_id, turn, list_filter(list_transform(string_split(own_text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM own),
sizes AS (SELECT DISTINCT conv_id, count(*) AS n FROM z WHERE level > 0 AND trim(regexp_replace(body, '\s+', ' ', 'g')) <> '' GROUP BY id, conv_id, level, run HAVING count(*) > 1),
runs AS (SELECT conv_id, turn, array_to_string(l[i:i + n - 1], ' ') AS p FROM (SELECT f.conv_id, turn, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM full_lines f JOIN sizes ON f.conv_id = sizes.conv_id WHERE len(l) >= n)),
pieces AS (SELECT conv_id, turn, own_text AS p FROM own UNION ALL SELECT conv_id, turn, unnest(string_split(own_text, chr(10))) FROM own
           UNION ALL SELECT conv_id, turn, unnest(string_split_regex(own_text, '\n[ \t]*\n')) FROM own UNION ALL SELECT conv_id, turn, p FROM runs),
orig AS (SELECT conv_id, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS passage, min(turn) AS first_turn FROM pieces GROUP BY 1, 2),
reply AS (SELECT q.conv_id, q.turn, first_turn AS parent FROM q JOIN orig ON q.conv_id = orig.conv_id AND q.passage = orig.passage
          WHERE q.passage <> '' AND first_turn < q.turn
          QUALIFY row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY level, first_turn DESC) = 1),
up AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM reply UNION SELECT up.conv_id, up.turn, reply.parent, up.depth + 1 FROM up JOIN reply ON up.conv_id = reply.conv_id AND up.root = reply.turn),
top AS (SELECT conv_id, turn, min(root) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, sha256(own.own_text) AS own_sha256, own.n_quoted, reply.parent AS reply_to_turn, coalesce(top.root, m.turn) AS root_turn, coalesce(top.depth, 0) AS depth
FROM m JOIN own USING (id) LEFT JOIN reply ON m.conv_id = reply.conv_id AND m.turn = reply.turn LEFT JOIN top ON m.conv_id = top.conv_id AND m.turn = top.turn
"""
