r"""Quotation linking: who answers whom, from quoted passages.

A line that begins with one or more '>' is quoted, as deep as there are marks. Neighbouring lines of
one depth are a passage; passages are normalised (lower case, letters and digits only) and hashed, as
a whole and line by line, and so is the unquoted text of each message. A join by (conversation,
hash) finds the first earlier message with a passage; where a whole passage is found, its single lines don't count. A message's
parent is the latest message that its outermost quotes come from; messages without one begin threads. Roots and depths are found by
doubling the parent links. Quoted lines, and a line that only introduces them ('... wrote:'), are cut.

Only DataFrame functions are used. Everything stays one row a message: no conversation is gathered
into one row or task, however long it is.

Defined results: a null text stays null and quotes nothing; an empty one stays empty; passages
without letters and digits are never linked; rows with a null conversation or turn are not linked;
repeated rows of one (conv_id, turn) share the links of them all; an empty table gives no rows. Only conv_id,
turn, role and text are read and returned; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import stage, table

MARKS = r"^((?:[ \t]{0,3}>)+)"
HAS_QUOTE = r"(?m)^[ \t]{0,3}>"
# Verbs that introduce a quotation.
INTRO = r"(?i)^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\b[^\n]{0,40}:\s*$"


def lines_of(text: Column) -> Column:
    """Lines as structs: depth of quotation, and the line without its marks."""
    marks = lambda line: F.regexp_extract(line, MARKS, 1)
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.regexp_count(marks(x), F.lit(">")).alias("depth"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("line")))


def normal(text: Column) -> Column:
    """Letters and digits in lower case, one space between words; null if there are none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def passages(lines: Column) -> Column:
    """Runs of lines of one depth: depth and lines."""
    indexes = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(indexes, lambda i: (i == 0) | (F.get(lines, i)["depth"] != F.get(lines, i - 1)["depth"]))
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(lines, s)["depth"].alias("depth"),
            F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s), lambda x: x["line"]).alias("lines"),
        ),
    )


def hashes(lines: Column) -> Column:
    """Distinct hashes of a passage: of the whole and of each line, and whether it is the whole's."""
    units = F.concat(F.array(F.struct(normal(F.array_join(lines, " ")).alias("unit"), F.lit(True).alias("whole"))), F.transform(lines, lambda x: F.struct(normal(x).alias("unit"), F.lit(False).alias("whole"))))
    return F.array_distinct(F.transform(F.filter(units, lambda x: x["unit"].isNotNull()), lambda x: F.struct(F.md5(x["unit"]).alias("hash"), x["whole"].alias("whole"))))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, quoted (passages of depth 1 and more) and own (unquoted lines)."""
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", "turn", "role", "text", F.when(text.rlike(HAS_QUOTE), lines_of(text)).alias("_lines"))
    rows = rows.withColumn("_runs", passages(F.col("_lines"))).withColumn("quoted", F.filter("_runs", lambda r: r["depth"] > 0))

    def unquoted(run: Column, k: Column) -> Column:
        last = F.element_at(run["lines"], -1)
        intro = (k < F.size("_runs") - 1) & last.rlike(INTRO)
        return F.when(run["depth"] > 0, F.array().cast("array<string>")).when(intro, F.slice(run["lines"], 1, F.size(run["lines"]) - 1)).otherwise(run["lines"])

    own = F.when(F.col("_lines").isNull(), F.split(text, "\n")).otherwise(F.flatten(F.transform("_runs", unquoted)))
    return rows.select("conv_id", "turn", "role", "text", F.coalesce("quoted", F.array().cast("array<struct<depth:int,lines:array<string>>>")).alias("quoted"), own.alias("own"))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn and n_linked (passages whose message is found)."""
    asked = parsed.where(F.size("quoted") > 0).select("conv_id", "turn", F.posexplode("quoted").alias("passage", "q"))
    asked = asked.select("conv_id", "turn", "passage", F.col("q.depth").alias("depth"), F.explode(hashes(F.col("q.lines"))).alias("h")).select("conv_id", "turn", "passage", "depth", "h.*")
    talks = asked.select("conv_id").distinct()
    held = parsed.join(talks, "conv_id", "left_semi").select("conv_id", "turn", F.explode(hashes(F.col("own"))).alias("h"))
    first = held.groupBy("conv_id", F.col("h.hash").alias("hash")).agg(F.min("turn").alias("origin"))
    found = asked.join(first, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "passage", "depth")
    found = found.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("origin"))), F.max("origin")).alias("origin"))
    depth = asked.groupBy("conv_id", "turn").agg(F.min("depth").alias("outer"))
    parents = found.join(depth, ["conv_id", "turn"]).groupBy("conv_id", "turn")
    return parents.agg(F.max(F.when(F.col("depth") == F.col("outer"), F.col("origin"))).alias("parent_turn"), F.count_distinct("passage").alias("n_linked"))


def threads(linked: DataFrame) -> DataFrame:
    """linked with thread_turn (the root's turn) and depth (links up to it)."""
    rows = stage(linked.withColumns({"thread_turn": F.col("parent_turn"), "depth": F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0)}), "thread-0")
    for number in range(1, 40):
        up = rows.where("thread_turn IS NOT NULL").select("conv_id", F.col("turn").alias("_turn"), F.col("thread_turn").alias("_root"), F.col("depth").alias("_depth"))
        if rows.where("thread_turn IS NOT NULL").isEmpty():
            break
        met = rows.withColumnRenamed("conv_id", "_conv").join(up, (F.col("_conv") == F.col("conv_id")) & (F.col("thread_turn") == F.col("_turn")), "left")
        met = met.select(F.col("_conv").alias("conv_id"), "turn", "parent_turn", "n_linked", F.coalesce("_root", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved"))
        met = stage(met, f"thread-{number}")
        rows = met.drop("moved")
        if met.where("moved").isEmpty():
            break
    return rows


def link(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, n_quotes, n_linked, parent_turn (-1: none), thread_turn, depth
    and the text without quotes. Sorted by (conv_id, thread_turn, depth, turn) they are the conversations in reply order."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    found = threads(links(parsed)).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn", "n_linked", "thread_turn", "depth")
    clean = F.when(F.size("quoted") == 0, F.col("text")).otherwise(F.trim(F.array_join("own", "\n"), F.lit(" \n\t\r")))
    out = parsed.join(found, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("parent_turn", F.lit(-1)).alias("parent_turn"),
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        clean.alias("text"),
    )


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of conversations, linked and without quotes."""
    return link(table(spark, sf_dir, "conversations"))


SQL_op4_quote_links = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, text, regexp_matches(coalesce(text, ''), '(?m)^[ \t]{0,3}>') AS q FROM conversations
), l AS (
  SELECT r, conv_id, turn, q, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM m
), d AS (
  SELECT *, CASE WHEN q THEN len(regexp_extract_all(regexp_extract(line, '^((?:[ \t]{0,3}>)+)', 1), '>')) ELSE 0 END AS depth,
         CASE WHEN q THEN regexp_replace(line, '^((?:[ \t]{0,3}>)+)[ \t]?', '') ELSE line END AS body FROM l
), c AS (
  SELECT *, coalesce(depth <> lag(depth) OVER (PARTITION BY r ORDER BY i), true)::INT AS new FROM d
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM c
), e AS (
  SELECT *, max(run) OVER (PARTITION BY r) AS runs, max(i) OVER (PARTITION BY r, run) AS last_i FROM g
), own AS (
  SELECT * FROM e WHERE depth = 0 AND NOT (q AND run < runs AND i = last_i AND regexp_matches(body, '(?i)^.*\b(wrote|writes|said|schrieb|a écrit|escribió)\b[^\n]{0,40}:\s*$'))
), units AS (
  SELECT r, conv_id, turn, depth, run, true AS whole, string_agg(body, ' ' ORDER BY i) AS u FROM e WHERE depth > 0 GROUP BY ALL
  UNION SELECT r, conv_id, turn, depth, run, false, body FROM e WHERE depth > 0
), asked AS (
  SELECT r, conv_id, turn, depth, run, whole, nullif(trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS u FROM units
), held AS (
  SELECT conv_id, turn, string_agg(body, ' ' ORDER BY i) AS u FROM own GROUP BY r, conv_id, turn
  UNION SELECT conv_id, turn, body FROM own
), first AS (
  SELECT conv_id, nullif(trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS u, min(turn) AS origin FROM held GROUP BY 1, 2
), found AS (
  SELECT a.conv_id, a.turn, a.depth, a.run, coalesce(max(CASE WHEN a.whole THEN f.origin END), max(f.origin)) AS origin
  FROM asked a JOIN first f ON f.conv_id = a.conv_id AND f.u = a.u AND f.origin < a.turn GROUP BY 1, 2, 3, 4
), outermost AS (
  SELECT conv_id, turn, min(depth) AS outermost FROM asked GROUP BY 1, 2
), linked AS (
  SELECT f.conv_id, f.turn, max(CASE WHEN f.depth = o.outermost THEN origin END) AS parent_turn, count(DISTINCT run) AS n_linked
  FROM found f JOIN outermost o USING (conv_id, turn) GROUP BY 1, 2
), up AS (
  SELECT conv_id, turn, parent_turn AS top, 1 AS depth FROM linked WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, k.parent_turn, up.depth + 1 FROM up JOIN linked k ON k.conv_id = up.conv_id AND k.turn = up.top WHERE k.parent_turn IS NOT NULL
), root AS (
  SELECT conv_id, turn, min(top) AS thread_turn, max(depth) AS depth FROM up GROUP BY 1, 2
), texts AS (
  SELECT r, string_agg(body, chr(10) ORDER BY i) AS own FROM own GROUP BY r
), quotes AS (
  SELECT r, count(DISTINCT run) AS n FROM e WHERE depth > 0 GROUP BY r
)
SELECT m.conv_id, m.turn, m.role, coalesce(quotes.n, 0)::BIGINT AS n_quotes, coalesce(linked.n_linked, 0)::BIGINT AS n_linked,
       coalesce(linked.parent_turn, -1) AS parent_turn, coalesce(root.thread_turn, m.turn) AS thread_turn, coalesce(root.depth, 0)::BIGINT AS depth,
       CASE WHEN quotes.n IS NULL THEN m.text ELSE trim(coalesce(texts.own, ''), ' ' || chr(10) || chr(9) || chr(13)) END AS text
FROM m LEFT JOIN quotes USING (r) LEFT JOIN texts USING (r)
LEFT JOIN linked ON linked.conv_id = m.conv_id AND linked.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
