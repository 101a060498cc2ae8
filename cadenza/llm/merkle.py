"""A manifest of a table: Merkle trees of three-way nodes over its rows, one for each group and one over the groups.

A leaf is the digest of a row's fields, each preceded by its length, so that no two rows give the same bytes. Within a group
leaves stand in order; every three consecutive nodes (the last run may have fewer) become their digest until one node, the
subroot, is left. The subroots, in the order of their groups, become the root in the same way.

Levels are climbed SPAN at a time in windows over blocks of 3 ** SPAN places of a group, so that a group of any size is
spread over tasks and only one row in 729 goes on to the next window. On each level the first row of a node holds its digest; lag and
lead by the node's width, masked by its slot and the length of its run, give its siblings, and first children hash their parents. On
the way down, the blocks' own paths are joined to their rows by place, and a row keeps the last siblings seen on each level.
Texts are read once and never shuffled: only digests are.

Defined results: a null field counts as "-"; rows of equal place in the order stand by their leaves, and equal rows have
equal leaves, each with a place of its own; a null group is one group, before all others; an empty table gives no rows. Fields that
are not named are not read, so that other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm._common import discard, id_crc, stage, table
from cadenza.llm._order import numbered

#: Children of a node.
FAN = 3
#: Levels that one window climbs.
SPAN = 6
BLOCK = FAN**SPAN
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields: "-" for a null one, else its bytes in UTF-8, their number and ":" before them."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _levels(rows: DataFrame) -> DataFrame:
    """rows (grp, pos, n, node, ...) with `top`, the digest of their block's node (in its first row), and `own`, their path up to it."""
    block = Window.partitionBy("grp", F.expr(f"pos div {BLOCK}"))
    line = block.orderBy("pos")
    out = rows.withColumn("top", F.col("node"))
    for level in range(SPAN):
        width = FAN**level
        slot, run = F.expr(f"pos div {width} % {FAN}"), F.expr(f"least({FAN}, (n - 1) div {width} + 1 - pos div {width * FAN} * {FAN})")
        back, on = ({k: f(F.col("top"), k * width).over(line) for k in (1, 2)} for f in (F.lag, F.lead))
        before = F.concat(F.when(slot == 2, back[2]).otherwise(""), F.when(slot >= 1, back[1]).otherwise(""))
        after = F.concat(F.when(run > slot + 1, on[1]).otherwise(""), F.when((slot == 0) & (run == 3), on[2]).otherwise(""))
        at = (F.col("pos") % width == 0) & (F.col("n") > width)
        out = out.withColumn(f"step{level}", F.when(at, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(F.col("n") <= width, F.col("top")).otherwise(digest(F.col("top"), F.col(f"step{level}.after")))
        out = out.withColumn("top", F.when(F.col("pos") % (width * FAN) == 0, parent))
    held = line.rowsBetween(Window.unboundedPreceding, 0)
    own = F.array_compact(F.array(*[F.last(f"step{k}", True).over(held) for k in range(SPAN)]))
    return out.withColumn("own", own).drop(*[f"step{k}" for k in range(SPAN)])


def _climb(rows: DataFrame, name: str) -> list[DataFrame]:
    """rows (grp, pos, n, node), then those of each window's nodes; the last table has one row a group."""
    tables = [rows]
    while not tables[-1].where("n > 1").isEmpty():
        tops = _levels(tables[-1].select("grp", "pos", "n", "node")).where(f"pos % {BLOCK} = 0")
        tops = tops.select("grp", F.expr(f"pos div {BLOCK}").alias("pos"), F.expr(f"(n - 1) div {BLOCK} + 1").alias("n"), F.col("top").alias("node"))
        tables.append(stage(tops, f"{name}-{len(tables)}"))
    return tables


def _descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first table with their whole path and further columns of `above` (grp, path, ...), which has a row a group."""
    above = above.withColumn("at", F.lit(0).cast("long"))
    more = [c for c in above.columns if c not in ("grp", "path", "at")]
    for rows in reversed(tables[:-1]):
        joined = rows.withColumn("at", F.expr(f"pos div {BLOCK}")).join(above, ["grp", "at"])
        kept = [c for c in rows.columns if c not in ("n", "pos")] if rows is tables[0] else ["grp"]
        above = _levels(joined).select(*kept, *more, F.concat("own", "path").alias("path"), F.col("pos").alias("at"))
    if len(tables) == 1:
        above = tables[0].join(above.drop("at"), "grp").withColumnRenamed("pos", "at").drop("n")
    return above


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """grp (the group's text, "=" before it; "-" for null), place (the value of order), leaf, subroot, root, path (from the leaf up: the siblings before and after it on each
    level, one after the other) of each row, and the carried columns."""
    carried = carried or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(key.alias("grp"), F.col(order).alias("place"), leaf([F.col(f) for f in fields]).alias("node"), *[c.alias(k) for k, c in carried.items()])
    leaves = stage(leaves, "leaves")
    placed = stage(numbered(leaves, "grp", ["place", "node"], "leaves-in-order"), "leaves-placed")
    trees = _climb(placed, "nodes")
    subroots = numbered(trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("member"), "node"), "grp", ["member"], "subroots")
    groups = _climb(stage(subroots.select("grp", "member", "pos", "n", "node"), "subroots-placed"), "roots")
    root = groups[-1].select("grp", F.col("node").alias("root"), F.array().cast(STEP).alias("path"))
    known = _descend(groups, root).select(F.col("member").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    known = stage(known, "groups")
    out = _descend(trees, known).select("grp", "place", F.col("node").alias("leaf"), "subroot", "root", "path", *carried)
    discard(leaves)
    return out


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda held, step: digest(step["before"], held, step["after"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and whether it still holds after tampering."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = leaf([F.translate("text", "\n", "") if f == "text" else F.col(f) for f in fields])
    changed = (id_crc("doc_id") % 2 == 0) & F.contains("text", F.lit("\n"))
    out = manifest(docs, fields, "source", "doc_id", {"tampered": F.when(changed, cut)})
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    out = out.withColumn("proof_sha256", digest(proof)).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select(F.col("place").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL_op11_merkle_manifest = r"""
WITH RECURSIVE poly AS (
  SELECT i AS b, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8
), crc AS (
  SELECT doc_id, 0 AS i, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, s, xor(c >> 8, t[xor(c & 255, ascii(s[i + 1])::BIGINT) + 1]) FROM crc, tab WHERE i < length(s)
), even AS (
  SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 2 = 0
), f AS (
  SELECT d.*, concat(coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         replace(text, chr(10), '') AS cut, even.doc_id IS NOT NULL AS touched
  FROM documents d LEFT JOIN even ON even.doc_id = d.doc_id
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN touched THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS altered FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), tree AS (
  SELECT 0 AS level, source, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY source, pos // 3
), subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY pos // 3
), steps AS (
  SELECT source, level, x.pos, coalesce((SELECT string_agg(y.node, '' ORDER BY y.pos) FROM tree y WHERE y.source IS NOT DISTINCT FROM x.source AND y.level = x.level AND y.pos // 3 = x.pos // 3 AND y.pos < x.pos), '') AS before,
         coalesce((SELECT string_agg(y.node, '' ORDER BY y.pos) FROM tree y WHERE y.source IS NOT DISTINCT FROM x.source AND y.level = x.level AND y.pos // 3 = x.pos // 3 AND y.pos > x.pos), '') AS after
  FROM tree x WHERE n > 1
), above AS (
  SELECT level, x.pos, coalesce((SELECT string_agg(y.node, '' ORDER BY y.pos) FROM top y WHERE y.level = x.level AND y.pos // 3 = x.pos // 3 AND y.pos < x.pos), '') AS before,
         coalesce((SELECT string_agg(y.node, '' ORDER BY y.pos) FROM top y WHERE y.level = x.level AND y.pos // 3 = x.pos // 3 AND y.pos > x.pos), '') AS after
  FROM top x WHERE n > 1
), low AS (
  SELECT doc_id, source, leaf, pos AS own, 0 AS level, pos, altered AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, low.source, leaf, own, low.level + 1, low.pos // 3, sha256(before || folded || after), proof || before || after
  FROM low JOIN steps ON steps.source IS NOT DISTINCT FROM low.source AND steps.level = low.level AND steps.pos = low.pos
), half AS (
  SELECT low.*, s.subroot, s.pos AS place FROM low JOIN subroots s ON s.source IS NOT DISTINCT FROM low.source QUALIFY row_number() OVER (PARTITION BY low.source, own ORDER BY level DESC) = 1
), high AS (
  SELECT doc_id, source, leaf, subroot, own, 0 AS level, place AS pos, folded, proof FROM half
  UNION ALL
  SELECT doc_id, source, leaf, subroot, own, high.level + 1, high.pos // 3, sha256(before || folded || after), proof || before || after
  FROM high JOIN above ON above.level = high.level AND above.pos = high.pos
), done AS (
  SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY source, own ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM top WHERE n = 1) AS verified FROM done
"""
