"""Mixing sources to target weights by the cube method.

Each source gets a target number of tokens. A document is taken floor(w) times, w being its source's
target over its size, and once more with the fractional probability that is left. Which documents
get the extra copy is a balanced sample: the cube method moves the vector of inclusion probabilities
at random along directions that keep the totals of documents and of tokens (the null space of the
constraints), until all but a few entries are 0 or 1. The flight runs on blocks of BLOCK units of one
source at a time; what each block leaves open (at most two units) meets in larger rounds, and the last
few are landed on the outcome nearest to the token target.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a source
without words has the target 0 and nothing of it is taken; repeated rows are units of their own, numbered 0, 1, ...; null and
large ids are kept as they are; an empty table gives no rows. The draws depend on ids, sources, sizes and these numbers
only, so that reruns agree however the rows are spread. mix() reads the columns it is given; take() returns all
columns of docs, whatever their names.

The table of sources, one small row each, is ordered in one task; everything else is spread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm._common import WORD, broadcast_if_small, discard, free, stage, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Units that one flight handles.
BLOCK = 500
#: Units of a source, besides the two that a flight leaves, that are landed and not flown.
LANDING = 10
#: Parts in which the rows that are equal in id, source and size are numbered.
PARTS = 64
SEED = 11
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size; one row a source) with target: weight times one level that is the
    same for all sources below their limit. The level is found by one pass over the sources, ordered by
    the level at which each reaches its limit."""
    every = Window.partitionBy(F.lit(0))
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    rows = sizes.withColumn("_weight", weight).withColumn("_limit", most * F.col("source_size"))
    rows = rows.withColumn("_full_at", F.col("_limit") / F.col("_weight"))
    by_level = every.orderBy("_full_at", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("_limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (share * F.sum("source_size").over(every) - full) / open_weight)
    rows = rows.withColumn("_rank", F.row_number().over(by_level))
    first = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_rank", "_level"))).over(every)["_level"]
    return rows.withColumn("target", F.least(F.col("_limit"), F.coalesce(first, F.col("_full_at")) * F.col("_weight"))).select("source", "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two are strictly between 0 and 1; their sum and the sum of
    their sizes (documents and tokens expected in the sample) stay as they are."""
    p, tokens = p.tolist(), (size / max(size.max(initial=0.0), 1.0)).tolist()
    tops = iter(draw.random(2 * len(p) + 16).tolist())
    held: list[int] = []
    at = 0
    while True:
        while len(held) < 3 and at < len(p):
            held.append(at)
            at += 1
        if len(held) < 3:
            return np.array(p)
        i, j, k = held
        u = (tokens[k] - tokens[j], tokens[i] - tokens[k], tokens[j] - tokens[i])  # the null space of (1 1 1; tokens)
        if not any(u):  # equal sizes: moving one against another keeps both sums
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[x]) / d if d > 0 else -p[x] / d) for x, d in zip(held, u, strict=True) if d)
        down = min((p[x] / d if d > 0 else (p[x] - 1) / d) for x, d in zip(held, u, strict=True) if d)
        step = up if next(tops, 0.5) * (up + down) < down else -down
        for x, d in zip(held, u, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + step * d))
            if p[x] <= _NEAR or p[x] >= 1 - _NEAR:
                p[x] = float(round(p[x]))
        held = [x for x in held if 0 < p[x] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few open units on the outcome whose tokens, then documents, are nearest to what they
    should bring, the first such in binary order. Where a single large document leaves the tokens off,
    units of the block change sides, one after the other, as long as that brings them nearer."""
    open_at = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(open_at))[:, None] >> np.arange(len(open_at))) & 1
    tokens = np.abs(outcomes @ size[open_at] - p[open_at] @ size[open_at])
    docs = np.abs(outcomes.sum(axis=1) - p[open_at].sum())
    out = p.copy()
    out[open_at] = outcomes[np.lexsort((docs, tokens))[0]]
    off = float((out - p) @ size)
    for _ in range(len(p)):
        moved = off + np.where(out > 0, -size, size)
        best = int(np.argmin(np.abs(moved)))
        if abs(moved[best]) >= abs(off):
            break
        out[best], off = 1 - out[best], float(moved[best])
    return out


def _same(names: dict[str, str]) -> Column:
    """Whether the columns named by the keys equal those named by the values, nulls included."""
    met = [F.col(k).eqNullSafe(F.col(o)) for k, o in names.items()]
    out = met[0]
    for one in met[1:]:
        out = out & one
    return out


def numbered(rows: DataFrame, keys: list[str], part: str, to: str) -> DataFrame:
    """rows with `to`: 0, 1, ... among those that are equal in keys. The column part spreads equal rows: they are numbered
    within each part, after what the parts before hold, so that no task needs all equal rows."""
    others = {k: free(f"_{k}", rows) for k in (*keys, part)}
    alone, before = {k: others[k] for k in keys}, free("_before", rows)
    several = stage(rows.groupBy(*[F.col(k).alias(o) for k, o in alone.items()]).agg(F.count("*").alias(before)).where(F.col(before) > 1).drop(before), "repeated")
    if several.isEmpty():
        discard(several)
        return rows.withColumn(to, F.lit(0).cast("long"))
    parts = rows.join(several.hint("merge"), _same(alone), "left_semi").groupBy(*[F.col(k).alias(o) for k, o in others.items()]).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(*alone.values()).orderBy(others[part]).rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0))), "repeated-parts")
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.lit(0))) - 1
    met = rows.join(parts.hint("merge"), _same(others), "left")
    return met.withColumn(to, F.when(F.col(before).isNull(), F.lit(0)).otherwise(F.col(before) + own).cast("long")).drop(*others.values(), before)


def _fly(block: pa.Table, names: list[str]) -> pa.Table:
    """One flight over the open units of a block. In a source's last block, the last LANDING units don't
    fly, so that the landing has enough outcomes to choose from."""
    block = block.sort_by([(c, "ascending") for c in ("_order", "doc_id", "size", "number")])
    source, size, p = block["source"][0].as_py(), block["size"].to_numpy().astype(float), block["p"].to_numpy().copy()
    name = f"{SEED} {'' if source is None else f's{source}'} {block['_block'][0].as_py()} {block['_round'][0].as_py()}"
    last = block["_last"][0].as_py()
    fly = max(0, len(p) - LANDING * last)
    p[:fly] = flight(p[:fly], size[:fly], np.random.default_rng(zlib.crc32(name.encode())))
    landed = pa.array(land(p, size) if last else p, pa.float64())
    return block.set_column(block.schema.get_field_index("p"), "p", landed).select(names)


def cube(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units (doc_id, source, size, number, pi) with selected: a balanced sample within each source.

    Rounds go on until every source's open units fit one block; each round leaves at most two units
    of a block open, so that their number falls by hundreds each time.
    """
    names = ["doc_id", "source", "size", "number", "pi", "p"]
    rows = units.select(*names[:-1], F.col("pi").alias("p"))
    sure = (F.col("pi") <= _NEAR) | (F.col("pi") >= 1 - _NEAR)
    done, open_rows, number = rows.where(sure).withColumn("p", F.round("pi")), rows.where(~sure), 0
    while not open_rows.isEmpty():
        number += 1
        counts = open_rows.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / block).alias("_n"))
        order = F.xxhash64(F.col("doc_id"), F.col("size"), F.col("number"), F.lit(SEED + number))
        dealt = open_rows.join(broadcast_if_small(counts), F.col("source").eqNullSafe(F.col("_source"))).withColumns(
            {"_order": order, "_block": F.pmod(order, F.col("_n")), "_round": F.lit(number), "_last": F.col("_n") == 1}
        )
        flown = stage(dealt.groupBy("source", "_block").applyInArrow(lambda b: _fly(b, names), rows.schema), f"cube-{number}")
        done, open_rows = done.unionByName(flown.where("p = 0 or p = 1")), flown.where("p > 0 and p < 1")
    return done.select("doc_id", "source", "size", "number", "pi", (F.col("p") == 1).alias("selected"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, number (among equal rows), source_size, target, copies and taken for each document."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), part.alias("part")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targeted = stage(targets(totals).withColumnsRenamed({"source": "_source"}).withColumn("_weight", weight), "targets")
    wanted = broadcast_if_small(targeted)
    of_source = F.col("source").eqNullSafe(F.col("_source"))
    units = numbered(sized, ["doc_id", "source", "size"], "part", "number")
    drawn = cube(units.join(wanted, of_source).select("doc_id", "source", "size", "number", (F.col("_weight") - F.floor("_weight")).alias("pi")))
    out = drawn.join(wanted, of_source).withColumn("copies", F.floor("_weight") + F.col("selected").cast("long"))
    return out.select("doc_id", "source", "size", "number", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    made = mix(docs.select("doc_id", "source", "text"))
    size, part, number, copies, copy = (free(x, docs) for x in ("_size", "_part", "_number", "_copies", "_copy"))
    sized = docs.withColumns({size: word_count(F.col("text")), part: F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))})
    own = numbered(sized, ["doc_id", "source", size], part, number)
    names = {"doc_id": free("_made_id", own), "source": free("_made_source", own), size: free("_made_size", own), number: free("_made_number", own)}
    made = made.where("copies > 0").select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "source", "size", "number"), names.values())], F.col("copies").alias(copies))
    return own.join(made, _same(names)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
