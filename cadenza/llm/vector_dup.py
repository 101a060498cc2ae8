"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A function turns a vector by three rounds of random signs and a Hadamard transform; its code is the coordinate of greatest size with
its sign. A table strings `depth` functions together. Each vector is put under its own key and under the keys at the smallest loss in size (multiprobe), two to
the power of depth + 1 in all; two vectors meet if they share any key of a table. The depth grows with the logarithm of the number of vectors, so that unlike vectors
rarely meet, whatever the number. Two vectors at a cosine of 0.9 share a key of a table with a chance of 94, 90 and 84 percent at depths 2, 3 and 4, hence of one of TABLES with all
but less than 1 in a million; closer ones with more.

Equal vectors are one node. Nodes of one cell that lie within half of the threshold's angle of a leader are its ball: any two of them are linked, so
that they are counted, not paired. Keys are kept once for each ball, only keys of several balls go on, and balls are compared by their leaders: by the triangle inequality all
pairs of two balls are linked, or none, or else the members of just these two are compared in one block. Cells of many nodes are cut into parts, each
with leaders of its own, and keys of many balls into blocks that meet in pairs, so that no task holds more than a bound. Each pair of balls is
compared once, so that links are counted once. Nothing is dropped for being frequent.

Defined results: a vector that is null, empty or zero or holds null, NaN or infinite components is linked with nothing; vectors of different lengths are not linked; rows that
share an id are vectors of their own; a null id is never a component's id unless all its vectors have none; an empty table gives no rows. Only the id
and vector columns are read, so that others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import discard, stage, table
from cadenza.llm._graph import components

TABLES = 8
#: Choices of a code that multiprobe tries in each function, by depth.
CHOICES = {1: 6, 2: 6, 3: 5, 4: 4, 5: 3}
#: Nodes of a part of a cell, balls of a block of a key, and balls of a key up to which they are paired by a join.
PART, BLOCK, FEW = 2048, 512, 8
#: Radius of a ball as a share of the threshold's angle: two members are then at less than that angle.
RADIUS = 0.49
#: Angles that are so close to a bound are left to the comparison of members.
MARGIN = 1e-6
_SEED = 12


def packed(vector: Column) -> Column:
    """The components as little-endian 64-bit floats; null if the vector can't be linked."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for v in column:
            x = np.array([], float) if v is None else np.asarray([np.nan if c is None else c for c in v] if getattr(v, "dtype", object) == object else v, float)
            out.append((x + 0.0).astype("<f8").tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        return pd.Series(out, dtype=object)

    return run(vector)


def scaled(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Packed vectors of one length as rows, scaled by powers of two (without rounding) so that no square is too large or small, and their norms."""
    x = np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def unit(values: pd.Series) -> np.ndarray:
    """Packed vectors of one length as rows of length 1."""
    x, norm = scaled(values)
    return x / norm[:, None]


def cosines(one: pd.Series, two: pd.Series) -> np.ndarray:
    """Of all rows of one with all rows of two."""
    (x, nx), (y, ny) = scaled(one), scaled(two)
    return (x @ y.T) / (nx[:, None] * ny)


def turned(x: np.ndarray, function: int) -> np.ndarray:
    """Rows of x, padded to a power of two, after three rounds of signs and a Hadamard transform."""
    n, size = len(x), 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([_SEED, function]).choice([-1.0, 1.0], (3, size))
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for row in signs:
        x, half = x * row, 1
        while half < size:
            y = x.reshape(n, -1, 2, half)
            x, half = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size), 2 * half
        x /= math.sqrt(size)
    return x


def keys(x: np.ndarray, number: int, depth: int, many: int) -> np.ndarray:
    """The `many` best keys of each row of x in a table, its own first."""
    ids, losses = [], []
    for f in range(depth):
        y = turned(x, number * depth + f)
        best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : CHOICES[depth]]
        value = np.take_along_axis(y, best, 1)
        ids.append(2 * best + (value < 0))
        losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
    ways = np.array(list(product(range(ids[0].shape[1]), repeat=depth)))
    loss = sum(losses[f][:, ways[:, f]] for f in range(depth))
    best = ways[np.argsort(loss, axis=1, kind="stable")[:, :many]]
    key = np.full(best.shape[:2], number, np.int64)
    for f in range(depth):
        key = key * 2 * y.shape[1] + np.take_along_axis(ids[f], best[:, :, f], 1)
    return key


def depth_for(nodes: int, length: int) -> int:
    """Functions of a key: the fewest that give four keys at most one of so many unlike vectors."""
    return next((k for k in CHOICES if 4 * nodes * 2 ** (k + 1) <= (2 * length) ** k), max(CHOICES))


def _alike(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in parts of one length of vector."""
    for _, rows in batch.groupby(batch["v"].map(len)):
        yield rows.reset_index(drop=True)


def _balls(nodes: DataFrame, depth: int, angle: float) -> DataFrame:
    """node, leader and gap (the angle between them) of each node (node, v)."""
    schema = "node binary, v binary, cell long"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _alike(batch):
                yield rows.assign(cell=keys(unit(rows["v"]), TABLES, depth, 1)[:, 0])

    def leaders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        x = unit(rows["v"])
        gap, to, left = np.zeros(len(x)), np.arange(len(x)), np.arange(len(x))
        while len(left):
            far = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
            near = far <= RADIUS * angle
            near[0], far[0] = True, 0.0
            to[left[near]], gap[left[near]] = left[0], far[near]
            left = left[~near]
        return pd.DataFrame({"node": rows["node"], "leader": rows["node"].to_numpy()[to], "gap": gap})

    placed = stage(nodes.select("node", "v").mapInPandas(cells, schema).withColumn("size", F.octet_length("v")), "cells")
    counts = placed.groupBy("size", "cell").agg(F.count("*").alias("n"))
    counted = placed.join(counts.where("n > 1").hint("merge"), ["size", "cell"], "left")
    parted = stage(counted.withColumn("part", F.expr(f"pmod(xxhash64(node), (n - 1) div {PART} + 1)")), "parts")
    found = parted.where("n is not null").groupBy("size", "cell", "part").applyInPandas(leaders, "node binary, leader binary, gap double")
    out = stage(found.union(parted.where("n is null").select("node", "node", F.lit(0.0))), "balls")
    discard(placed, parted)
    return out


def _verdict(cosine: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of balls: 2 if all their members are linked, 1 if some may be, else 0. Two balls of one node: their cosine alone."""
    angle, most = np.arccos(np.clip(cosine, -1, 1)), math.acos(threshold)
    out = np.where(angle + ra + rb <= most - MARGIN, 2, np.where(angle - ra - rb <= most + MARGIN, 1, 0))
    return np.where(ra + rb == 0, 2 * (cosine >= threshold), out)


def _meetings(under: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs of balls (a < b) that share a key and may hold links, with their verdict. under: size, key, leader; known: leader, v, wide."""

    def pair(va: pd.Series, ra: pd.Series, vb: pd.Series, rb: pd.Series) -> pd.Series:
        (x, nx), (y, ny) = scaled(va), scaled(vb)
        return pd.Series(_verdict((x * y).sum(axis=1) / (nx * ny), ra.to_numpy(), rb.to_numpy(), threshold), dtype="int32")

    def few(va: pd.Series, ra: pd.Series, vb: pd.Series, rb: pd.Series) -> pd.Series:
        out = pd.Series(0, index=va.index, dtype="int32")
        for _, at in va.groupby(va.map(len)).groups.items():
            out[at] = pair(va[at], ra[at], vb[at], rb[at]).to_numpy()
        return out

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("leader", ignore_index=True)
        wide, part = rows["wide"].to_numpy(), rows["part"].to_numpy()
        a, b = np.triu_indices(len(rows), 1)
        if key[-2] != key[-1]:
            mixed = part[a] != part[b]
            a, b = a[mixed], b[mixed]
        said = _verdict(cosines(rows["v"], rows["v"])[a, b], wide[a], wide[b], threshold)
        name, on = rows["leader"].to_numpy(), said > 0
        return pd.DataFrame({"a": name[a[on]], "b": name[b[on]], "verdict": said[on]})

    sizes = under.groupBy("size", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(under.join(sizes.hint("merge"), ["size", "key"]), "shared-keys")
    small = met.where(F.col("n") <= FEW).select("size", "key", "leader")
    sides = [small.withColumnRenamed("leader", x) for x in "ab"]
    pairs = stage(sides[0].join(sides[1], ["size", "key"]).where("a < b").select("a", "b").distinct(), "meetings")
    named = [known.select(F.col("leader").alias(x), F.col("v").alias(f"v{x}"), F.col("wide").alias(f"r{x}")).hint("merge") for x in "ab"]
    told = pairs.join(named[0], "a").join(named[1], "b").select("a", "b", F.pandas_udf(few, "int")("va", "ra", "vb", "rb").alias("verdict")).where("verdict > 0")
    large = met.where(F.col("n") > FEW).withColumn("parts", F.expr(f"(n - 1) div {BLOCK} + 1")).withColumn("part", F.expr("pmod(xxhash64(leader), parts)"))
    large = large.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("size", "key", "leader", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    large = large.join(known.select("leader", "v", "wide").hint("merge"), "leader")
    told = told.union(large.groupBy("size", "key", "i", "j").applyInPandas(block, "a binary, b binary, verdict int"))
    out = stage(told.groupBy("a", "b").agg(F.max("verdict").alias("verdict")), "near-balls")
    discard(met, pairs)
    return out


def _between(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b, node and n: to how many vectors of the other ball of a pair (a, b) a node is linked. members: leader, node, w, v."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["leader"] == key[0]], rows[rows["leader"] == key[1]]
        linked = cosines(one["v"], two["v"]) >= threshold
        n = np.concatenate([linked @ two["w"].to_numpy(), linked.T @ one["w"].to_numpy()])
        out = pd.DataFrame({"a": key[0], "b": key[1], "node": pd.concat([one["node"], two["node"]], ignore_index=True), "n": n})
        return out[out["n"] > 0]

    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("leader"))
    return sides.join(members.hint("merge"), "leader").groupBy("a", "b").applyInPandas(compare, "a binary, b binary, node binary, n long")


def link(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), packed(F.col(vector)).alias("v")).withColumn("node", F.unhex(F.md5("v")))
    rows = stage(rows, "vectors")
    nodes = rows.where("v is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w"), F.first("v").alias("v"))
    nodes = stage(nodes, "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("longest")).first()
    depth = depth_for(size["n"], 1 << max(1, ((size["longest"] or 16) // 8 - 1).bit_length()))
    in_ball = _balls(nodes, depth, math.acos(threshold))
    members = stage(in_ball.join(nodes.hint("merge"), "node"), "members")
    known = members.groupBy("leader").agg(F.max("gap").alias("wide"), F.sum("w").alias("weight"), F.min("vec_id").alias("first"), F.max(F.when(F.col("node") == F.col("leader"), F.col("v"))).alias("v"))
    known = stage(known, "leaders")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _alike(batch):
                x = unit(part["v"])
                for number in range(TABLES):
                    found = keys(x, number, depth, 2 ** (depth + 1))
                    yield pd.DataFrame({"size": x.shape[1], "key": found.ravel(), "leader": np.repeat(part["leader"].to_numpy(), found.shape[1])})

    under = stage(members.select("leader", "v").mapInPandas(spread, "size int, key long, leader binary").distinct(), "keys")
    near = _meetings(under, known, threshold)
    whole = near.where("verdict = 2").select("a", "b")
    some = stage(_between(near.where("verdict = 1").select("a", "b"), members.select("leader", "node", "w", "v"), threshold), "links")
    labels = components(whole.union(some.select("a", "b").distinct()), "vectors")
    both = whole.union(whole.select("b", "a")).toDF("leader", "other")
    beside = both.join(known.select(F.col("leader").alias("other"), "weight").hint("merge"), "other").groupBy("leader").agg(F.sum("weight").alias("beside"))
    classes = known.select("leader", "weight", "first").join(labels.withColumnRenamed("node", "leader"), "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    firsts = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(firsts, "component").join(beside, "leader", "left").select("leader", "component_id", (F.col("weight") - 1 + F.coalesce("beside", F.lit(0))).alias("n"))
    single = some.groupBy("node").agg(F.sum("n").alias("more"))
    told = members.select("node", "leader").join(classes, "leader").join(single, "node", "left")
    told = stage(told.select("node", "component_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links")), "classes")
    discard(nodes, in_ball, members, known, under, near, some)
    out = rows.select("vec_id", "node").join(told, "node", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return link(table(spark, sf_dir, "embeddings"))


SQL_op12_embedding_near_dup = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) BETWEEN 0.9 AND 2
), reach AS (
  SELECT a AS vec_id, a AS c FROM p UNION SELECT p.b, r.c FROM reach r JOIN p ON p.a = r.vec_id
), m AS (
  SELECT vec_id, min(c) AS c FROM reach GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, v.vec_id) AS component_id, coalesce(m.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.vec_id = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id
"""
