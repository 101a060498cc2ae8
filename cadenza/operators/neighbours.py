"""Exact nearest neighbours without all pairs: points of a series (series_id, u, y) lie around their nearest pivots, in rings of about equal numbers by their distance to it, and the
triangle inequality tells which rings can hold a query's nearest.

Pivots are about 2 sqrt(n) points of a series, at most MOST, taken by a hash; a ring is called a cell. A query first meets the points of the nearest cells that hold k; then only cells that may
hold one no farther than the k-th distance found so far. Cells lie in blocks of about PART points: a query goes once to each block that it has a cell of, with a bit for each cell, and blocks and
their queries meet in parts of bounded size, each of which gives at most k rows a query. Series of few points have no cells: many of them meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.tables import settled

MOST = 512
#: Rings of a pivot at most, and points of a ring at least, on average.
RINGS = 16
RING = 16
#: Points of a part, and queries.
PART = 4096
ASKED = 1024
#: Numbers that a block holds at a time.
HELD = 1 << 21
#: Points of a series that has no cells, its queries at most, and rows of such series that meet in a task.
DIRECT = 256
DIRECT_ASKED = 4096
TOGETHER = 16384
#: Distances so close to a bound are not left out.
MARGIN = 1e-6


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column]).reshape(len(column), -1)


def stacked(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix; a null one, or null in one, is NaN."""
    width = width or max((len(x) for x in column if x is not None), default=1)
    return np.array([np.full(width, np.nan) if x is None else np.asarray(x, float) for x in column]).reshape(len(column), width)


def distances_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y, rounded so that ties are the same everywhere."""
    step = max(1, HELD // max(y.size, 1))
    out = [np.sqrt(((x[a : a + step, None] - y[None]) ** 2).sum(axis=2)) for a in range(0, len(x), step)]
    return np.round(np.concatenate(out), 9) if out else np.zeros((0, len(y)))


def nearest_of(x: np.ndarray, y: np.ndarray, u: np.ndarray, k: np.ndarray, wanted: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the k[row] nearest rows of y, the smaller u first where distances are equal to nine digits: rows of x, rows of y and distances. wanted: which rows of y a slice of x may
    meet. Products tell which rows can be among the nearest; distances are taken of these only."""
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    known = np.isfinite(aa).all() and np.isfinite(bb).all()  # else every distance is taken
    step, out = max(1, HELD // len(y)), []
    for at in range(0, len(x), step):
        part = slice(at, min(at + step, len(x)))
        near = aa[part, None] + bb - 2 * (a[part] @ b.T) if known else np.zeros((part.stop - at, len(y)))
        if wanted is not None:
            near = np.where(wanted(part), near, np.inf)
        most = np.minimum(k[part], len(y))
        kept = int(most.max())
        bound = np.sort(np.partition(near, kept - 1, axis=1)[:, :kept], axis=1)[np.arange(len(near)), most - 1] if kept < len(y) else np.full(len(near), np.inf)
        slack = 1e-7 * (aa[part] + bb.max()) + 1e-15 if known else 0.0
        rows, cols = np.nonzero((near <= (bound + slack)[:, None]) & (near < np.inf))
        far, span = np.zeros(len(rows)), max(1, HELD // max(x.shape[1], 1))
        for i in range(0, len(rows), span):
            far[i : i + span] = np.sqrt(((x[at + rows[i : i + span]] - y[cols[i : i + span]]) ** 2).sum(axis=1))
        far = np.round(far, 9)
        order = np.lexsort((u[cols], far, rows))
        rows, cols, far = rows[order], cols[order], far[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < most[rows]
        out.append((rows[first] + at, cols[first], far[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def codes(column: pd.Series) -> np.ndarray:
    """A number for each different value, which may be a struct."""
    try:
        return pd.factorize(column)[0]
    except TypeError:
        return pd.factorize(column.map(repr))[0]


def _parted(df: DataFrame, ident: str, by: list[str], size: int | None = None) -> DataFrame:
    """df with part, of `size` (PART) rows of its group at most on average, and parts."""
    counts = df.groupBy(*by).agg(F.expr(f"(count(*) - 1) div {size or PART} + 1").alias("parts"))
    return df.join(counts, by).withColumn("part", F.pmod(F.xxhash64(F.lit(5), ident), F.col("parts")))


def _at_pivots(rows: DataFrame, ident: str, pivots: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows, pivots of their series) for parts of the rows."""
    parted = _parted(rows, ident, ["series_id"], min(ASKED, PART))
    sent = parted.select("series_id", "parts").distinct().join(pivots, "series_id").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    sent = sent.withColumnRenamed("series_id", "of").withColumnRenamed("part", "into")
    return parted.groupBy("series_id", "part").cogroup(sent.groupBy("of", "into")).applyInPandas(lambda a, b: run(a, b.sort_values("cell", ignore_index=True)), schema)


#: Rows of a side of a block.
SIDE = 2048


def blocks(left: DataFrame, right: DataFrame, idents: tuple[str, str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(part of left, part of right) for all pairs of parts of a series on both sides, SIDE rows each on average: all pairs of rows, without a row for each. idents deal the rows to parts."""
    a, b = _parted(left, idents[0], ["series_id"], SIDE), _parted(right, idents[1], ["series_id"], SIDE)
    sizes = a.select("series_id", F.col("parts").alias("_a")).distinct().join(b.select("series_id", F.col("parts").alias("_b")).distinct(), "series_id")
    spread = lambda c: F.explode(F.expr(f"sequence(0, {c} - 1)"))
    a = a.drop("parts").join(sizes, "series_id").withColumn("_other", spread("_b")).drop("_a", "_b")
    b = b.drop("parts").join(sizes, "series_id").withColumn("_other", spread("_a")).drop("_a", "_b")
    b = b.withColumnsRenamed({"series_id": "_of", "part": "_part", "_other": "_into"})
    both = lambda x, y: run(x, y) if len(x) and len(y) else pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])
    return a.groupBy("series_id", "part", "_other").cogroup(b.groupBy("_of", "_into", "_part")).applyInPandas(both, schema)


def each_slice(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of slices of rows of x to all rows of y, NaN where one is null."""
    step = max(1, HELD // max(y.size, 1))
    for at in range(0, len(x), step):
        yield slice(at, at + step), distances_of(x[at : at + step], y)


def least_of(far: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row, by the names where they are equal; infinite ones are left out."""
    bound = np.partition(far, k - 1, axis=1)[:, k - 1] if k < far.shape[1] else np.full(len(far), np.inf)
    rows, cols = np.nonzero((far <= bound[:, None]) & (far < np.inf))
    order = np.lexsort((names[cols], far[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], cols[first]


def nearest_pairs(left: DataFrame, right: DataFrame, idents: tuple[str, str], k: int) -> DataFrame:
    """Candidates of the k nearest rows of right (series_id, an ident, y) of each row of left (series_id, an ident, x): both idents, which differ, and d, of each block; null distances come first."""
    a, b = idents
    kinds = {a: left.schema[a].dataType.simpleString(), b: right.schema[b].dataType.simpleString()}

    def run(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        y, names, own, out = stacked(points["y"]), points[b].to_numpy(), rows[a].to_numpy(), []
        x = stacked(rows["x"], y.shape[1])
        for part, far in each_slice(x, y):
            far = np.where(np.isnan(far), -np.inf, far)
            far[own[part][:, None] == names] = np.inf
            i, j = least_of(far, names, k)
            out.append(pd.DataFrame({a: own[part][i], b: names[j], "d": far[i, j]}))
        return pd.concat(out)

    given = lambda df, c: df.where(F.col(c).isNotNull())
    found = blocks(given(left, a), given(right, b), idents, run, f"{a} {kinds[a]}, {b} {kinds[b]}, d double")
    return found.withColumn("d", F.when(F.col("d") >= 0, F.col("d")))


class Cells:
    """Points in the cells of pivots."""

    def __init__(self, points: DataFrame, most: int = MOST):
        self.kinds = {c: points.schema[c].dataType.simpleString() for c in ("series_id", "u")}
        points = points.select("series_id", "u", F.col("y").cast("array<double>").alias("y"))
        hashed = points.withColumn("h", F.xxhash64(F.lit(11), "u", "y"))
        counts = hashed.groupBy("series_id").agg(F.count("*").alias("n"), F.min("h").alias("low"))
        share = F.least(2 * F.sqrt("n"), F.lit(float(most))) / F.col("n")
        chosen = hashed.join(counts, "series_id").where((F.col("h") == F.col("low")) | (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)))
        chosen = settled(chosen.select("series_id", F.col("y").alias("p")).distinct().withColumn("cell", F.monotonically_increasing_id()))

        def place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            far = distances_of(_stack(rows["y"]), _stack(pivots["p"]))
            best = far.argmin(axis=1)
            return pd.DataFrame({"series_id": rows["series_id"], "u": rows["u"], "y": rows["y"], "cell": pivots["cell"].to_numpy()[best], "gap": far[np.arange(len(rows)), best]})

        schema = f"series_id {self.kinds['series_id']}, u {self.kinds['u']}, y array<double>, cell long, gap double"
        placed = settled(_at_pivots(points, "u", chosen, place, schema))
        cuts = placed.groupBy("cell").agg(F.percentile_approx("gap", F.array(*[F.lit(r / RINGS) for r in range(1, RINGS)]), 1000).alias("cuts"), F.count("*").alias("n"))
        cuts = cuts.select("cell", F.when(F.col("n") >= RING * RINGS, F.col("cuts")).otherwise(F.filter("cuts", lambda c, i: i % F.greatest((RING * RINGS / F.col("n")).cast("int"), F.lit(1)) == 0)).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("gap")))
        self.points = settled(placed.join(cuts, "cell").select("series_id", "u", "y", "gap", F.col("cell").alias("pivot"), (F.col("cell") * RINGS + ring).alias("cell")))
        rings = self.points.groupBy("pivot", "cell").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
        # the cells of a series, a bounded number, in blocks: `bit` is a cell's place in its block
        before = F.coalesce(F.sum("n").over(Window.partitionBy("series_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = rings.join(chosen.withColumnRenamed("cell", "pivot"), "pivot").withColumn("_b", F.floor(before / PART))
        inside = Window.partitionBy("series_id", "_b").orderBy("cell")
        cells = cells.withColumn("bit", (F.row_number().over(inside) - 1).cast("int")).withColumn("block", F.min("cell").over(Window.partitionBy("series_id", "_b"))).drop("_b")
        self.pivots = settled(cells)
        self.points = self.points.join(self.pivots.select("cell", "block", "bit"), "cell").select("u", "y", "block", "bit")

    def first(self, queries: DataFrame) -> DataFrame:
        """Queries (series_id, t, x, k) at the blocks of the nearest cells that hold k points, with a bit for each such cell of the block, and n, the points of these cells."""

        def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            return Cells._wanted(rows, pivots, lambda least, far: Cells._nearest(rows, pivots, least, far))

        return _at_pivots(queries, "t", self.pivots, run, self._schema(queries))

    def within(self, queries: DataFrame) -> DataFrame:
        """Queries (series_id, t, x, k, reach) at the blocks of all other cells that can hold a point within reach."""

        def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            return Cells._wanted(rows, pivots, lambda least, far: (least <= rows["reach"].to_numpy()[:, None] + MARGIN) & ~Cells._nearest(rows, pivots, least, far))

        return _at_pivots(queries, "t", self.pivots, run, self._schema(queries))

    @staticmethod
    def _least(rows: pd.DataFrame, cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """What the distance of each query to any point of each cell is at least, and its distance to the cell's pivot."""
        kinds, place = np.unique(cells["pivot"].to_numpy(), return_inverse=True)
        far = distances_of(_stack(rows["x"]), _stack(cells["p"].iloc[np.unique(place, return_index=True)[1]]))[:, place]
        return np.maximum(np.maximum(far - cells["high"].to_numpy(), cells["low"].to_numpy() - far), 0), far

    @staticmethod
    def _nearest(rows: pd.DataFrame, cells: pd.DataFrame, least: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether a cell is among the nearest that hold k points."""
        order, n = np.lexsort((far, least), axis=1), cells["n"].to_numpy()
        held = n[order]
        out = np.zeros(least.shape, bool)
        np.put_along_axis(out, order, np.cumsum(held, axis=1) - held < rows["k"].to_numpy()[:, None], 1)
        return out

    @staticmethod
    def _schema(queries: DataFrame) -> str:
        kinds = {c: queries.schema[c].dataType.simpleString() for c in ("series_id", "t")}
        return f"series_id {kinds['series_id']}, t {kinds['t']}, x array<double>, k int, block long, bits binary, n long"

    @staticmethod
    def _wanted(rows: pd.DataFrame, cells: pd.DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
        """Queries at the blocks that they have cells of; a few hundred queries are looked at at a time."""
        columns, out = ["series_id", "t", "x", "k"], []
        if not len(rows) or not len(cells):
            return rows[columns].iloc[:0].assign(block=np.zeros(0, int), bits=[], n=np.zeros(0, int))
        chosen = choose(*Cells._least(rows, cells))
        for block, own in cells.groupby("block", sort=False):
            own = own.sort_values("bit")
            bits = chosen[:, own.index.to_numpy()]
            at = np.flatnonzero(bits.any(axis=1))
            if len(at):
                packed = np.packbits(bits[at], axis=1)
                out.append(rows[columns].iloc[at].assign(block=block, bits=[p.tobytes() for p in packed], n=bits[at] @ own["n"].to_numpy()))
        return pd.concat(out, ignore_index=True) if out else rows[columns].iloc[:0].assign(block=np.zeros(0, int), bits=[], n=np.zeros(0, int))

    def met(self, wanted: DataFrame) -> DataFrame:
        """series_id, t, u, d: of each query and block of `wanted`, the k nearest points."""
        asked = _parted(wanted.drop("n"), "t", ["block"]).withColumnRenamed("parts", "asked_parts").withColumnRenamed("part", "asked_part")
        held = _parted(self.points, "u", ["block"])
        sizes = asked.select("block", "asked_parts").distinct().join(held.select("block", "parts").distinct(), "block")
        left = asked.drop("asked_parts").join(sizes.select("block", "parts"), "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        right = held.drop("parts").join(sizes.select("block", "asked_parts"), "block").withColumn("asked_part", F.explode(F.expr("sequence(0, asked_parts - 1)"))).select(F.col("block").alias("c"), F.col("part").alias("p"), F.col("asked_part").alias("a"), "u", "y", "bit")
        kinds = {c: wanted.schema[c].dataType.simpleString() for c in ("series_id", "t")}

        def run(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(points):
                return pd.DataFrame({"series_id": [], "t": [], "u": [], "d": []})
            bits = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in rows["bits"]]), axis=1).astype(bool)
            bit, u = points["bit"].to_numpy(), points["u"].to_numpy()
            at, chosen, far = nearest_of(_stack(rows["x"]), _stack(points["y"]), u, rows["k"].to_numpy(), lambda part: bits[part][:, bit])
            return pd.DataFrame({"series_id": rows["series_id"].to_numpy()[at], "t": rows["t"].to_numpy()[at], "u": u[chosen], "d": far})

        by = ["block", "part", "asked_part"]
        return left.groupBy(*by).cogroup(right.groupBy("c", "p", "a")).applyInPandas(run, f"series_id {kinds['series_id']}, t {kinds['t']}, u {self.kinds['u']}, d double")


def _direct(asked: DataFrame, points: DataFrame, count: int) -> DataFrame:
    """series_id, t, u, d of the k nearest points of each query, for series of few points, of which many meet in a task."""
    into = F.pmod(F.xxhash64(F.lit(7), "series_id"), F.lit(1 + count // TOGETHER))
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("series_id", "t")} | {"u": points.schema["u"].dataType.simpleString()}

    def run(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        of = codes(pd.concat([rows["series_id"], points["series_id"]], ignore_index=True))
        left, right = of[: len(rows)], of[len(rows) :]
        order = np.argsort(right, kind="stable")
        ends = np.searchsorted(right[order], np.arange(of.max(initial=-1) + 2))
        k, u, out = rows["k"].to_numpy(), points["u"].to_numpy(), []
        for name, own in rows.groupby(left, sort=False).indices.items():
            held = order[ends[name] : ends[name + 1]]
            if len(held):
                at, chosen, far = nearest_of(_stack(rows["x"].iloc[own]), _stack(points["y"].iloc[held]), u[held], k[own])
                out.append((own[at], held[chosen], far))
        if not out:
            return pd.DataFrame({"series_id": [], "t": [], "u": [], "d": []})
        at, chosen, far = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"series_id": rows["series_id"].iloc[at].to_numpy(), "t": rows["t"].to_numpy()[at], "u": u[chosen], "d": far})

    left, right = asked.withColumn("_into", into), points.select("series_id", "u", F.col("y").cast("array<double>").alias("y")).withColumn("_to", into)
    return left.groupBy("_into").cogroup(right.groupBy("_to")).applyInPandas(run, f"series_id {kinds['series_id']}, t {kinds['t']}, u {kinds['u']}, d double")


def k_nearest(queries: DataFrame, points: DataFrame, most: int = MOST, compared: list | None = None) -> DataFrame:
    """series_id, t, u, d and rank of the k nearest points (series_id, u, y) of each query (series_id, t, x, k), the smaller u first where distances are equal to
    nine digits. compared: a list that gets a table of the cells that each query has met (series_id, t, n points)."""
    asked = settled(queries.select("series_id", "t", F.col("x").cast("array<double>").alias("x"), F.col("k").cast("int").alias("k")).where("series_id IS NOT NULL"))
    sizes = points.groupBy("series_id").agg(F.count("*").alias("_n")).join(asked.groupBy("series_id").agg(F.count("*").alias("_q")), "series_id")
    sizes = settled(sizes.withColumn("_few", (F.col("_n") <= DIRECT) & (F.col("_q") <= DIRECT_ASKED)))
    rows = {r["_few"]: r["n"] for r in sizes.groupBy("_few").agg(F.sum(F.col("_n") + F.col("_q")).alias("n")).collect()}
    place, met = Window.partitionBy("series_id", "t").orderBy("d", "u"), None
    of = lambda df, few: df if len(rows) < 2 else df.join(sizes.where(F.col("_few") == few).select("series_id"), "series_id")
    if True in rows:
        met = _direct(of(asked, True), of(points, True), rows[True])
    if False in rows or not rows:
        own = of(asked, False)
        cells = Cells(of(points, False), most)
        first = settled(cells.first(own))
        near = settled(cells.met(first))
        kth = near.withColumn("rank", F.row_number().over(place)).join(own.select("series_id", "t", "k"), ["series_id", "t"]).where("rank <= k").groupBy("series_id", "t", "k").agg(F.max("d").alias("d"), F.count("*").alias("held"))
        reach = kth.select("series_id", "t", F.when(F.col("held") == F.col("k"), F.col("d")).otherwise(F.lit(float("inf"))).alias("reach"))
        more = settled(cells.within(own.join(reach, ["series_id", "t"])))
        if compared is not None:
            compared.append(first.union(more).groupBy("series_id", "t").agg(F.sum("n").alias("n")))
        both = near.union(cells.met(more))
        met = both if met is None else met.union(both)
    return met.join(asked.select("series_id", "t", "k"), ["series_id", "t"]).withColumn("rank", F.row_number().over(place)).where("rank <= k").select("series_id", "t", "u", "d", "rank")
