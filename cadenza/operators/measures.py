"""Dependence between two groups of series, mostly from one pass of second moments.

`moments` brings the frames of both groups together once; each task sums the products of its frames, and only tables of
channels by channels go on. Gram matrices over frames are never formed: what they would give follows from the moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators import windows as W
from cadenza.operators.neighbours import blocks
from cadenza.operators.ranks import placed, shares
from cadenza.sources.tables import lcg, settled

#: Components that the similarity of matrices index compares.
COMPONENTS = 10
EPS = 1e-10


def _wide(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """One row a frame that both groups have: x and y, arrays in the order of the channels."""
    both = x.select(*by, "t", F.lit(0).alias("_side"), "ch", "v").unionByName(y.select(*by, "t", F.lit(1).alias("_side"), "ch", "v"))
    rows = both.groupBy(*by, "t").agg(F.array_sort(F.collect_list(F.struct("_side", "ch", "v"))).alias("_z"))
    side = lambda k: F.transform(F.filter("_z", lambda r: r["_side"] == k), lambda r: r["v"])
    return rows.select(*by, "t", side(0).alias("x"), side(1).alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))


def moments(x: DataFrame, y: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Sums over the frames of each series of two groups of channels (…, t, ch, v): rows of `part` (each task's share), p
    channels of x, n, and flat sums over rows centred by the series' means, scaled by its deviations too, and scaled to
    unit length: `centred`, `standard`, `unit`."""
    keys = list(by)
    frames = _wide(x, y, keys)
    stats = x.withColumn("_side", F.lit(0)).unionByName(y.withColumn("_side", F.lit(1))).groupBy(*keys, "_side", "ch").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_d"))
    stats = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_side", "ch", "_m", "_d"))).alias("_s"))
    met = frames.join(stats, keys).select(*keys, "x", "y", F.transform("_s", lambda r: r["_m"]).alias("m"), F.transform("_s", lambda r: r["_d"]).alias("d"))

    def sums(z: np.ndarray, p: int) -> np.ndarray:
        a, b = (z[:, :p] ** 2).sum(axis=1), (z[:, p:] ** 2).sum(axis=1)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0), [a @ a, a @ b, b @ b]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key, g in batch.groupby(keys, sort=False):
                p = len(g["x"].iloc[0])
                z = np.hstack([np.stack(g["x"].to_numpy()), np.stack(g["y"].to_numpy())]) - g["m"].iloc[0]
                dev = np.asarray(g["d"].iloc[0], float)
                scaled = z / np.where(dev > 0, dev, 1.0)
                unit = np.hstack([w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) for w in (z[:, :p], z[:, p:])])
                new = [len(z), sums(z, p), sums(scaled, p), sums(unit, p)]
                old = held.get(key)
                held[key] = [p, *new] if old is None else [p, *(u + v for u, v in zip(old[1:], new))]
        if held:
            out = pd.DataFrame(list(held.values()), columns=["p", "n", "centred", "standard", "unit"])
            yield pd.concat([pd.DataFrame(list(held), columns=keys), out], axis=1)

    kinds = ", ".join(f"{k} {met.schema[k].dataType.simpleString()}" for k in keys)
    return met.mapInPandas(run, f"{kinds}, p long, n long, centred array<double>, standard array<double>, unit array<double>")


class Sums:
    """The moments of one series: X'X, Y'Y, X'Y, sums of columns, and sums of products of the rows' energies."""

    def __init__(self, flat: np.ndarray, p: int):
        size = int(round((np.sqrt(4 * len(flat) - 11) - 1) / 2))
        full = flat[: size * size].reshape(size, size)
        self.xx, self.yy, self.xy = full[:p, :p], full[p:, p:], full[:p, p:]
        rest = flat[size * size :]
        self.x, self.y, (self.pp, self.pq, self.qq) = rest[:p], rest[p:size], rest[size:]


def ratio(a: float, b: float) -> float | None:
    """a / b, None without a finite value."""
    return float(a / b) if b and np.isfinite(a) and np.isfinite(b) else None


def rv_family(c: Sums, s: Sums, u: Sums, n: int) -> dict[str, float | None]:
    """rv, rv2 (zero diagonal), cka, r1, both adjusted RVs, rv2 of standardised columns, and the correlation of the two
    cosine matrices over the pairs of frames."""
    sq = lambda m: float((m * m).sum())
    xy, xx, yy, p, q = sq(c.xy), sq(c.xx), sq(c.yy), len(c.xx), len(c.yy)
    out = {"rv": ratio(xy, np.sqrt(xx * yy)), "rv2": ratio(xy - c.pq, np.sqrt((xx - c.pp) * (yy - c.qq)))}
    k = min(p, q)
    out["r1"] = ratio(np.trace(c.xy[:k, :k]), np.sqrt(np.trace(c.xx) * np.trace(c.yy)))
    out["cka"] = out["rv"]
    out["rv2_standard"] = ratio(sq(s.xy) - s.pq, np.sqrt((sq(s.xx) - s.pp) * (sq(s.yy) - s.qq)))
    if n > 2:  # the share that R² has and its adjusted form, for standardised columns
        loss = lambda m, a: a - (n - 1) / (n - 2) * (a - sq(m) / (n - 1) ** 2)
        a, b, d = loss(s.xy, p * q), loss(s.xx, p * p), loss(s.yy, q * q)
        out["rv_adjusted"] = ratio(xy * a / sq(s.xy), np.sqrt(xx * b / sq(s.xx) * (yy * d / sq(s.yy)))) if sq(s.xy) and b * d > 0 else None
    else:
        out["rv_adjusted"] = None
    expected = np.sqrt(np.trace(c.xx) ** 2 / xx * np.trace(c.yy) ** 2 / yy) / (n - 1) if xx and yy and n > 1 else None
    out["rv_less_expected"] = None if expected is None or out["rv"] is None else ratio(out["rv"] - expected, 1 - expected)
    pairs = n * (n - 1) / 2
    sx, sy = (u.x @ u.x - n) / 2, (u.y @ u.y - n) / 2
    sxx, syy, sxy = (sq(u.xx) - n) / 2, (sq(u.yy) - n) / 2, (sq(u.xy) - n) / 2
    if pairs > 0:
        spread = (sxx - sx * sx / pairs) * (syy - sy * sy / pairs)
        out["autocorrelation"] = ratio(sxy - sx * sy / pairs, np.sqrt(spread)) if spread > 0 else None
    else:
        out["autocorrelation"] = None
    return out


def basis(m: np.ndarray, keep: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (each with a positive largest entry) and singular values of a matrix with the moments m, as
    many as hold a share of the variance."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    full = int((w > 1e-10 * max(w.max(initial=0), 1e-300)).sum())
    n = min(int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), keep - 1e-12) + 1), full)
    v = v[:, :n]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(n)]), np.sqrt(w[:n])


def smi_matrix(overlap: np.ndarray, how: str = "orthogonal") -> np.ndarray:
    """Similarity of matrices index for the first 1, 2, ... components of both sides. overlap: products of left singular vectors."""
    a, b = overlap.shape
    if how == "orthogonal":
        smallest = np.minimum(np.arange(1, a + 1)[:, None], np.arange(1, b + 1))
        return np.clip((overlap**2).cumsum(axis=1).cumsum(axis=0) / smallest, 0, 1)
    return np.clip([[np.linalg.svd(overlap[: i + 1, : j + 1], compute_uv=False).mean() ** 2 for j in range(b)] for i in range(a)], 0, 1)


def lower_median(values: np.ndarray) -> float:
    """The lower of the two middle values."""
    flat = np.sort(np.asarray(values).ravel())
    return float(flat[(len(flat) - 1) // 2])


def subspace_family(c: Sums) -> dict[str, float | None]:
    """Measures of the singular vectors of both sides: procrustes (nuclear norm), svcca, pwcca, smi (orthogonal and procrustes, the lower
    median over the first components; smi_full: mean over all), r2, r3, r4, rg and both Coxhead coefficients."""
    scale = np.sqrt(np.trace(c.xx) * np.trace(c.yy))
    (vx, sx), (vy, sy) = basis(c.xx), basis(c.yy)
    if not len(sx) or not len(sy):
        return {}
    overlap = (vx / sx).T @ c.xy @ (vy / sy)  # UX' UY
    (kx, tx), (ky, ty) = basis(c.xx, 0.99), basis(c.yy, 0.99)
    full = np.clip(np.linalg.svd(overlap, compute_uv=False), 0, 1)
    left, canonical, _ = np.linalg.svd(overlap)
    canonical = np.clip(canonical, 0, 1)
    # each canonical direction weighs as much as the columns of x project on it
    weight = np.abs((left.T * sx) @ vx.T).sum(axis=1)[: len(canonical)]
    k = min(len(sx), len(sy))
    few = overlap[:COMPONENTS, :COMPONENTS]
    out = {
        "procrustes": ratio(np.linalg.svd(c.xy, compute_uv=False).sum(), scale),
        "svcca": float(np.clip(np.linalg.svd((kx / tx).T @ c.xy @ (ky / ty), compute_uv=False), 0, 1).mean()),
        "pwcca": ratio(weight @ canonical, weight.sum()),
        "smi": lower_median(smi_matrix(few)),
        "smi_procrustes": lower_median(smi_matrix(few, "procrustes")),
        "smi_full": float((full**2).mean()),
        "r2": ratio((np.diag(overlap)[:k] * sx[:k] * sy[:k]).sum(), scale),
        "r4": float(np.diag(overlap)[:k].sum() / np.sqrt(len(sx) * len(sy))),
        "rg": float((overlap**2).sum() / np.sqrt(len(sx) * len(sy))),
    }
    out["r3"] = float(np.trace(vx @ overlap @ vy.T) / np.sqrt(len(sx) * len(sy))) if len(vx) == len(vy) else None
    size = np.sqrt(len(c.xx) * len(c.yy))
    out["coxhead"] = float(1 - size / (1 / np.maximum(1 - canonical, 1e-12)).sum())
    small, large, cross = (c.yy, c.xx, c.xy) if len(c.yy) <= len(c.xx) else (c.xx, c.yy, c.xy.T)
    explained = cross.T @ np.linalg.pinv(large) @ cross
    rest = np.linalg.pinv(small - explained)
    out["coxhead_trace"] = ratio(np.trace(rest @ explained), np.trace(rest @ small))
    return out


RV_NAMES = ("rv", "rv2", "r1", "cka", "rv_adjusted", "rv_less_expected", "rv2_standard", "autocorrelation")
SUBSPACE_NAMES = ("procrustes", "svcca", "pwcca", "smi", "smi_procrustes", "smi_full", "r2", "r3", "r4", "rg", "coxhead", "coxhead_trace")


def _finished(parts: DataFrame, by: tuple[str, ...], names: tuple[str, ...], subspaces: bool) -> DataFrame:
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, n = int(pdf["p"].iloc[0]), int(pdf["n"].sum())
        centred, standard, unit = (Sums(np.sum(np.stack(pdf[k].to_numpy()), axis=0), p) for k in ("centred", "standard", "unit"))
        found = subspace_family(centred) if subspaces else rv_family(centred, standard, unit, n)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {k: found.get(k) for k in names}]).astype({k: float for k in names})

    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    return parts.groupBy(*keys).applyInPandas(run, kinds + "".join(f", {k} double" for k in names))


def moment_measures(x: DataFrame, y: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """RV_NAMES of each series' two groups of channels (…, t, ch, v); null where undefined."""
    return _finished(moments(x, y, by), by, RV_NAMES, False)


def small_matrix_measures(x: DataFrame, y: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """SUBSPACE_NAMES of each series' two groups of channels."""
    return _finished(moments(x, y, by), by, SUBSPACE_NAMES, True)


def pooled_measures(groups: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """small_matrix_measures() of all features of a side together: groups holds two tables (x, y) a feature; their
    channels are numbered one feature after the other."""

    def stacked(k: int) -> DataFrame:
        out = None
        for i, pair in enumerate(groups.values()):
            one = pair[k].select("series_id", "t", (F.col("ch") + i * 1_000_000).alias("ch"), "v")
            out = one if out is None else out.unionByName(one)
        return out

    return small_matrix_measures(stacked(0), stacked(1))


def smi_significance(x: DataFrame, y: DataFrame, replicates: int, seed: int = 5) -> DataFrame:
    """series_id, smi and p: the share of replicates, in which the frames of x are dealt anew, whose score is no lower. The scores of all
    replicates come from one join and one sum over frames; frames are weighed by the singular vectors first."""
    parts = moments(x, y)

    def bases(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Sums(np.sum(np.stack(pdf["centred"].to_numpy()), axis=0), int(pdf["p"].iloc[0]))
        rows = []
        for side, m in ((0, c.xx), (1, c.yy)):
            v, s = basis(m)
            for k in range(min(COMPONENTS, len(s))):
                rows += [(pdf["series_id"].iloc[0], side, k, i, float(v[i, k] / s[k])) for i in range(len(v))]
        return pd.DataFrame(rows, columns=["series_id", "side", "k", "place", "w"])

    kind = parts.schema["series_id"].dataType.simpleString()
    weights = parts.groupBy("series_id").applyInPandas(bases, f"series_id {kind}, side int, k int, place int, w double")

    def scores(rows: DataFrame, side: int) -> DataFrame:
        mean = F.avg("v").over(Window.partitionBy("series_id", "ch"))
        place = F.dense_rank().over(Window.partitionBy("series_id").orderBy("ch")) - 1
        own = rows.select("series_id", "t", (F.col("v") - mean).alias("v"), place.cast("int").alias("place"))
        met = own.join(weights.where(F.col("side") == side).drop("side"), ["series_id", "place"])
        return met.groupBy("series_id", "t", "k").agg(F.sum(F.col("v") * F.col("w")).alias("u")).groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("k", "u"))).alias("u"))

    left, right = scores(x, 0), scores(y, 1)
    frames = left.select("series_id", "t").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    order = Window.partitionBy("series_id", "b")
    dealt = frames.withColumn("i", F.row_number().over(order.orderBy("t"))).withColumn("j", F.row_number().over(order.orderBy(F.when(F.col("b") > 0, lcg(lcg(F.col("t"), F.col("b") + seed) + 7919, F.col("b"))), "t")))
    pairs = dealt.select("series_id", "b", F.col("i").alias("r"), F.col("t").alias("tx")).join(dealt.select("series_id", "b", F.col("j").alias("r"), F.col("t").alias("ty")), ["series_id", "b", "r"])
    met = pairs.join(left.select("series_id", F.col("t").alias("tx"), F.col("u").alias("a")), ["series_id", "tx"]).join(right.select("series_id", F.col("t").alias("ty"), F.col("u").alias("c")), ["series_id", "ty"])
    cells = met.select("series_id", "b", F.explode("a").alias("a"), "c").select("series_id", "b", "a", F.explode("c").alias("c"))
    cells = cells.groupBy("series_id", "b", F.col("a.k").alias("i"), F.col("c.k").alias("j")).agg(F.sum(F.col("a.u") * F.col("c.u")).alias("m"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((pdf["i"].max() + 1, pdf["j"].max() + 1))
        m[pdf["i"], pdf["j"]] = pdf["m"]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "b": pdf["b"].iloc[:1], "smi": [lower_median(smi_matrix(m))]})

    each = cells.groupBy("series_id", "b").applyInPandas(score, f"series_id {kind}, b int, smi double")
    own = each.where("b = 0").select("series_id", F.col("smi").alias("own"))
    return each.where("b > 0").join(own, "series_id").groupBy("series_id").agg(F.first("own").alias("smi"), F.avg((F.col("smi") >= F.col("own")).cast("int")).alias("p"))


def feature_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """series_id, a, b, rv2, smooth and spread: the modified RV of each feature of the left side with each of the right (series_id, name, t, ch, v), and the
    factors that the caller may multiply it with: the largest step of either over its largest value, and deviation over norm."""
    names = lambda d, c: d.select("series_id", F.col("name").alias(c)).distinct()
    both = names(left, "a").join(names(right, "b"), "series_id")
    x = left.withColumnRenamed("name", "a").join(both, ["series_id", "a"])
    y = right.withColumnRenamed("name", "b").join(both, ["series_id", "b"])
    scores = moment_measures(x, y, ("series_id", "a", "b")).select("series_id", "a", "b", "rv2")

    def factors(d: DataFrame, c: str) -> DataFrame:
        channel = Window.partitionBy("series_id", "name", "ch")
        step = F.abs(F.lead("v").over(channel.orderBy("t")) - F.col("v")) / F.max(F.abs("v")).over(channel)
        rows = d.withColumn("_s", step).groupBy("series_id", "name", "ch").agg(F.max("_s").alias("s"), F.stddev_samp("v").alias("d"), F.sum(F.col("v") * F.col("v")).alias("q"))
        return rows.groupBy("series_id", F.col("name").alias(c)).agg(F.max("s").alias(f"s_{c}"), (F.avg("d") / (F.sqrt(F.sum("q")) + 1e-8)).alias(f"d_{c}"))

    met = scores.join(factors(left, "a"), ["series_id", "a"]).join(factors(right, "b"), ["series_id", "b"])
    return met.select("series_id", "a", "b", "rv2", (F.col("s_a") + F.col("s_b")).alias("smooth"), (F.col("d_a") + F.col("d_b")).alias("spread"))


def _products(df: DataFrame, run, schema: str, *also: str) -> DataFrame:
    """run(series_id, i, j, products, known) for blocks of pairs of frames (series_id, t, ch, v): sums over the channels that both have of the products of their values, as a matrix, known where a
    value is; i and j are the frames. also: columns of df with one value a series."""
    rows = df.groupBy("series_id", "t", *also).agg(F.collect_list(F.struct("ch", F.coalesce(F.col("v"), F.lit(float("nan"))).alias("v"))).alias("x"))

    def side(column: pd.Series, place: dict) -> tuple[np.ndarray, np.ndarray]:
        value, known = np.zeros((len(column), len(place))), np.zeros((len(column), len(place)))
        for i, cells in enumerate(column):
            at, v = [place[c["ch"]] for c in cells], np.array([c["v"] for c in cells], float)
            there = ~np.isnan(v)
            np.add.at(value[i], at, np.where(there, v, 0.0))
            np.add.at(known[i], at, there)
        return value, known

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        place = {c: k for k, c in enumerate(dict.fromkeys(c["ch"] for column in (a["x"], b["y"]) for cells in column for c in cells))}
        (x, p), (y, q) = side(a["x"], place), side(b["y"], place)
        return run(a, a["t"].to_numpy(), b["u"].to_numpy(), x @ y.T, p @ q.T > 0)

    return blocks(rows.where("t IS NOT NULL"), rows.where("t IS NOT NULL").select("series_id", F.col("t").alias("u"), F.col("x").alias("y")), ("t", "u"), block, schema)


def scaled_autocorrelation(df: DataFrame) -> DataFrame:
    """series_id, i, j, a: for all pairs of frames, the sum over channels (series_id, t, ch, v) of the products of their values, each channel
    scaled to 0..1; the sums scaled to 0..1 too. Quadratic within a series: in blocks, once for the extremes and once for the rows, so that no pair is shuffled."""
    channel, kinds = Window.partitionBy("series_id", "ch"), [df.schema[c].dataType.simpleString() for c in ("series_id", "t")]
    low = F.min("v").over(channel)
    rows = settled(df.select("series_id", "t", "ch", F.try_divide(F.col("v") - low, F.max("v").over(channel) - low).alias("v")))

    def ends(a, i, j, products, known):
        return pd.DataFrame({"series_id": a["series_id"].iloc[:1], "low": [products[known].min()], "high": [products[known].max()]}) if known.any() else pd.DataFrame({"series_id": [], "low": [], "high": []})

    def cells(a, i, j, products, known):
        low, high = float(a["low"].iloc[0]), float(a["high"].iloc[0])
        scaled = np.where(known, products - low, np.nan) / (high - low) if high > low else np.full(products.shape, np.nan)
        return pd.DataFrame({"series_id": a["series_id"].iloc[0], "i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "a": scaled.ravel()})

    span = _products(rows, ends, f"series_id {kinds[0]}, low double, high double").groupBy("series_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = _products(rows.join(span, "series_id", "left"), cells, f"series_id {kinds[0]}, i {kinds[1]}, j {kinds[1]}, a double", "low", "high")
    return found.withColumn("a", F.when(~F.isnan("a"), F.col("a")))


def autocorrelation_weight(df: DataFrame) -> DataFrame:
    """series_id, weight: one over the mean of the frames' products of standardised channels, scaled to 0..1. Quadratic within a series: in blocks, of which only sums and extremes go on."""
    channel, kind = Window.partitionBy("series_id", "ch"), df.schema["series_id"].dataType.simpleString()
    rows = df.select("series_id", "t", "ch", F.try_divide(F.col("v") - F.avg("v").over(channel), F.stddev_samp("v").over(channel)).alias("v"))

    def sums(a, i, j, products, known):
        held = products[known]
        some = [held.min(), held.max(), held.sum()] if len(held) else [None] * 3
        return pd.DataFrame([[a["series_id"].iloc[0], *some, len(held)]], columns=["series_id", "low", "high", "s", "n"])

    parts = _products(rows, sums, f"series_id {kind}, low double, high double, s double, n long")
    low, mean = F.min("low"), F.sum("s") / F.sum("n")
    return parts.groupBy("series_id").agg(F.try_divide(F.max("high") - low, mean - low).alias("weight"))


def conditional_dependence(df: DataFrame, features: int) -> DataFrame:
    """series_id, step, feature, score: the features (array x) of each series in the order in which they are found, each the one that most
    raises the dependence of y on all so far (Azadkia and Chatterjee): a sum over frames of the smaller of the ranks of y at the
    frame and at its nearest neighbour in those features. Rows: series_id, t, x, y. One round a feature, pairs within a series."""
    whole = Window.partitionBy("series_id")
    rows = df.withColumn("n", F.count("*").over(whole)).withColumn("r", F.count("*").over(whole.orderBy("y").rangeBetween(Window.unboundedPreceding, 0))).withColumn("l", F.count("*").over(whole.orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, 0)))
    picked = rows.select("series_id").distinct().withColumn("have", F.array().cast("array<int>"))
    out = None
    for step in range(1, features + 1):
        tries = picked.withColumn("feature", F.explode(F.array(*[F.lit(k) for k in range(features)]))).where(~F.array_contains("have", F.col("feature"))).withColumn("use", F.array_append("have", F.col("feature")))
        own = rows.join(tries, "series_id").withColumn("z", F.transform("use", lambda k: F.get("x", k).cast("double")))
        other = own.select("series_id", "feature", F.col("t").alias("u"), F.col("z").alias("w"), F.col("r").alias("ru"))
        gap = F.round(F.aggregate(F.zip_with("z", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b), 12)
        met = own.join(other, ["series_id", "feature"]).where("t <> u").withColumn("d", gap)
        near = met.groupBy("series_id", "feature", "t", "n", "r", "l").agg(F.min(F.struct("d", "u", "ru"))["ru"].alias("ru"))
        num = F.sum(F.least("r", "ru") - F.col("l") * F.col("l") / F.col("n"))
        den = F.sum(F.col("l") * (F.col("n") - F.col("l")) / F.col("n"))
        scored = near.groupBy("series_id", "feature").agg(F.round(F.try_divide(num, den), 9).alias("score"))
        best = scored.groupBy("series_id").agg(F.max(F.struct("score", (-F.col("feature")).alias("f"))).alias("m")).select("series_id", (-F.col("m.f")).alias("feature"), "m.score")
        best = settled(best)
        picked = picked.join(best.drop("score"), "series_id").select("series_id", F.array_append("have", F.col("feature")).alias("have"))
        best = best.withColumn("step", F.lit(step))
        out = best if out is None else out.unionByName(best)
    return out


def pearson_median(x: DataFrame, y: DataFrame) -> DataFrame:
    """Correlation of channel i of x with channel i of y; the lower median over channels."""
    met = x.select("series_id", "t", "ch", F.col("v").alias("a")).join(y.select("series_id", "t", "ch", F.col("v").alias("b")), ["series_id", "t", "ch"])
    each = met.groupBy("series_id", "ch").agg(F.corr("a", "b").alias("r"))
    return each.groupBy("series_id").agg(F.expr("percentile_disc(0.5) within group (order by r)").alias("r"))


def concordance(x: str, y: str) -> Column:
    """Concordance correlation of two columns, with sample deviations."""
    a, b = F.stddev_samp(x), F.stddev_samp(y)
    return F.try_divide(2 * F.corr(x, y) * a * b, a * a + b * b + F.pow(F.avg(x) - F.avg(y), F.lit(2.0)))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of ranks."""
    ranked = df.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def xi(df: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """Chatterjee's dependence of y on x: 1 - mean(abs(rank steps)) (n - 1) / (2 n) / mean(g (1 - g)), where
    ranks count the values of y that are no greater, over n, and g those no smaller."""
    whole = Window.partitionBy(*by)
    rows = df.withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_r", F.count("*").over(whole.orderBy(y).rangeBetween(Window.unboundedPreceding, 0)) / F.col("_n"))
    rows = rows.withColumn("_g", F.count("*").over(whole.orderBy(F.desc(y)).rangeBetween(Window.unboundedPreceding, 0)) / F.col("_n"))
    rows = rows.withColumn("_s", F.abs(F.lead("_r").over(whole.orderBy(x, tie)) - F.col("_r")))
    n = F.first("_n")
    return rows.groupBy(*by).agg((1 - F.try_divide(F.avg("_s") * (n - 1) / (2 * n), F.avg(F.col("_g") * (1 - F.col("_g"))))).alias("xi"))


#: Rows of a channel's order that one task subtracts at a time.
STRETCH = 8192


def xi_columns(df: DataFrame) -> DataFrame:
    """i, j, xi of all pairs of channels (t, ch, v), which all frames have: each channel is ranked once, in sorted ranges over all channels; the ranks of a frame, an array,
    go to the frame's place in the order of each channel, and neighbours are subtracted in stretches, whose first rows are also sent to the stretch before."""
    table = settled(shares(df, ["ch"], "v"))
    spread = table.groupBy("ch").agg((F.sum(F.col("_c") * F.col("g") * (1 - F.col("g"))) / F.first("n")).alias("_d"), F.first("n").alias("_n"))
    ranked = df.join(table.select("ch", "v", "r"), ["ch", "v"])
    frames = ranked.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("ch", "r"))).alias("_all"))
    channels = [r["ch"] for r in spread.select("ch").orderBy("ch").collect()]  # columns of a table, fixed by its schema
    kind = df.schema["ch"].dataType.simpleString()
    frames = frames.select("t", F.transform("_all", lambda a: a["r"]).alias("_all"))
    rows = placed(df.select("ch", "t", "v"), ["ch"], ["v", "t"]).select("ch", "t", "pos").join(frames, "t").withColumn("part", F.expr(f"pos div {STRETCH}"))
    rows = rows.union(rows.where(f"pos > 0 and pos % {STRETCH} = 0").withColumn("part", F.col("part") - 1)).select("ch", "part", "pos", "_all")

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.stack(pdf.sort_values("pos")["_all"].to_numpy())
        return pd.DataFrame({"i": pdf["ch"].iloc[0], "j": channels, "s": np.abs(np.diff(r, axis=0)).sum(axis=0)})

    means = rows.groupBy("ch", "part").applyInPandas(steps, f"i {kind}, j {kind}, s double").where("i <> j").groupBy("i", "j").agg(F.sum("s").alias("s"))
    n = F.col("_n")
    return means.join(spread.withColumnRenamed("ch", "j"), "j").select("i", "j", (1 - F.try_divide(F.col("s") / (2 * n), F.col("_d"))).alias("xi"))


def matthews(df: DataFrame, by: list[str], target: str, predicted: str) -> DataFrame:
    """Matthews correlation of two class labels for any number of classes, from the counts of cells."""
    cells = df.groupBy(*by, target, predicted).agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias(name))
    both = cells.groupBy(*by, F.col(target).alias("k")).agg(F.sum("n").alias("a")).join(cells.groupBy(*by, F.col(predicted).alias("k")).agg(F.sum("n").alias("b")), [*by, "k"])
    cross = both.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    right = cells.groupBy(*by).agg(F.sum("n").alias("s"), F.coalesce(F.sum(F.when(F.col(target) == F.col(predicted), F.col("n"))), F.lit(0)).alias("c"))
    met = right.join(cross, by, "left").join(side(target, "aa"), by).join(side(predicted, "bb"), by)
    s2 = F.col("s") * F.col("s")
    return met.select(*by, F.try_divide(F.col("c") * F.col("s") - F.coalesce("ab", F.lit(0)), F.sqrt((s2 - F.col("aa")).cast("double") * (s2 - F.col("bb")))).alias("mcc"))


def rhythmic_envelope(series: DataFrame, rate: float, share: float = 0.025) -> DataFrame:
    """An envelope as rhythmic reactivity compares it: smoothed over a twelfth of a second, clamped to its peaks and scaled to 1, its
    lowest values raised to a quantile, and smoothed over a twenty-fourth."""
    rows = N.envelope(W.gaussian(series, rate / 12).withColumn("v", F.round("v", 9)), 1 - share)
    low = rows.groupBy("series_id").agg(F.percentile("v", F.lit(4 * share)).alias("_low"))
    rows = rows.join(low, "series_id").select("series_id", "t", F.least(F.greatest("v", "_low"), F.lit(1.0)).alias("v"))
    return W.gaussian(rows, rate / 24)


def rhythmic_reactivity(pairs: DataFrame) -> DataFrame:
    """Dot product of two envelopes (series_id, t, x, y), each scaled to unit length."""
    return pairs.groupBy("series_id").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("r"))


def mutual_information(pairs: DataFrame, bins: int = 256, sigma: float = 0.4) -> DataFrame:
    """Mutual information in bits of two series (series_id, x, y in 0..1) from a joint histogram in which each frame counts
    for all bins near it by a Gaussian of width 2 sigma² (on a scale of 0 to 255), and twice it over the sum of the entropies."""
    width, step = 2 * sigma * sigma, 255.0 / (bins - 1)
    reach = max(1, int(np.ceil(8 * width / step)))  # beyond eight widths the kernel is below 1e-13

    def near(c: str) -> Column:
        middle = F.round(F.col(c) * 255 / step).cast("int")
        around = F.filter(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: middle + o), lambda k: (k >= 0) & (k < bins))
        return F.transform(around, lambda k: F.struct(k.alias("bin"), F.exp(-0.5 * F.pow((F.col(c) * 255 - k * step) / width, F.lit(2.0))).alias("w")))

    rows = pairs.select("series_id", near("x").alias("p"), near("y").alias("q"))
    whole = Window.partitionBy("series_id")

    def entropy(cells: DataFrame, name: str) -> DataFrame:
        p = F.col("w") / (F.sum("w").over(whole) + EPS)
        return cells.withColumn("_p", p).groupBy("series_id").agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + EPS))).alias(name))

    side = lambda c: rows.select("series_id", F.explode(c).alias("k")).groupBy("series_id", F.col("k.bin").alias("bin")).agg(F.sum("k.w").alias("w"))
    joint = rows.select("series_id", F.explode("p").alias("p"), "q").select("series_id", "p", F.explode("q").alias("q")).groupBy("series_id", F.col("p.bin").alias("i"), F.col("q.bin").alias("j")).agg(F.sum(F.col("p.w") * F.col("q.w")).alias("w"))
    counts = rows.groupBy("series_id").agg(F.count("*").alias("n"))

    def marginal(c: str, name: str) -> DataFrame:
        means = side(c).join(counts, "series_id").select("series_id", (F.col("w") / F.col("n")).alias("w"))
        return entropy(means, name)

    met = marginal("p", "hx").join(marginal("q", "hy"), "series_id").join(entropy(joint, "hxy"), "series_id")
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return met.select("series_id", mi.alias("mi"), F.try_divide(2 * mi, F.col("hx") + F.col("hy")).alias("normalised"))
