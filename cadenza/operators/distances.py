"""Distances between distributions and between series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.groups import t_statistic
from cadenza.operators.measures import mutual_information
from cadenza.operators.neighbours import blocks, each_slice, k_nearest, least_of, stacked
from cadenza.operators.ranks import placed
from cadenza.sources.tables import lcg, settled, uniform


#: Sums that one row carries.
SLICE = 4096


def gaussian_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Means and covariances of channels (…, t, ch, v): rows (…, i, j, n, m) hold sums of products of centred channels, and those with i = -1
    the means."""
    group = Window.partitionBy(*by, "ch")
    rows = df.select(*by, "t", "ch", (F.col("v") - F.avg("v").over(group)).alias("v"))
    left = rows.select(*by, "t", F.col("ch").alias("i"), F.col("v").alias("a"))
    right = rows.select(*by, "t", F.col("ch").alias("j"), F.col("v").alias("b"))
    products = left.join(right, [*by, "t"]).where("i <= j").groupBy(*by, "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("m"))
    plain = df.groupBy(*by, F.lit(-1).alias("i"), F.col("ch").alias("j")).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    return products.unionByName(plain)


def _gaussian(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    plain = rows[rows["i"] < 0].sort_values("j")
    n, place = int(plain["n"].iloc[0]), {c: k for k, c in enumerate(plain["j"])}
    full = np.zeros((len(plain), len(plain)))
    own = rows[rows["i"] >= 0]
    i, j = own["i"].map(place), own["j"].map(place)
    full[i, j] = full[j, i] = own["m"] / (n - 1)
    return plain["m"].to_numpy(), full


def symmetric(m: np.ndarray) -> bool:
    """Whether a matrix equals its transpose, but for rounding."""
    return bool(np.allclose(m, m.T, rtol=1e-5, atol=1e-8))


def positive_definite(m: np.ndarray) -> bool:
    """Whether all eigenvalues of a symmetric matrix are positive, beyond rounding."""
    w = np.linalg.eigvalsh((m + m.T) / 2)
    return bool((w > 1e-12 * np.abs(w).max()).all())


def root(m: np.ndarray) -> np.ndarray:
    """Square root of a positive semidefinite matrix."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def square_roots(df: DataFrame) -> DataFrame:
    """series_id, i, j, r: the square root of the covariance of each series' channels (series_id, t, ch, v)."""
    moments = gaussian_moments(df, ["series_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = root(_gaussian(pdf)[1])
        i, j = np.indices(r.shape)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "i": i.ravel(), "j": j.ravel(), "r": r.ravel()})

    kind = df.schema["series_id"].dataType.simpleString()
    return moments.groupBy("series_id").applyInPandas(run, f"series_id {kind}, i int, j int, r double")


def gaussian_distances(df: DataFrame, side: str) -> DataFrame:
    """For each series and its two sides (column `side`: 0 and 1): Fréchet, Bures-Wasserstein and correlation distances of their Gaussians, the
    Kullback-Leibler divergence of the covariances (half of trace(B⁻¹A) - d + ln |B| / |A|) and its symmetric form with the means, the affine-invariant
    Riemann distance (root of the summed squares of the logarithms of the eigenvalues of A⁻¹B) and the condition distance (the logarithm of the largest less that of the smallest);
    and whether both are positive definite; those that need an inverse are null otherwise. Only d by d moments reach a task."""
    moments = gaussian_moments(df, ["series_id", side])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[side].nunique() < 2:
            return pd.DataFrame([])
        (ma, a), (mb, b) = (_gaussian(pdf[pdf[side] == k]) for k in (0, 1))
        ra = root(a)
        bures = max(float(np.trace(a) + np.trace(b) - 2 * np.trace(root(ra @ b @ ra))), 0.0)
        out = {"series_id": pdf["series_id"].iloc[0], "frechet": float(((ma - mb) ** 2).sum()) + bures, "bures": bures**0.5, "correlation": 1 - float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))}
        out["definite"] = symmetric(a) and symmetric(b) and positive_definite(a) and positive_definite(b)
        if out["definite"]:
            ia, ib = np.linalg.inv(a), np.linalg.inv(b)
            out["divergence"] = 0.5 * float(np.trace(ib @ a) - len(a) + np.linalg.slogdet(b)[1] - np.linalg.slogdet(a)[1])
            out["kl"] = 0.5 * float(np.trace(ib @ a) + np.trace(ia @ b) + (ma - mb) @ (ia + ib) @ (ma - mb)) - len(a)
            inverse = np.linalg.inv(ra)
            w = np.log(np.linalg.eigvalsh(inverse @ b @ inverse))
            out["riemann"], out["condition"] = float(np.sqrt((w * w).sum())), float(w[-1] - w[0])
        return pd.DataFrame([out]).reindex(columns=["series_id", "frechet", "bures", "correlation", "definite", "divergence", "kl", "riemann", "condition"])

    kind = df.schema["series_id"].dataType.simpleString()
    return moments.groupBy("series_id").applyInPandas(run, f"series_id {kind}, frechet double, bures double, correlation double, definite boolean, divergence double, kl double, riemann double, condition double")


def _coupled(met: DataFrame, by: list[str], name: str) -> DataFrame:
    """The quadratic cost of points x and y that are coupled row by row, of each group: the mean over pairs of rows of ((x - x')² - (y - y')²)², in sums of powers."""
    a, b = F.col("x"), F.col("y")
    sums = met.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *[F.sum(F.pow(a, F.lit(float(i))) * F.pow(b, F.lit(float(j)))).alias(f"s{i}{j}") for i in range(5) for j in range(5 - i) if i + j])
    quartic = lambda p: 2 * F.col("n") * F.col(p(4)) - 8 * F.col(p(3)) * F.col(p(1)) + 6 * F.col(p(2)) * F.col(p(2))
    cross = 2 * F.col("n") * F.col("s22") + 2 * F.col("s20") * F.col("s02") + 4 * F.col("s11") * F.col("s11") - 4 * F.col("s21") * F.col("s01") - 4 * F.col("s12") * F.col("s10")
    return sums.select(*by, ((quartic(lambda e: f"s{e}0") + quartic(lambda e: f"s0{e}") - 2 * cross) / (F.col("n") * F.col("n"))).alias(name))


def sliced_gromov_wasserstein(df: DataFrame, side: str, projections: int, seed: int = 1) -> DataFrame:
    """Mean over random projections of the cheaper of the two monotone couplings of two sides of equal size.
    The quadratic cost of a coupling is a polynomial in sums of powers of the sorted values, so no pair of
    points is made."""
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(projections - 1))))
    weight = lcg(lcg(F.col("ch") * 1009 + F.col("k"), seed) + 7919, seed) / F.lit(2147483648.0) - 0.5
    points = rows.groupBy("series_id", side, "k", "t").agg(F.sum(F.col("v") * weight).alias("p"))
    order = Window.partitionBy("series_id", side, "k")
    ranked = points.withColumn("up", F.row_number().over(order.orderBy("p", "t"))).withColumn("down", F.row_number().over(order.orderBy(F.desc("p"), F.desc("t"))))
    x = ranked.where(F.col(side) == 0).select("series_id", "k", F.col("up").alias("r"), F.col("p").alias("x"))
    costs = []
    for way in ("up", "down"):
        y = ranked.where(F.col(side) == 1).select("series_id", "k", F.col(way).alias("r"), F.col("p").alias("y"))
        costs.append(_coupled(x.join(y, ["series_id", "k", "r"]), ["series_id", "k"], way))
    return costs[0].join(costs[1], ["series_id", "k"]).groupBy("series_id").agg(F.avg(F.least("up", "down")).alias("sgw"))


def kernel_distance(df: DataFrame, side: str, channels: int) -> DataFrame:
    """Unbiased polynomial-kernel distance (dot / d + 1)³ of two sets of vectors (series_id, side, t, x array). The kernel is a product of sums over the symmetric products of up to three
    components, so that its mean over all pairs comes from their sums over each set, taken in one pass; pairs of a vector with itself are taken off."""
    kind = df.schema["series_id"].dataType.simpleString()
    left = np.array([(i, j, l) for i in range(channels) for j in range(i, channels) for l in range(j, channels)])
    two = np.array([(i, j) for i in range(channels) for j in range(i, channels)])

    def features(x: np.ndarray) -> np.ndarray:
        """Columns whose products sum to the kernel."""
        y = x / np.sqrt(channels)
        ways3 = np.array([6 // {1: 6, 2: 2, 3: 1}[len(set(r))] for r in left.tolist()])
        ways2 = np.where(two[:, 0] == two[:, 1], 1, 2)
        third = y[:, left[:, 0]] * y[:, left[:, 1]] * y[:, left[:, 2]] * np.sqrt(ways3)
        second = y[:, two[:, 0]] * y[:, two[:, 1]] * np.sqrt(3.0 * ways2)
        return np.concatenate([np.ones((len(y), 1)), np.sqrt(3.0) * y, second, third], axis=1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def full() -> pd.DataFrame:
            rows = [(name, one, c, total[at : at + SLICE]) for (_, one), (name, total) in held.items() for c, at in enumerate(range(0, len(total), SLICE))]
            return pd.DataFrame(rows, columns=["series_id", "side", "c", "part"])

        for batch in batches:
            for (key, one), own in batch.groupby(["key", "side"], sort=False):
                x = np.array([np.asarray(v, float) for v in own["x"]])
                total = np.concatenate([[len(x), (((x * x).sum(axis=1) / channels + 1) ** 3).sum()], sum(features(x[at : at + 128]).sum(axis=0) for at in range(0, len(x), 128))])
                name, before = held.get((key, one), (own["series_id"].iloc[0], 0.0))
                held[key, one] = name, before + total
            if len(held) > 64:
                yield full()
                held = {}
        if held:
            yield full()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "side": pdf["side"].iloc[:1], "c": pdf["c"].iloc[:1], "part": [np.sum(np.stack(pdf["part"].to_numpy()), axis=0)]})

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.concatenate([np.zeros(0), *pdf[pdf["side"] == s].sort_values("c")["part"]]) for s in (0, 1)]
        if min(map(len, sides)) == 0 or min(s[0] for s in sides) < 2:
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "kid": [None]})
        (n, own, *one), (m, other, *two_) = sides
        x, y = np.array(one), np.array(two_)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "kid": [(x @ x - own) / (n * (n - 1)) + (y @ y - other) / (m * (m - 1)) - 2 * (x @ y) / (n * m)]})

    rows = df.select("series_id", F.col(side).cast("int").alias("side"), "x", F.xxhash64("series_id").alias("key"))
    parts = rows.mapInPandas(sums, f"series_id {kind}, side int, c int, part array<double>")
    parts = parts.groupBy("series_id", "side", "c").applyInPandas(added, f"series_id {kind}, side int, c int, part array<double>")
    return parts.groupBy("series_id").applyInPandas(distance, f"series_id {kind}, kid double")


def warped(x: np.ndarray, y: np.ndarray, band: int) -> float:
    """Cost of the best warping path, one anti-diagonal of the table after the other: its cells depend on the two before only."""
    n, m = len(x), len(y)
    table = [np.full(n + 1, np.inf), np.full(n + 1, np.inf)]  # by the place in x, for the diagonals i + j = d - 2 and d - 1
    table[0][0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        i = i[np.abs(2 * i - d) <= band]
        new = np.full(n + 1, np.inf)
        new[i] = (x[i - 1] - y[d - i - 1]) ** 2 + np.minimum(np.minimum(table[1][i - 1], table[1][i]), table[0][i - 1])
        table = [table[1], new]
    return float(table[1][n]) ** 0.5


def dtw(pairs: DataFrame, band: int) -> DataFrame:
    """Dynamic time warping distance (root of summed squares) of two series in a band, for each pair
    (pair_id, t, x, y). Series are bounded by their length; scale comes from the number of pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame([{"pair_id": pdf["pair_id"].iloc[0], "dtw": warped(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), band)}])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.groupBy("pair_id").applyInPandas(run, f"pair_id {kind}, dtw double")


def nearest(df: DataFrame, k: int) -> DataFrame:
    """Distance to the k nearest other vectors of the same series (series_id, t, x): series_id, t, u, d, rank. Exact, by the cells of neighbours.py."""
    found = k_nearest(df.select("series_id", "t", "x", F.lit(k + 1).alias("k")), df.select("series_id", F.col("t").alias("u"), F.col("x").alias("y"))).where("t <> u")
    order = Window.partitionBy("series_id", "t").orderBy("d", "u")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_entropy(df: DataFrame, channels: int) -> DataFrame:
    """Nearest-neighbour estimate of the entropy up to a constant: d · mean(ln r) + ln(n - 1)."""
    return nearest(df, 1).groupBy("series_id").agg((channels * F.avg(F.ln("d")) + F.ln(F.count("*") - 1)).alias("entropy"))


def info_nce(df: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Contrastive loss of two aligned vectors (series_id, t, x, y): each x against all y of its series, its own
    y being the positive; the log-sum is stable."""
    kinds = [df.schema[c].dataType.simpleString() for c in ("series_id", "t")]
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())

    def run(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        x, y, out = stacked(rows["x"]), stacked(others["y"]), []
        t, u = rows["t"].to_numpy(), others["u"].to_numpy()
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ y.T / temperature
            top = s.max(axis=1)
            own = np.where(t[at : at + 512, None] == u, s, -np.inf).max(axis=1)
            out.append(pd.DataFrame({"t": t[at : at + 512], "top": top, "own": own, "z": np.exp(s - top[:, None]).sum(axis=1)}))
        return pd.concat(out).assign(series_id=rows["series_id"].iloc[0])[["series_id", "t", "top", "own", "z"]]

    a, b = df.where(whole("x")).select("series_id", "t", "x"), df.where(whole("y")).select("series_id", F.col("t").alias("u"), "y")
    parts = blocks(a, b, ("t", "u"), run, f"series_id {kinds[0]}, t {kinds[1]}, top double, own double, z double")
    logs = parts.groupBy("series_id", "t").agg(F.max("top").alias("top"), F.max("own").alias("own"), F.collect_list(F.struct("top", "z")).alias("_z"))
    total = F.aggregate("_z", F.lit(0.0), lambda s, p: s + p["z"] * F.exp(p["top"] - F.col("top")))
    own = F.when(F.col("own") > float("-inf"), F.col("own"))
    return logs.groupBy("series_id").agg(F.avg(F.col("top") + F.ln(total) - own).alias("loss"))


def sample_quality(df: DataFrame, side: str, k: int) -> DataFrame:
    """Precision, recall, density and coverage of generated (side 1) against real (side 0) vectors (series_id, side, t, x), from the distances to the k-th
    nearest of the own side: the share of generated vectors within a real one's radius, the share of real ones within a generated one's, the mean number of real radii
    that hold a generated vector over k, and the share of real radii that hold one. All pairs within a series: for bounded series."""
    kinds = [df.schema[c].dataType.simpleString() for c in ("series_id", side, "t")]
    points = df.where(F.col(side).isNotNull() & F.col("t").isNotNull()).select("series_id", F.col(side).alias("s"), "t", "x")
    key, kind = F.struct("series_id", "s").alias("series_id"), f"struct<series_id:{kinds[0]},s:{kinds[1]}>"

    def least(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """The k least distances of each vector to others of its side, null ones first."""
        y, t, u, out = stacked(others["y"]), rows["t"].to_numpy(), others["u"].to_numpy(), []
        x = stacked(rows["x"], y.shape[1])
        for part, far in each_slice(x, y):
            far = np.where(np.isnan(far), -np.inf, far)
            far[t[part][:, None] == u] = np.inf
            i, j = least_of(far, u, k)
            out.append(pd.DataFrame({"t": t[part][i], "d": far[i, j]}))
        return pd.concat(out).assign(series_id=[rows["series_id"].iloc[0]] * sum(map(len, out)))[["series_id", "t", "d"]]

    own = points.select(key, "t", "x")
    near = blocks(own, own.select("series_id", F.col("t").alias("u"), F.col("x").alias("y")), ("t", "u"), least, f"series_id {kind}, t {kinds[2]}, d double")
    radii = near.groupBy("series_id", "t").agg(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1)).alias("radius")).where(F.col("radius") > float("-inf"))
    radii = settled(radii.select("series_id.series_id", "series_id.s", "t", "radius"))

    def inside(balls: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Of each ball and each vector of the other side, how many of the other kind it holds, or lies in."""
        y, radius, of, held = stacked(others["y"]), balls["radius"].to_numpy()[:, None], [], np.zeros(len(others), int)
        for part, far in each_slice(stacked(balls["x"], y.shape[1]), y):
            hits = far <= radius[part]
            of.append(hits.sum(axis=1))
            held += hits.sum(axis=0)
        out = pd.DataFrame({"t": np.concatenate([balls["t"], others["u"]]), "ball": np.arange(len(balls) + len(others)) < len(balls), "n": np.concatenate([*of, held])})
        return out.assign(series_id=balls["series_id"].iloc[0], s=balls["s"].iloc[0])[["series_id", "s", "t", "ball", "n"]]

    given = points.where(F.col("x").isNotNull())
    balls, out = given.join(radii, ["series_id", "s", "t"]), None
    for one in (0, 1):
        met = blocks(balls.where(F.col("s") == one), given.where(F.col("s") == 1 - one).select("series_id", F.col("t").alias("u"), F.col("x").alias("y")), ("t", "u"), inside, f"series_id {kinds[0]}, s int, t {kinds[2]}, ball boolean, n long")
        out = met if out is None else out.union(met)
    counts = out.groupBy("series_id", "s", "ball", "t").agg(F.sum("n").alias("n"), F.max((F.col("n") > 0).cast("int")).alias("any"))
    of = lambda s, ball, c: F.avg(F.when((F.col("s") == s) & (F.col("ball") == ball), F.col(c)))
    found = counts.groupBy("series_id").agg(of(0, False, "any").alias("precision"), of(1, False, "any").alias("recall"), (of(0, False, "n") / k).alias("density"), of(0, True, "any").alias("coverage"))
    return found.where("precision IS NOT NULL AND recall IS NOT NULL")


def feature_distances(left: DataFrame, right: DataFrame, projections: int, seed: int = 1) -> DataFrame:
    """series_id, a, b, sgw for every pair of features of two sides (series_id, name, t, ch, v): the sliced Gromov-Wasserstein distance, for
    each series."""
    pairs = left.select("series_id", F.col("name").alias("a")).distinct().join(right.select("series_id", F.col("name").alias("b")).distinct(), "series_id")
    x = left.withColumnRenamed("name", "a").join(pairs, ["series_id", "a"]).withColumn("side", F.lit(0))
    y = right.withColumnRenamed("name", "b").join(pairs, ["series_id", "b"]).withColumn("side", F.lit(1))
    both = x.unionByName(y).select(F.struct("series_id", "a", "b").alias("series_id"), "side", "t", "ch", "v")
    return sliced_gromov_wasserstein(both, "side", projections, seed).select("series_id.*", "sgw")


def pooled_distances(left: DataFrame, right: DataFrame, projections: int, seed: int = 1) -> DataFrame:
    """a, b, sgw for every pair of features of two sides (series_id, name, t, ch, v), over the frames of all series together: each channel scaled to 0 to 1 over all of them, each feature
    projected and ranked once (over sorted ranges), and features met by rank, of which only sums are kept. Both sides have the same frames."""
    ranked = []
    for df in (left, right):
        span = df.groupBy("name", "ch").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))  # a row for each channel of the schema
        unit = df.join(F.broadcast(span), ["name", "ch"]).withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)))
        rows = unit.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(projections - 1))))
        weight = lcg(lcg(F.col("ch") * 1009 + F.col("k"), seed) + 7919, seed) / F.lit(2147483648.0) - 0.5
        points = rows.groupBy("name", "k", "series_id", "t").agg(F.sum(F.col("v") * weight).alias("p"))
        ranked.append(settled(placed(points, ["name", "k"], ["p", "series_id", "t"], "up", "n").select("name", "k", "up", (F.col("n") - 1 - F.col("up")).alias("down"), "p")))
    x = ranked[0].select("k", F.col("up").alias("r"), F.col("name").alias("a"), F.col("p").alias("x"))
    costs = [_coupled(x.join(ranked[1].select("k", F.col(way).alias("r"), F.col("name").alias("b"), F.col("p").alias("y")), ["k", "r"]), ["a", "b", "k"], way) for way in ("up", "down")]
    return costs[0].join(costs[1], ["a", "b", "k"]).groupBy("a", "b").agg(F.avg(F.least("up", "down")).alias("sgw"))


def comparison(groups: DataFrame, projections: int, band: int, bins: int, sigma: float) -> DataFrame:
    """corpus, n, sgw, dtw_low, dtw_mid, dtw_mean, dtw_high and information of paired series (corpus, series_id, t, x, y): a table that shows how
    much closer aligned series are than misaligned ones, when both are given as corpora."""
    key = groups.select(F.struct("corpus", "series_id").alias("series_id"), "t", "x", "y")
    sides = key.select("series_id", F.lit(0).alias("side"), "t", F.lit(0).alias("ch"), F.col("x").alias("v")).unionByName(key.select("series_id", F.lit(1).alias("side"), "t", F.lit(0).alias("ch"), F.col("y").alias("v")))
    gromov = sliced_gromov_wasserstein(sides, "side", projections)
    warp = dtw(key.withColumnRenamed("series_id", "pair_id"), band).withColumnRenamed("pair_id", "series_id")
    shared = mutual_information(key, bins, sigma)
    met = gromov.join(warp, "series_id").join(shared, "series_id")
    return met.groupBy(F.col("series_id.corpus").alias("corpus")).agg(
        F.count("*").alias("n"), F.avg("sgw").alias("sgw"), F.min("dtw").alias("dtw_low"), F.median("dtw").alias("dtw_mid"), F.avg("dtw").alias("dtw_mean"), F.max("dtw").alias("dtw_high"), F.sum("mi").alias("information")
    )


def sensitivity(df: DataFrame, target: DataFrame, blocks: dict[str, tuple[int, int]], kinds: tuple[str, ...], trials: int, projections: int) -> DataFrame:
    """block, kind, mean, std, t and dof: how far the distance between two sets of channels (series_id, t, ch, v) moves when a block of channels of the first is perturbed.
    Each trial draws other projections; Student's t compares the trials with those of the unchanged channels."""
    tries = [("", "reference", 0, 0)] + [(block, kind, low, high) for block, (low, high) in blocks.items() for kind in kinds]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(k).alias("kind"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for b, k, lo, hi in tries]))
    wanted, out = target.withColumn("_c", each).select("series_id", "_c.block", "_c.kind", F.lit(1).alias("side"), "t", "ch", "v"), None
    for trial in range(trials):
        noise = lcg(lcg(F.col("t") * 1009 + F.col("ch"), trial + 1) + 7919, 3) / F.lit(2147483648.0)
        inside = (F.col("ch") >= F.col("_c.low")) & (F.col("ch") < F.col("_c.high"))
        kind = F.col("_c.kind")
        value = F.when(kind == "zero", 0.0).when(kind == "negate", -F.col("v")).when(kind == "double", 2 * F.col("v")).when(kind == "random", noise).otherwise(F.col("v"))
        rows = df.withColumn("_c", each).select("series_id", "_c.block", "_c.kind", F.lit(0).alias("side"), "t", "ch", F.when(inside, value).otherwise(F.col("v")).alias("v"))
        keyed = rows.unionByName(wanted).select(F.struct("series_id", "block", "kind").alias("series_id"), "side", "t", "ch", "v")
        one = sliced_gromov_wasserstein(keyed, "side", projections, seed=trial + 1).groupBy(F.col("series_id.block").alias("block"), F.col("series_id.kind").alias("kind")).agg(F.avg("sgw").alias("v")).withColumn("trial", F.lit(trial))
        out = one if out is None else out.unionByName(one)
    out = settled(out)
    reference = out.where("kind = 'reference'").select("v")
    own = out.where("kind <> 'reference'")
    both = own.select("block", "kind", F.lit(1).alias("side"), "v").unionByName(own.select("block", "kind").distinct().crossJoin(F.broadcast(reference)).select("block", "kind", F.lit(0).alias("side"), "v"))
    stats = own.groupBy("block", "kind").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return stats.join(t_statistic(both, ["block", "kind"], "side", "v"), ["block", "kind"])


def subseries(series: DataFrame, longest: int, negatives: int, seed: int = 3) -> DataFrame:
    """Stretches for a triplet loss, drawn by ids: series_id, role ('anchor', 'positive' or 'negative'), k, source (the series that it comes from), start and length. The positive lies
    within its anchor; negatives have its length and come from series drawn from all, by a random order in which each is followed by the next ones."""
    ends = series.groupBy("series_id").agg(F.count("*").alias("n"))
    draw = lambda k, span: F.floor(uniform(F.col("series_id") * 31 + k, seed) * span).cast("int")
    least = F.least(F.lit(longest), F.col("n")).cast("int")
    rows = ends.withColumn("_most", least).withColumn("_short", draw(1, F.col("_most")) + 1)
    rows = rows.withColumn("_long", F.col("_short") + draw(2, F.col("_most") - F.col("_short") + 1)).withColumn("_from", draw(3, F.col("_most") - F.col("_long") + 1))
    rows = rows.withColumn("_place", F.col("_from") + draw(4, F.col("_long") - F.col("_short") + 1))
    anchors = rows.select("series_id", F.lit("anchor").alias("role"), F.lit(0).alias("k"), F.col("series_id").alias("source"), F.col("_from").alias("start"), F.col("_long").alias("length"))
    positives = rows.select("series_id", F.lit("positive").alias("role"), F.lit(0).alias("k"), F.col("series_id").alias("source"), F.col("_place").alias("start"), F.col("_short").alias("length"))
    order = placed(rows.select("series_id", "n", uniform(F.col("series_id"), seed + 1).alias("_u")), [], ["_u", "series_id"], "_r", "_all")
    size = rows.count()
    asked = rows.join(order.select("series_id", "_r"), "series_id").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(negatives)))).withColumn("_r", F.pmod(F.col("_r") + F.col("k") * (1 + size // (negatives + 1)), F.lit(size)))
    met = asked.join(order.select("_r", F.col("series_id").alias("source"), F.col("n").alias("_n")), "_r")
    length = F.least("_short", "_n").cast("int")
    start = F.floor(uniform(F.col("series_id") * 31 + 7 * F.col("k"), seed + 2) * (F.col("_n") - length + 1)).cast("int")
    return anchors.unionByName(positives).unionByName(met.select("series_id", F.lit("negative").alias("role"), "k", "source", start.alias("start"), length.alias("length")))


def triplet_loss(vectors: DataFrame, penalty: float = 1.0) -> DataFrame:
    """series_id, loss: logistic loss of given vectors (series_id, role, k, x): -ln σ(anchor · positive) and the mean of -ln σ(-anchor · negative) times a penalty."""
    own = vectors.where("role = 'anchor'").select("series_id", F.col("x").alias("_a"))
    met = vectors.where("role <> 'anchor'").join(own, "series_id")
    dot = F.aggregate(F.zip_with("x", "_a", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    loss = F.log1p(F.exp(F.when(F.col("role") == "positive", -dot).otherwise(dot)))
    parts = met.withColumn("_l", loss).groupBy("series_id").agg(F.avg(F.when(F.col("role") == "positive", F.col("_l"))).alias("p"), F.avg(F.when(F.col("role") == "negative", F.col("_l"))).alias("n"))
    return parts.select("series_id", (F.col("p") + penalty * F.coalesce("n", F.lit(0.0))).alias("loss"))


def aligned_windows(series: DataFrame, patches: int, length: int, seed: int = 4) -> DataFrame:
    """Frames of random windows of each series (series_id, name, t, v), the same for all features of a series: series_id, patch, name, t_rel, v. A frame goes
    to the windows that hold it."""
    ends = series.groupBy("series_id").agg((F.max("t") + 1).alias("_n")).where(F.col("_n") > length)
    starts = ends.withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(patches - 1))))
    starts = starts.select("series_id", "patch", F.floor(uniform(F.col("series_id") * 1009 + F.col("patch"), seed) * (F.col("_n") - length)).cast("int").alias("_s"))
    met = starts.withColumn("t_rel", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("t", F.col("_s") + F.col("t_rel"))
    return met.join(series, ["series_id", "t"]).select("series_id", "patch", "name", "t_rel", "v")
