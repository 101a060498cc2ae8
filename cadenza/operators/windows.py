"""Window operators over long series: differences, smoothing, ranks and runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def in_order():
    """The frames of each series in order."""
    return Window.partitionBy("series_id").orderBy("t")

def whole():
    """All frames of each series."""
    return Window.partitionBy("series_id")



def difference(value: str = "v") -> Column:
    """Next value minus this one; the last frame repeats the difference before it."""
    step = F.lead(value).over(in_order()) - F.col(value)
    return F.coalesce(step, F.col(value) - F.lag(value).over(in_order()))


def flux(value: str = "v") -> Column:
    """Next value minus this one, with a zero after the end."""
    return F.lead(value, 1, 0.0).over(in_order()) - F.col(value)


def onset_strength(df: DataFrame, shift: int = 2, how: str = "avg") -> DataFrame:
    """series_id, t, v: rises of each channel (series_id, ch, t, v), averaged over channels and moved
    `shift` frames to the right, zeros before."""
    by = Window.partitionBy("series_id", "ch").orderBy("t")
    rise = F.greatest(F.col("v") - F.lag("v").over(by), F.lit(0.0))
    mean = {"avg": F.avg, "median": F.median}[how]("_r").alias("v")
    rows = df.withColumn("_r", F.coalesce(rise, F.lit(0.0))).groupBy("series_id", "t").agg(mean)
    return rows.withColumn("v", F.lag("v", shift, 0.0).over(in_order()))


def reflected(t: Column, n: Column) -> Column:
    """Index reflected at both ends without repeating the edge frame."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(t, period)
    return F.least(m, period - m)


def extended(series: DataFrame, before: int, after: int, place) -> DataFrame:
    """series with frames before its start and after its end: frame t there holds the value of frame place(t, n), n being the
    series' length (null, or no place: zero); `_own` tells its own frames from these. The new frames take their values from an array of those near the ends, which is
    built where the series lies: they are not joined, since Spark would take the ends of all series for a small table and broadcast them."""
    if not before and not after:
        return series.select("series_id", F.col("t").cast("int").alias("t"), "v", F.lit(True).alias("_own"))
    reach = max(before, after)  # no place is farther from both ends
    rows = series.select("series_id", F.col("t").cast("int").alias("t"), "v").withColumn("_n", F.count("*").over(whole()))
    near = F.when((F.col("t") <= reach) | (F.col("t") >= F.col("_n") - 1 - reach), F.struct("t", "v")) if place else F.lit(None).cast("struct<t:int,v:double>")
    ends = rows.groupBy("series_id").agg(F.first("_n").alias("_n"), F.collect_list(near).alias("_held"))
    ends = ends.withColumn("_at", F.transform("_held", lambda r: r["t"]))
    parts = [F.sequence(F.lit(-before), F.lit(-1))] * (before > 0) + [F.transform(F.sequence(F.lit(0), F.lit(after - 1)), lambda k: (k + F.col("_n")).cast("int"))] * (after > 0)
    source = lambda t: (place(t, F.col("_n")) if place else F.lit(None)).cast("int")
    frame = lambda t, r: F.struct(t.alias("t"), F.coalesce(r["v"], F.lit(0.0)).alias("v"))
    one = F.transform(F.concat(*parts), lambda t: frame(t, F.get("_held", (F.array_position("_at", source(t)) - 1).cast("int"))))
    found = lambda t: F.filter("_held", lambda r: r["t"] == source(t))
    many = F.flatten(F.transform(F.concat(*parts), lambda t: F.when(F.size(found(t)) > 0, F.transform(found(t), lambda r: frame(t, r))).otherwise(F.array(F.struct(t.alias("t"), F.lit(0.0).alias("v"))))))
    none = F.transform(F.concat(*parts), lambda t: F.struct(t.alias("t"), F.lit(0.0).alias("v")))
    repeated = F.size("_at") > F.size(F.array_distinct("_at"))
    new = ends.select("series_id", F.explode(F.when(F.col("series_id").isNull(), none).when(repeated, many).otherwise(one)).alias("_e"))
    return rows.select("series_id", "t", "v", F.lit(True).alias("_own")).unionByName(new.select("series_id", "_e.t", "_e.v", F.lit(False).alias("_own")))


def moving_median(series: DataFrame, k: int, beside: str | None = None) -> DataFrame:
    """Lower median of k (odd) frames around each, reflected at the ends: one window over the series. beside: a further column with the frame's own value."""
    half = k // 2
    rows = extended(series, half, half, reflected)
    around = in_order().rowsBetween(-half, half)
    rows = rows.withColumn("_m", F.get(F.array_sort(F.collect_list("v").over(around)), F.lit((k - 1) // 2))).where("_own")
    return rows.select("series_id", "t", F.col("_m").alias("v"), *([F.col("v").alias(beside)] if beside else []))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights out to four sigmas, with the sum 1."""
    radius = int(4 * sigma)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    return [(o - radius, w / sum(raw)) for o, w in enumerate(raw)]


def convolve(series: DataFrame, kernel: list[tuple[int, float]], mode: str = "circular", reach: int | None = None) -> DataFrame:
    """Weighted sum of the frames at the kernel's offsets (ascending); beyond the ends frames go round (circular), are
    reflected, repeat the edge (replicate), or count as zero (zero). One window over each series gathers the kernel's frames.

    reach: weights are cut at so many times a series' length, and the rest divided by their sum; of a circular series that is
    shorter than the kernel, the edge is repeated beyond one turn."""
    low, high = min(o for o, _ in kernel), max(o for o, _ in kernel)
    held = dict(kernel)
    weights = F.array(*[F.lit(float(held.get(o, 0.0))) for o in range(low, high + 1)])

    def circular(t: Column, n: Column) -> Column:
        turn = F.pmod(t, n)
        if reach is None:
            return turn
        return F.when((F.least(F.lit(high), reach * n) > n) & (t < -n), 0).when((F.least(F.lit(high), reach * n) > n) & (t >= 2 * n), n - 1).otherwise(turn)

    place = {"circular": circular, "reflect": reflected, "replicate": lambda t, n: F.least(F.greatest(t, F.lit(0)), n - 1), "zero": None}[mode]
    rows = extended(series, max(0, -low), max(0, high), place).withColumn("_x", F.collect_list("v").over(in_order().rowsBetween(low, high)))
    if reach is not None:
        rows = rows.withColumn("_n", F.count(F.when(F.col("_own"), 1)).over(whole()))
    rows = rows.where("_own")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda p, q: p + q)
    if reach is None:
        value = total(F.zip_with("_x", weights, lambda x, w: x * w))
    else:
        wide = F.least(F.lit(high), reach * F.col("_n")).cast("int")
        cut = lambda x: F.slice(x, high - wide + 1, 2 * wide + 1)
        value = total(F.zip_with(cut(F.col("_x")), cut(weights), lambda x, w: x * w)) / total(cut(weights))
    return rows.select("series_id", "t", value.alias("v"))


def gaussian(series: DataFrame, sigma: float, mode: str = "circular") -> DataFrame:
    """Gaussian smoothing out to four sigmas, and three times a series' length at most."""
    return convolve(series, gaussian_kernel(sigma), mode, 3)


def causal_hann(series: DataFrame, width: int) -> DataFrame:
    """Smoothing by the falling half of a Hann window over this frame and those before it."""
    raw = [0.5 + 0.5 * math.cos(math.pi * k / width) for k in range(width)]
    return convolve(series, [(-k, raw[k] / sum(raw)) for k in range(width - 1, -1, -1)], "replicate")


def whiten(df: DataFrame, by: list[str], order: str, half: int) -> DataFrame:
    """Moving average subtracted, clipped at zero."""
    around = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("v", F.greatest(F.col("v") - F.avg("v").over(around), F.lit(0.0)))


def salience(series: DataFrame, short: float = 5.0, long: float = 80.0) -> DataFrame:
    """Each value times the squared ratio of a short and a long smoothing."""
    a, b = gaussian(series, short).withColumnRenamed("v", "_a"), gaussian(series, long).withColumnRenamed("v", "_b")
    met = series.join(a, ["series_id", "t"]).join(b, ["series_id", "t"])
    return met.select("series_id", "t", (F.pow(F.try_divide("_a", "_b"), F.lit(2.0)) * F.col("v")).alias("v"))


def ordinal_rank(value: str, tie: str, window) -> Column:
    """1, 2, ... in the order of the values, ties in the order of `tie`."""
    return F.row_number().over(window.orderBy(value, tie))


def max_rank(value: str, window) -> Column:
    """Number of values that are no greater."""
    return F.count("*").over(window.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))


def runs(series: DataFrame, label: str) -> DataFrame:
    """series with `run`, the number of changes of the label so far."""
    change = F.coalesce((F.col(label) != F.lag(label).over(in_order())).cast("int"), F.lit(0))
    return series.withColumn("_c", change).withColumn("run", F.sum("_c").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def cumulative_share(value: str = "v") -> Column:
    """Running sum over the sum of the whole series."""
    return F.try_divide(F.sum(value).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(whole()))


def circular_shift(series: DataFrame, by: int) -> DataFrame:
    """Frames moved to the right, those beyond the end to the start."""
    return series.withColumn("t", F.pmod(F.col("t") + by, F.count("*").over(whole())).cast("int"))


def parabolic_peak(value: str, window) -> tuple[Column, Column]:
    """Offset (-0.5 to 0.5) and height of the parabola's top through a frame and its neighbours."""
    a, b, c = F.lag(value).over(window), F.col(value), F.lead(value).over(window)
    shift = F.coalesce(0.5 * F.try_divide(a - c, a - 2 * b + c), F.lit(0.0))
    return shift, b - 0.25 * (F.coalesce(a - c, F.lit(0.0))) * shift


def delayed(series: DataFrame, first: float) -> DataFrame:
    """Values one frame later, with a given first one."""
    return series.withColumn("v", F.lag("v", 1, first).over(in_order()))


def sheared(cells: DataFrame) -> DataFrame:
    """Cells (series_id, i, j, …) of a matrix by diagonal: lag = j - i in place of j."""
    return cells.withColumn("lag", (F.col("j") - F.col("i")).cast("int")).drop("j")


def unsheared(cells: DataFrame) -> DataFrame:
    """The inverse of sheared()."""
    return cells.withColumn("j", (F.col("i") + F.col("lag")).cast("int")).drop("lag")


def diagonal_median(cells: DataFrame, k: int = 7) -> DataFrame:
    """Lower median of k cells along each diagonal of a whole matrix (series_id, i, j, v), reflected at the ends of the diagonal."""
    by, half = Window.partitionBy("series_id", "lag"), k // 2
    order = by.orderBy("i")
    # a cell's window reflects onto itself, so that one window over each diagonal holds all that is needed: nothing is joined, and cells that lie by series stay there
    rows = sheared(cells.where("series_id IS NOT NULL")).withColumns({"_q": F.row_number().over(order) - 1, "_n": F.count("*").over(by), "_x": F.collect_list(F.struct("v")).over(order.rowsBetween(-half, half))})
    low = F.greatest(F.col("_q") - half, F.lit(0))
    own = lambda o: F.get("_x", (reflected(F.col("_q") + o, F.col("_n")) - low).cast("int"))["v"]
    near = F.array(*[F.when((F.col("_q") + o >= 0) & (F.col("_q") + o < F.col("_n")), own(o)).otherwise(F.coalesce(own(o), F.lit(0.0))) for o in range(-half, half + 1)])
    return unsheared(rows.select("series_id", "lag", "i", F.get(F.array_sort(F.array_compact(near)), F.lit((k - 1) // 2)).alias("v"))).select("series_id", "i", "j", "v")
