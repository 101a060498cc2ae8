"""Scalar and per-series functions over Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def whole():
    """All frames of each series."""
    return Window.partitionBy("series_id")

EPS = 1e-8


def minmax(value: str = "v", window=None, eps: float = EPS) -> Column:
    """Scaled to 0..1 over a partition, with a guard against constant series."""
    window = window or whole()
    low = F.min(value).over(window)
    return (F.col(value) - low) / (F.max(value).over(window) - low + eps)


def quantile_bounds(df: DataFrame, by: list[str], low: float, high: float, value: str = "v") -> DataFrame:
    """Two linear quantiles of each group: _low, _high."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("_low"), F.percentile(value, F.lit(high)).alias("_high"))


def clamp(df: DataFrame, by: list[str], low: float | None, high: float | None, value: str = "v") -> DataFrame:
    """Values beyond a quantile of their group set to it; None leaves a side open."""
    met = df.join(quantile_bounds(df, by, low or 0.0, 1.0 if high is None else high, value), by)
    return met.withColumn(value, F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))).drop("_low", "_high")


def standardize(df: DataFrame, by: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Clamped to the quartiles, then scaled to 0..1."""
    return clamp(df, by, low, high).withColumn("v", minmax("v", Window.partitionBy(*by)))


def clamp_to_peaks(series: DataFrame, share: float) -> DataFrame:
    """Clamped to a quantile of the series' own local maxima; series without any stay as they are."""
    order = Window.partitionBy("series_id").orderBy("t")
    peak = (F.col("v") > F.lag("v").over(order)) & (F.col("v") > F.lead("v").over(order))
    marked = series.withColumn("_peak", F.when(peak, F.col("v")))
    bounds = marked.groupBy("series_id").agg(F.percentile("_peak", F.lit(share)).alias("_bound"))
    return series.join(bounds, "series_id").withColumn("v", F.least("v", F.coalesce("_bound", "v"))).drop("_bound")


def envelope(series: DataFrame, share: float) -> DataFrame:
    """clamp_to_peaks(), floored at 0 and divided by the maximum."""
    rows = clamp_to_peaks(series, share).withColumn("v", F.greatest("v", F.lit(0.0)))
    return rows.withColumn("v", F.try_divide(F.col("v"), F.max("v").over(whole())))


def emphasize(series: DataFrame, strength: float, share: float) -> DataFrame:
    """x (1 + tanh(s (x - q))) on the 0..1 scale, q a quantile there, scaled back."""
    low, high = F.min("v").over(whole()), F.max("v").over(whole())
    rows = series.withColumn("_low", low).withColumn("_high", high).withColumn("_x", F.try_divide(F.col("v") - F.col("_low"), F.col("_high") - F.col("_low")))
    cut = rows.groupBy("series_id").agg(F.percentile("_x", F.lit(share)).alias("_q"))
    rows = rows.join(cut, "series_id").withColumn("_y", F.col("_x") * (1 + F.tanh(strength * (F.col("_x") - F.col("_q")))))
    rows = rows.withColumn("_y", F.try_divide(F.col("_y") - F.min("_y").over(whole()), F.max("_y").over(whole()) - F.min("_y").over(whole())))
    return rows.withColumn("v", F.col("_y") * (F.col("_high") - F.col("_low")) + F.col("_low")).drop("_low", "_high", "_x", "_q", "_y")


def norm(kind: str, by: list[str], value: str = "v") -> Column:
    """Divided by the L1, L2 or maximum norm of its row; null for a zero row."""
    row = Window.partitionBy(*by)
    size = {"l1": F.sum(F.abs(value)).over(row), "l2": F.sqrt(F.sum(F.col(value) * F.col(value)).over(row)), "max": F.max(F.abs(value)).over(row)}[kind]
    return F.try_divide(F.col(value), size)


def decibel(df: DataFrame, value: str = "v", floor: float = 1e-10, span: float = 80.0) -> DataFrame:
    """Power in decibels, at most `span` below the maximum of all rows (found by one aggregate)."""
    rows = df.withColumn(value, 10 * F.log10(F.greatest(F.col(value), F.lit(floor))))
    return rows.crossJoin(F.broadcast(rows.agg(F.max(value).alias("_top")))).withColumn(value, F.greatest(F.col(value), F.col("_top") - span)).drop("_top")


def hz_to_mel(f: Column, htk: bool = False) -> Column:
    """Slaney's scale (linear below 1 kHz), or the HTK formula."""
    if htk:
        return 2595.0 * F.log10(1 + f / 700.0)
    return F.when(f >= 1000.0, 15.0 + F.ln(f / 1000.0) * (27.0 / math.log(6.4))).otherwise(f * 3.0 / 200.0)


def mel_to_hz(m: Column, htk: bool = False) -> Column:
    """The inverse of hz_to_mel()."""
    if htk:
        return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)
    return F.when(m >= 15.0, 1000.0 * F.exp((m - 15.0) * (math.log(6.4) / 27.0))).otherwise(m * 200.0 / 3.0)


def hz_to_octave(f: Column, a4: float = 440.0) -> Column:
    """Octaves above a sixteenth of the concert pitch."""
    return F.log2(f / (a4 / 16.0))


def hz_to_midi(f: Column, a4: float = 440.0) -> Column:
    """MIDI note number."""
    return 12.0 * F.log2(f / a4) + 69.0


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of a colour, by the Rec. 601 weights."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0..1), saturation and value of a colour in 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    gap = high - low
    hue = F.when(gap == 0, 0.0).when(high == r, (g - b) / gap).when(high == g, (b - r) / gap + 2.0).otherwise((r - g) / gap + 4.0)
    return F.when(gap == 0, 0.0).otherwise((hue / 6.0) - F.floor(hue / 6.0)), F.coalesce(F.try_divide(gap, high), F.lit(0.0)), high


def soft_mask(x: Column, y: Column, power: float = 2.0, split_zeros: bool = True) -> Column:
    """Share of x in x and y, both to a power; where both are 0, a half (or 0)."""
    z = F.greatest(x, y)
    a, b = F.pow(x / z, F.lit(power)), F.pow(y / z, F.lit(power))
    return F.when(z <= 0, 0.5 if split_zeros else 0.0).otherwise(a / (a + b))


def contrast(x: Column, amount: float = 75.0) -> Column:
    """Contrast enhancement: sin(a + c sin 4a) with a = x pi / 2 and c = amount / 750."""
    a = x * (math.pi / 2)
    return F.sin(a + (amount / 750.0) * F.sin(4 * a))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Magnitude and angle."""
    return F.hypot(x, y), F.atan2(y, x)


def dot(x: Column, y: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays; null if one is zero."""
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def minkowski(x: Column, y: Column, p: int = 2) -> Column:
    """Minkowski distance of two arrays, 1e-8 added under the root."""
    powers = F.zip_with(x, y, lambda a, b: F.pow(F.abs(a.cast("double") - b.cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(powers, F.lit(0.0), lambda s, v: s + v) + EPS, F.lit(1.0 / p))


def slerp(x: Column, y: Column, part: Column) -> Column:
    """Spherical interpolation of two unit vectors; linear where they are parallel."""
    angle = F.acos(F.least(F.greatest(dot(x, y), F.lit(-1.0)), F.lit(1.0)))
    whole = F.sin(angle)
    a = F.when(whole < 1e-9, 1 - part).otherwise(F.sin((1 - part) * angle) / whole)
    b = F.when(whole < 1e-9, part).otherwise(F.sin(part * angle) / whole)
    return F.zip_with(x, y, lambda p, q: p.cast("double") * a + q.cast("double") * b)


def sample_rows(df: DataFrame, order: Column, k: int) -> DataFrame:
    """k rows, the first in a seeded random order (a distributed top-k)."""
    return df.orderBy(order).limit(k)


def permute_share(series: DataFrame, chosen: Column, key: Column) -> DataFrame:
    """Values of the chosen frames of a series dealt anew among them in the order of a random key."""
    marked = series.withColumn("_c", chosen)
    by = Window.partitionBy("series_id")
    own = marked.where("_c").withColumn("_i", F.row_number().over(by.orderBy("t"))).withColumn("_j", F.row_number().over(by.orderBy(key, "t")))
    dealt = own.select("series_id", "t", "_i").join(own.select("series_id", F.col("_j").alias("_i"), "v"), ["series_id", "_i"]).select("series_id", "t", "v")
    return marked.where("not _c").select("series_id", "t", "v").unionByName(dealt)


def weighted_choice(draws: DataFrame, options: DataFrame, uniform: Column) -> DataFrame:
    """For each draw, an option (option, weight) with its chance; options are few (a fixed list)."""
    order = Window.partitionBy(F.lit(0)).orderBy("option")
    spans = options.withColumn("_to", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy(F.lit(0))))
    spans = spans.withColumn("_from", F.lag("_to", 1, 0.0).over(order))
    return draws.withColumn("_u", uniform).join(spans, (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).drop("_u", "_from", "_to", "weight")


RULES = ("linear", "midpoint", "lower", "higher", "nearest")


def quantiles(df: DataFrame, by: list[str], shares: list[float], how: str | tuple[str, ...] = "linear", value: str = "v") -> DataFrame:
    """Quantiles of each group under one of RULES; null and NaN values don't count. With several rules, a row for each (column `how`). All
    come from one sort of the groups, of which only the rows around the quantiles go on."""
    rules = (how,) if isinstance(how, str) else how
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    order = Window.partitionBy(*by).orderBy(value)
    ranked = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    place = lambda q: q * (F.col("_n") - 1)
    near = F.filter(F.array(*map(F.lit, shares)), lambda q: (F.col("_r") == F.floor(place(q))) | (F.col("_r") == F.ceil(place(q))))
    picked = ranked.withColumn("q", F.explode(near))
    ends = picked.groupBy(*by, "q").agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first("_n").alias("_n"))
    low, high = F.floor(place(F.col("q"))), F.ceil(place(F.col("q")))
    past = place(F.col("q")) - low
    parts = {"linear": past, "midpoint": F.when(low == high, 0.0).otherwise(0.5), "lower": F.lit(0.0), "higher": F.lit(1.0), "nearest": F.when(past > 0.5, 1.0).when(past < 0.5, 0.0).otherwise(low % 2)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("how"), parts[k].cast("double").alias("part")) for k in rules]))
    out = ends.withColumn("_w", each).select(*by, F.col("_w.how").alias("how"), "q", (F.col("_a") * (1 - F.col("_w.part")) + F.col("_b") * F.col("_w.part")).alias("value"))
    return out.drop("how") if isinstance(how, str) else out


def normal(first: Column, second: Column) -> Column:
    """A normal variate from two uniform ones in [0, 1)."""
    return F.sqrt(-2 * F.ln(1 - first)) * F.cos(2 * math.pi * second)


def skew_normal(u: Column, v: Column, shape: float, location: float, scale: float) -> Column:
    """A skew-normal variate from two normal ones: their mix by the shape, turned over where the first is negative."""
    d = shape / math.sqrt(1 + shape * shape)
    mixed = d * u + math.sqrt(1 - d * d) * v
    return location + scale * F.when(u >= 0, mixed).otherwise(-mixed)
