"""Group statistics, histograms and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.tables import lcg


def marginals(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Mean of means along both sides of a matrix in long form, by grouping sets: rows (row, null) and
    (null, column)."""
    cells = df.groupBy(row, column).agg(F.median(value).alias("_m"))
    return cells.groupingSets([[F.col(row)], [F.col(column)]], F.col(row), F.col(column)).agg(F.avg("_m").alias("mean"), F.median("_m").alias("mid"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and density in bins of a fixed range; values outside are left out, the last bin is closed."""
    width = (high - low) / bins
    rows = df.where(F.col(value).between(low, high)).withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * width))


def range_histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts in bins of each group's own range, the last bin closed, and counts over the largest."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")) * bins), F.lit(0))
    counts = df.join(ends, by).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("scaled", F.col("n") / F.max("n").over(Window.partitionBy(*by)))


def confusion(df: DataFrame, target: str, predicted: str, classes: int) -> DataFrame:
    """All cells (target, predicted) with their counts, zeros included."""
    cells = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias(target), (F.col("id") % classes).cast("int").alias(predicted))
    counts = df.groupBy(F.col(target).cast("int").alias(target), F.col(predicted).cast("int").alias(predicted)).agg(F.count("*").alias("n"))
    return cells.join(counts, [target, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def directogram(df: DataFrame, by: list[str], mag: str, ang: str, bins: int) -> DataFrame:
    """Sum of magnitudes by bin of the angle (a full turn is 256 steps); each angle goes to the first bin
    whose centre is at most a bin's width ahead of it, modulo 256."""
    width = 256 // bins
    centres = F.array(*[F.lit(i * width + width // 2) for i in range(bins)])
    first = F.array_position(F.transform(centres, lambda c: F.pmod(c - F.col(ang), F.lit(256)) <= width), True) - 1
    return df.withColumn("bin", first).groupBy(*by, "bin").agg((F.sum(mag) / 255).alias("v"))


def laplace_fit(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Location (median) and scale (mean distance from it)."""
    mid = df.groupBy(*by).agg(F.median(value).alias("location"))
    return df.join(mid, by).groupBy(*by).agg(F.first("location").alias("location"), F.avg(F.abs(F.col(value) - F.col("location"))).alias("scale"))


def t_statistic(df: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """Student's t of side = 0 against side = 1 with pooled variance, and its degrees of freedom."""
    part = lambda f, k: f(F.when(F.col(side) == k, F.col(value)))
    sums = df.groupBy(*by).agg(*[part(f, k).alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "s"))])
    df_ = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("s0") + (F.col("n1") - 1) * F.col("s1")) / df_
    t = (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return sums.select(*by, t.alias("t"), df_.alias("dof"))


def bootstrap_median(df: DataFrame, by: list[str], ident: str, value: str, replicates: int, level: float = 0.99) -> DataFrame:
    """Median and bootstrap interval: a replicate weighs each row by a Poisson(1) draw from its id, so
    that no resampling moves rows. Weights go up to 14, beyond which a draw of 31 bits never falls."""
    u = lcg(lcg(F.col(ident), F.col("_b")) + 7919, F.col("_b")) / F.lit(2147483648.0)
    steps = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(14)]
    weight = F.lit(0)
    for s in steps:
        weight = weight + (u >= s).cast("int")
    rows = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight).where("_w > 0")
    medians = rows.groupBy(*by, "_b").agg(F.percentile(value, F.lit(0.5), F.col("_w")).alias("_m"))
    ends = medians.groupBy(*by).agg(F.percentile("_m", F.lit((1 - level) / 2)).alias("low"), F.percentile("_m", F.lit((1 + level) / 2)).alias("high"))
    return df.groupBy(*by).agg(F.median(value).alias("mid")).join(ends, by)


def density(df: DataFrame, by: list[str], value: str, grid: list[float], width: float) -> DataFrame:
    """Gaussian kernel density on a grid of points."""
    z = (F.col("x") - F.col(value)) / width
    rows = df.withColumn("x", F.explode(F.array(*map(F.lit, grid))))
    return rows.groupBy(*by, "x").agg((F.avg(F.exp(-0.5 * z * z)) / (width * math.sqrt(2 * math.pi))).alias("density"))


def flatness(value: str) -> Column:
    """Geometric over arithmetic mean."""
    return F.exp(F.avg(F.ln(value))) / F.avg(value)


def edge_contrast(df: DataFrame, by: list[str], value: str, tie: str, share: float) -> DataFrame:
    """Mean of the top share of a band less that of the bottom share, one value each at least."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    m = F.greatest(F.lit(1), F.floor(share * F.col("_n")))
    top, low = F.avg(F.when(F.col("_r") > F.col("_n") - m, F.col(value))), F.avg(F.when(F.col("_r") <= m, F.col(value)))
    return rows.groupBy(*by).agg((top - low).alias("contrast"))
