"""Frame jobs over pixels in long form (video_id, t, y, x, v), and mixing of vector sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators.groups import directogram
from cadenza.operators.rows import mix
from cadenza.operators.windows import gaussian
from cadenza.sources.tables import uniform


def frame_difference(pixels: DataFrame) -> DataFrame:
    """Sum of absolute differences to the next frame over all pixels; the last frame repeats the one before."""
    pixel = Window.partitionBy("video_id", "y", "x").orderBy("t")
    steps = pixels.withColumn("_d", F.abs(F.lead("v").over(pixel) - F.col("v"))).groupBy("video_id", "t").agg(F.sum("_d").alias("d"))
    return steps.withColumn("d", F.coalesce("d", F.lag("d").over(Window.partitionBy("video_id").orderBy("t"))))


def centre_crop(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """The middle square of each frame."""
    side = min(height, width)
    top, left = (height - side) // 2, (width - side) // 2
    inside = F.col("y").between(top, top + side - 1) & F.col("x").between(left, left + side - 1)
    return pixels.where(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def circle_mix(inner: DataFrame, outer: DataFrame, y: float, x: float, radius: float, edge: float) -> DataFrame:
    """Two fields mixed by a disc with a soft edge: inside the first, outside the second."""
    far = F.sqrt(F.pow(F.col("y") - y, F.lit(2.0)) + F.pow(F.col("x") - x, F.lit(2.0)))
    part = F.least(F.greatest((radius + edge - far) / edge, F.lit(0.0)), F.lit(1.0))
    met = inner.join(outer.withColumnRenamed("v", "_w"), ["video_id", "t", "y", "x"])
    return met.withColumn("v", F.col("v") * part + F.col("_w") * (1 - part)).drop("_w")


def pooled(pixels: DataFrame, cell: int) -> DataFrame:
    """Mean of square cells."""
    at = lambda c: F.floor(F.col(c) / cell).alias(c)
    return pixels.groupBy("video_id", "t", at("y"), at("x")).agg(F.avg("v").alias("v"))


def blend(first: Column, second: Column, part: Column) -> Column:
    """first · part + second · (1 - part)."""
    return first * part + second * (1 - part)


def merge_layers(base: DataFrame, patch: DataFrame, low: int, high: int, how: str, part: Column | None = None) -> DataFrame:
    """A patch (series_id, t, layer, d, v) put into a range of layers of a sequence: average, overwrite, or
    modulate by a part."""
    met = base.join(patch.withColumnRenamed("v", "_p"), ["series_id", "t", "layer", "d"], "left")
    new = {"average": (F.col("v") + F.col("_p")) / 2, "overwrite": F.col("_p"), "modulate": None if part is None else blend(F.col("_p"), F.col("v"), part)}[how]
    inside = (F.col("layer") >= low) & (F.col("layer") < high) & F.col("_p").isNotNull()
    return met.withColumn("v", F.when(inside, new).otherwise(F.col("v"))).drop("_p")


def residual(df: DataFrame, by: list[str]) -> DataFrame:
    """Each value as the mean of its group (`offset`) and what is left (`residual`)."""
    return df.withColumn("offset", F.avg("v").over(Window.partitionBy(*by))).withColumn("residual", F.col("v") - F.col("offset"))


def gates(df: DataFrame, by: list[str], temperature: float = 1.0) -> DataFrame:
    """Softmax of v within each group, stable."""
    group = Window.partitionBy(*by)
    power = F.exp((F.col("v") - F.max("v").over(group)) / temperature)
    return df.withColumn("_e", power).withColumn("gate", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def value_lookup(series: DataFrame, offset: float, size: int) -> Column:
    """Palette index of a value: shifted, modulo the palette's size, cut to a whole number."""
    return F.floor(F.pmod(F.col("v") + offset, F.lit(float(size)))).cast("long")


def tiled(loop: DataFrame, frames: int) -> DataFrame:
    """A loop (series_id, t, v) repeated up to `frames` frames."""
    n = loop.groupBy("series_id").agg(F.count("*").alias("_n"))
    grid = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).select("series_id", "i", F.pmod("i", "_n").cast("int").alias("t"))
    return grid.join(loop.select("series_id", "t", "v"), ["series_id", "t"]).select("series_id", F.col("i").alias("t"), "v")


def spline_weights(points: int, frames: int) -> list[tuple[int, int, float]]:
    """The closed cubic spline through `points` vectors at `frames` places, as a linear map: rows
    (frame, point, weight). It depends on the two numbers only."""
    a = np.zeros((points, points))
    for i in range(points):
        a[i, i] += 4
        a[i, (i - 1) % points] += 1
        a[i, (i + 1) % points] += 1
    eye = np.eye(points)
    second = np.linalg.solve(a, 6 * (np.roll(eye, -1, axis=0) - 2 * eye + np.roll(eye, 1, axis=0)))
    out = []
    for f in range(frames):
        u = f * points / frames
        i = math.floor(u)
        s, j = u - i, (i + 1) % points
        row = (1 - s) * eye[i] + s * eye[j] + ((1 - s) ** 3 - (1 - s)) / 6 * second[i] + (s**3 - s) / 6 * second[j]
        out += [(f, p, float(w)) for p, w in enumerate(row)]
    return out


def spline(palette: DataFrame, points: int, frames: int) -> DataFrame:
    """Closed cubic spline through the vectors (p, d, v) of a palette: t, d, v."""
    weights = F.broadcast(palette.sparkSession.createDataFrame(spline_weights(points, frames), "t int, p int, w double"))
    return palette.join(weights, "p").groupBy("t", "d").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def radial_spectrum(pixels: DataFrame, low: float = 0.0015, high: float = 0.9985) -> DataFrame:
    """video_id, t, radius, v: the mean magnitude of each frame's Fourier transform by whole distance from the centre, the mean itself left out; magnitudes are clamped
    to two quantiles of their video. Frames are transformed whole, a batch at a time."""
    lines = pixels.groupBy("video_id", "t", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("row"))
    grids = lines.groupBy("video_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]).alias("grid"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for video, t, grid in zip(b["video_id"], b["t"], b["grid"]):
                z = np.stack(grid)
                h, w = z.shape
                mag = np.abs(np.fft.rfft2(z, norm="forward"))[: h // 2, : w // 2]
                ky, kx = np.indices(mag.shape)
                yield pd.DataFrame({"video_id": video, "t": t, "ky": ky.ravel(), "kx": kx.ravel(), "v": mag.ravel()})

    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("video_id", "t"))
    cells = grids.mapInPandas(run, f"{kinds}, ky int, kx int, v double")
    clamped = N.clamp(cells, ["video_id"], low, high)
    radius = F.floor(F.sqrt(F.col("ky") * F.col("ky") + F.col("kx") * F.col("kx"))).cast("int")
    return clamped.groupBy("video_id", "t", radius.alias("radius")).agg(F.avg("v").alias("v")).where("radius > 0")


def direction_spectrum(flow: DataFrame, bins: int) -> DataFrame:
    """video_id, t, bin, v: sums of magnitudes by direction (directogram() of mag and ang), after a lower median over three frames by three bins, reflected at the
    edges. Directions without any flow count as zero."""
    sums = directogram(flow, ["video_id", "t"], "mag", "ang", bins)
    grid = flow.select("video_id", "t").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(sums, ["video_id", "t", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    rows = full.groupBy("video_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda c: c["v"]).alias("own"))
    order = Window.partitionBy("video_id").orderBy("t")
    before, after = F.lag("own").over(order), F.lead("own").over(order)
    rows = rows.withColumns({"_a": F.coalesce(before, after, "own"), "_c": F.coalesce(after, before, "own")})
    near = lambda k: F.array(k - 1, k, k + 1)
    place = lambda i: F.when(i < 0, -i).when(i >= bins, 2 * (bins - 1) - i).otherwise(i)
    picked = lambda column, k: F.transform(near(k), lambda i: F.get(column, place(i).cast("int")))
    box = lambda k: F.array_sort(F.flatten(F.array(*[picked(c, k) for c in ("_a", "own", "_c")])))
    return rows.select("video_id", "t", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.get(box(k), F.lit(4)))).alias("bin", "v"))


def spectrum_onsets(channels: DataFrame) -> DataFrame:
    """series_id, t, v: rises of a spectrum (series_id, t, ch, v), summed over channels, clamped to two quantiles and scaled to 0..1."""
    by = Window.partitionBy("series_id", "ch").orderBy("t")
    rises = channels.withColumn("_r", F.greatest(F.lead("v", 1, 0.0).over(by) - F.col("v"), F.lit(0.0)))
    return N.standardize(rises.groupBy("series_id", "t").agg(F.sum("_r").alias("v")), ["series_id"], 0.025, 0.975)


def patched(base: DataFrame, steps: list[tuple[DataFrame, int, int, str, float]]) -> DataFrame:
    """A sequence (series_id, t, layer, d, v) after a list of configured steps, one after the other: a patch, the first layer that it goes to, the layer past the last, how
    ('average', 'overwrite' or 'modulate') and its part."""
    for patch, low, high, how, part in steps:
        base = merge_layers(base, patch, low, high, how, F.lit(part))
    return base


def noise_base(spark, seeds: int, height: int, width: int, seed: int) -> DataFrame:
    """Normal noise of a fixed size, drawn by hashes: m (which of `seeds` fields), y, x, z."""
    rows = spark.range(seeds * height * width).select(
        (F.col("id") / (height * width)).cast("int").alias("m"), (F.col("id") / width % height).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), N.normal(uniform(F.col("id"), seed), uniform(F.col("id"), seed + 1)).alias("z")
    )
    return F.broadcast(rows)


def noise_blend(first: DataFrame, second: DataFrame | None, modulators: DataFrame) -> DataFrame:
    """series_id, t, y, x, v: fields of noise weighed by modulators (series_id, t, m, w), summed over m; with a second set, plus that by 1 - w."""
    met = modulators.join(first, "m")
    if second is not None:
        met = met.join(second.withColumnRenamed("z", "_z"), ["m", "y", "x"])
    value = F.col("w") * F.col("z") + (0.0 if second is None else (1 - F.col("w")) * F.col("_z"))
    return met.groupBy("series_id", "t", "y", "x").agg(F.sum(value).alias("v"))


def noise_loop(fields: DataFrame, frames: DataFrame, loops: float, sigma: float) -> DataFrame:
    """series_id, t, y, x, v: noise that comes back `loops` times over a series (series_id, t, n: its length), from three fields (m 0, 1 and 2); each frame has a root mean square of 1."""
    wide = fields.groupBy("y", "x").agg(*[F.max(F.when(F.col("m") == k, F.col("z"))).alias(f"z{k}") for k in range(3)])
    angle = F.col("t") * (loops * 2 * math.pi) / F.greatest(F.col("n") - 1, F.lit(1))
    value = F.sin(F.cos(angle + F.col("z0")) * (50.0 / sigma) + F.col("z1")) * F.col("z2")
    rows = frames.crossJoin(F.broadcast(wide)).select("series_id", "t", "y", "x", value.alias("v"))
    frame = Window.partitionBy("series_id", "t")
    return rows.withColumn("v", F.col("v") / (F.sqrt(F.avg(F.col("v") * F.col("v")).over(frame)) + 2.0**-23))


def noise_pair(left: DataFrame, right: DataFrame, part: Column | None = None) -> DataFrame:
    """Two noise sequences averaged, or mixed by a part of the first."""
    met = left.join(right.withColumnRenamed("v", "_w"), ["series_id", "t", "y", "x"])
    part = F.lit(0.5) if part is None else part
    return met.withColumn("v", F.col("v") * part + F.col("_w") * (1 - part)).drop("_w")


def configured(series: DataFrame, steps: int, choices: dict[str, dict[str, float]], seed: int, location: float = 0.666) -> DataFrame:
    """series_id, step, one column for each name of choices (options with weights), and weight (skew normal around a location): a random configuration
    of each series, drawn by its id."""
    grid = series.select("series_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    ident = F.col("series_id") * 1009 + F.col("step")
    for k, (name, options) in enumerate(choices.items()):
        u, total, out, held = uniform(ident, seed + 10 * k), sum(options.values()), None, 0.0
        for option, weight in options.items():
            held += weight / total
            out = F.when(u < held, F.lit(option)) if out is None else out.when(u < held, F.lit(option))
        grid = grid.withColumn(name, out.otherwise(F.lit(list(options)[-1])))
    draws = [N.normal(uniform(ident, seed + a), uniform(ident, seed + b)) for a, b in ((101, 102), (103, 104))]
    return grid.withColumn("weight", N.skew_normal(draws[0], draws[1], 5.0, location, 0.5))


def noise_vectors(series: DataFrame, channels: int, seed: int) -> DataFrame:
    """series_id, t, d, v: independent normal values for each frame and channel, by hashes."""
    rows = series.select("series_id", "t").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    draw = lambda k: F.pmod(F.xxhash64("series_id", "t", "d", F.lit(seed + k)), F.lit(1 << 52)) / float(1 << 52)
    return rows.withColumn("v", N.normal(draw(0), draw(1)))


def control(series: DataFrame, channels: int, sigma: float, seed: int) -> DataFrame:
    """noise_vectors() smoothed along time: a control that has nothing to do with the series but its length."""
    keyed = noise_vectors(series, channels, seed).select(F.struct("series_id", "d").alias("series_id"), "t", "v")
    return gaussian(keyed, sigma).select("series_id.series_id", "t", F.col("series_id.d").alias("d"), "v")


def driven(weights: DataFrame, palette: DataFrame, sigma: float) -> DataFrame:
    """A sequence that follows features: palette vectors (p, d, v) mixed by weights (series_id, t, p, w), whose sum is 1 in each frame, then smoothed: series_id, t, d, v."""
    frame = Window.partitionBy("series_id", "t")
    mixed = mix(weights.withColumn("w", F.try_divide("w", F.sum("w").over(frame))), palette)
    keyed = mixed.select(F.struct("series_id", "d").alias("series_id"), F.col("t").cast("int").alias("t"), "v")
    return gaussian(keyed, sigma).select("series_id.series_id", "t", F.col("series_id.d").alias("d"), "v")


def cross_faded(sequence: DataFrame, boundaries: DataFrame, window: int) -> DataFrame:
    """Unit vectors (series_id, t, x) faded, in the `window` frames before each boundary (series_id, start), from what they are to the way on the sphere from the
    window's first vector to the boundary's own. Windows that overlap count for the next boundary only."""
    ends = boundaries.select("series_id", "start", F.greatest(F.col("start") - window, F.lit(0)).alias("first")).where("start > 0")
    marks = ends.withColumn("t", F.explode(F.sequence(F.col("first"), F.col("start") - 1))).groupBy("series_id", "t").agg(F.min(F.struct("start", "first")).alias("_m"))
    at = lambda c, n: sequence.select("series_id", F.col("t").alias(c), F.col("x").alias(n))
    inside = sequence.join(marks.select("series_id", "t", "_m.start", "_m.first"), ["series_id", "t"]).join(at("first", "_a"), ["series_id", "first"]).join(at("start", "_b"), ["series_id", "start"])
    part = F.try_divide(F.col("t") - F.col("first"), F.greatest(F.col("start") - F.col("first") - 1, F.lit(1))).cast("double")
    faded = inside.withColumn("_p", part).withColumn("_s", N.slerp("_a", "_b", F.col("_p")))
    faded = faded.select("series_id", "t", F.zip_with("x", "_s", lambda p, q: p.cast("double") * (1 - F.col("_p")) + q * F.col("_p")).alias("_new"))
    return sequence.join(faded, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("_new", F.transform("x", lambda v: v.cast("double"))).alias("x"))


def smoothed_before(series: DataFrame, boundaries: DataFrame, window: int, sigma: float) -> DataFrame:
    """series (series_id, t, v) smoothed within the `window` frames before each boundary (series_id, start) only."""
    ends = boundaries.select("series_id", "start", F.greatest(F.col("start") - window, F.lit(0)).alias("first")).where("start > 0")
    marks = ends.withColumn("t", F.explode(F.sequence(F.col("first"), F.col("start") - 1))).groupBy("series_id", "t").agg(F.min(F.struct("start", "first")).alias("_m"))
    own = series.select("series_id", F.col("t").cast("int").alias("t"), "v").join(marks.select("series_id", F.col("t").cast("int").alias("t"), "_m.start", "_m.first"), ["series_id", "t"])
    low = F.min("t").over(Window.partitionBy("series_id", "start"))
    keyed = own.withColumn("_low", low).select(F.struct("series_id", "start", F.col("_low").alias("low")).alias("series_id"), (F.col("t") - F.col("_low")).cast("int").alias("t"), "v")
    smooth = gaussian(keyed, sigma).select("series_id.series_id", (F.col("t") + F.col("series_id.low")).cast("int").alias("t"), F.col("v").alias("_v"))
    return series.join(smooth, ["series_id", "t"], "left").withColumn("v", F.coalesce("_v", "v")).drop("_v")
