"""Filters, joins, rankings and set operations over long series (series_id, t, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ranks import running

def in_order():
    """The frames of each series in order."""
    return Window.partitionBy("series_id").orderBy("t")

def whole():
    """All frames of each series."""
    return Window.partitionBy("series_id")



def crop(series: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Frames from start up to stop; no stop means to the end."""
    rows = series.where(F.col("t") >= start)
    return rows if stop is None else rows.where(F.col("t") < stop)


def longer_than(series: DataFrame, least: int) -> DataFrame:
    """Series with more than `least` frames."""
    return series.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") > least).drop("_n")


def local_threshold(df: DataFrame, by: list[str], gap: float, value: str = "v") -> DataFrame:
    """v set to 0 where it is more than `gap` below its row's maximum."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn(value, F.when(F.col(value) < top - gap, 0.0).otherwise(F.col(value)))


def global_threshold(df: DataFrame, gap: float, value: str = "v") -> DataFrame:
    """The same below the maximum of all rows, which one aggregate finds first."""
    top = df.agg(F.max(value).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(value, F.when(F.col(value) < F.col("_top") - gap, 0.0).otherwise(F.col(value))).drop("_top")


def is_peak(value: str = "v", window=None) -> Column:
    """Greater than both neighbours; ends are never peaks."""
    v, window = F.col(value), window or in_order()
    return F.coalesce((v > F.lag(value).over(window)) & (v > F.lead(value).over(window)), F.lit(False))


def is_half_peak(value: str = "v", window=None) -> Column:
    """Greater than the left neighbour and no less than the right one, with zeros beyond the ends."""
    v, window = F.col(value), window or in_order()
    return (v > F.lag(value, 1, 0.0).over(window)) & (v >= F.lead(value, 1, 0.0).over(window))


def iqr_outliers(df: DataFrame, by: list[str], value: str = "v", reach: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by more than `reach` of their distance."""
    bounds = df.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("_low"), F.percentile(value, F.lit(0.75)).alias("_high"))
    wide = reach * (F.col("_high") - F.col("_low"))
    return df.join(bounds, by).where((F.col(value) < F.col("_low") - wide) | (F.col(value) > F.col("_high") + wide)).drop("_low", "_high")


def perturb(df: DataFrame, kind: str, low: int, high: int, noise: Column | None = None) -> DataFrame:
    """Values of the channels low <= ch < high replaced: zero, negate, double or random."""
    new = {"zero": F.lit(0.0), "negate": -F.col("v"), "double": 2 * F.col("v"), "random": noise}[kind]
    return df.withColumn("v", F.when((F.col("ch") >= low) & (F.col("ch") < high), new).otherwise(F.col("v")))


def keep_top(df: DataFrame, by: list[str], k: int, tie: str, value: str = "v") -> DataFrame:
    """The k largest values of each group stay, the others become 0; ties by the lower `tie`."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    return df.withColumn(value, F.when(rank <= k, F.col(value)).otherwise(0.0))


def drop_small_energy(df: DataFrame, by: list[str], share: float, tie: str, value: str = "v") -> DataFrame:
    """The smallest magnitudes of a row become 0, as many as hold less than `share` of its sum."""
    rising = Window.partitionBy(*by).orderBy(F.abs(value), tie)
    held = F.sum(F.abs(value)).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.abs(value)).over(Window.partitionBy(*by))
    return df.withColumn(value, F.when(held < share * total, 0.0).otherwise(F.col(value)))


def scale_ranges(series: DataFrame, ranges: list[tuple[int, int, float]]) -> DataFrame:
    """Values multiplied by a factor within given frame ranges (start, stop, factor)."""
    out = F.col("v")
    for start, stop, factor in ranges:
        out = F.when((F.col("t") >= start) & (F.col("t") < stop), F.col("v") * factor).otherwise(out)
    return series.withColumn("v", out)


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames that both series have: series_id, t, x, y."""
    return left.select("series_id", "t", F.col("v").alias("x")).join(right.select("series_id", "t", F.col("v").alias("y")), ["series_id", "t"])


def locate(frames: DataFrame, lengths: DataFrame, ident: str, frame: str = "g", bucket: int = 1024) -> DataFrame:
    """Global frame number to (ident, local t): lengths holds `n` frames for each ident in order. Every
    interval of the running sum is listed under the buckets of frames that it touches, so that the range
    join is an equi-join by bucket."""
    starts = running(lengths.where("n > 0").select(ident, "n"), [], [ident], F.col("n").cast("long"), "_end", "_all").select(ident, "n", (F.col("_end") - F.col("n")).alias("_start"))
    starts = starts.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_start") / bucket), F.floor((F.col("_start") + F.col("n") - 1) / bucket))))
    met = frames.withColumn("_bucket", F.floor(F.col(frame) / bucket)).join(starts, "_bucket")
    return met.where((F.col(frame) >= F.col("_start")) & (F.col(frame) < F.col("_start") + F.col("n"))).select(frame, ident, (F.col(frame) - F.col("_start")).alias("t"))


def label_intervals(frames: DataFrame, marks: DataFrame) -> DataFrame:
    """frames (series_id, t) with the label of the last mark (series_id, start, label) at or before t:
    one union and one running aggregate in place of a range join."""
    both = frames.select("series_id", "t", F.lit(None).cast(marks.schema["label"].dataType).alias("label"), F.lit(1).alias("_kind"))
    both = both.unionByName(marks.select("series_id", F.col("start").cast(frames.schema["t"].dataType).alias("t"), "label", F.lit(0).alias("_kind")))
    so_far = Window.partitionBy("series_id").orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("label", F.last("label", ignorenulls=True).over(so_far)).where("_kind = 1").drop("_kind")


def beat_intervals(series: DataFrame, beats: DataFrame) -> DataFrame:
    """series with `beat`, the number of beats (series_id, t) at or before each frame: the half-open
    intervals between beats, 0 before the first."""
    marked = series.join(beats.select("series_id", "t", F.lit(1).alias("_b")), ["series_id", "t"], "left")
    return marked.withColumn("beat", F.count("_b").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def aggregate_slices(series: DataFrame, slices: DataFrame, how: Column) -> DataFrame:
    """One aggregate for each slice (slice_id, start, stop), which may overlap; the slices, given by the
    caller, are few."""
    met = series.join(slices, (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    return met.groupBy("series_id", "slice_id").agg(how.alias("v"))


def mix(weights: DataFrame, palette: DataFrame) -> DataFrame:
    """Weighted sums of palette vectors: weights (series_id, t, p, w) and palette (p, d, v), whose size is fixed. Where each of its vectors has a number in every column d, a frame's weights
    are multiplied with it as a whole, so that no row is made for each weight and column; else weights and palette are joined."""
    held = palette.groupBy("p", "d").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.count("v").alias("m")).collect()
    of, columns = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in held))} for c in ("p", "d"))
    if not held or len(held) < len(of) * len(columns) or any(r["n"] != r["m"] or r["p"] is None or r["d"] is None or not math.isfinite(r["v"]) for r in held):
        return weights.join(palette, "p").groupBy("series_id", "t", "d").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    full = np.zeros((len(of), len(columns)))
    for r in held:
        full[of[r["p"]], columns[r["d"]]] = r["v"]
    rows = weights.where(F.col("p").isin(*of)).groupBy("series_id", "t").agg(F.collect_list(F.struct("p", F.col("w").cast("double").alias("w"))).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_x")
            frame, flat = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
            known = flat.field("w").is_valid().to_numpy(zero_copy_only=False)
            w = np.zeros((len(batch), len(of)))
            np.add.at(w, (frame[known], np.array([of[p] for p in flat.field("p").to_pylist()], int)[known]), flat.field("w").to_numpy(zero_copy_only=False)[known])
            none = np.repeat(np.bincount(frame[known], minlength=len(batch)) == 0, len(columns))  # no weight is known
            offsets = pa.array(np.arange(len(batch) + 1) * len(columns), pa.int32())
            mixed = pa.ListArray.from_arrays(offsets, pa.array((w @ full).ravel(), pa.float64(), mask=none))
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("t"), mixed], ["series_id", "t", "v"])

    kinds = [weights.schema[c].dataType.simpleString() for c in ("series_id", "t")]
    mixed = rows.mapInArrow(run, f"series_id {kinds[0]}, t {kinds[1]}, v array<double>").select("series_id", "t", F.posexplode("v").alias("_d", "v"))
    names = F.array(*[F.lit(d).cast(palette.schema["d"].dataType) for d in columns])
    return mixed.select("series_id", "t", F.get(names, F.col("_d")).alias("d"), "v")


def pairs_within(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """All pairs of rows of a series with the first one earlier. Quadratic within a series: reduce it
    by beats first."""
    left = df.select("series_id", F.col(order).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = df.select("series_id", F.col(order).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, "series_id").where("a < b")


def nearest_resample(series: DataFrame, frames: int) -> DataFrame:
    """Each series at exactly `frames` frames, frame i taken from floor(i n / frames)."""
    ends = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    grid = ends.select("series_id", "_n", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("i"))
    grid = grid.select("series_id", "i", F.floor(F.col("i") * F.col("_n") / frames).cast("int").alias("t"))
    return grid.join(series.select("series_id", "t", "v"), ["series_id", "t"]).select("series_id", F.col("i").alias("t"), "v")


def linear_resample(series: DataFrame, frames: int, ends: bool = False) -> DataFrame:
    """Each series at `frames` frames by linear interpolation; frame centres correspond, or with
    `ends` the first and the last frames."""
    lengths = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    i = F.col("i")
    place = i * (F.col("_n") - 1) / max(frames - 1, 1) if ends else (i + 0.5) * F.col("_n") / frames - 0.5
    grid = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("_x", F.greatest(place, F.lit(0.0)))
    grid = grid.withColumn("_lo", F.least(F.floor("_x"), F.col("_n") - 1).cast("int")).withColumn("_hi", F.least(F.floor("_x") + 1, F.col("_n") - 1).cast("int"))
    low, high = (series.select("series_id", F.col("t").alias(f"_{k}"), F.col("v").alias(f"_v{k}")) for k in ("lo", "hi"))
    met = grid.join(low, ["series_id", "_lo"]).join(high, ["series_id", "_hi"])
    part = F.least(F.col("_x") - F.col("_lo"), F.lit(1.0))
    return met.select("series_id", i.alias("t"), (F.col("_vlo") * (1 - part) + F.col("_vhi") * part).alias("v"))


def wrap_slice(series: DataFrame, start: int, frames: int) -> DataFrame:
    """`frames` frames from `start` on, going round at the end of the series."""
    ends = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).select("series_id", "i", F.pmod(F.col("i") + start, F.col("_n")).cast("int").alias("t"))
    return grid.join(series.select("series_id", "t", "v"), ["series_id", "t"]).select("series_id", F.col("i").alias("t"), "v")


def rank_bands(df: DataFrame, by: list[str], order: list[str], bands: list[tuple[float, int]]) -> DataFrame:
    """Rows at places of the order: `count` rows from each share (0 to 1) of the group on."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    keep = F.lit(False)
    for share, count in bands:
        first = F.floor(F.lit(share) * F.col("_n"))
        keep = keep | ((F.col("_r") >= first) & (F.col("_r") < first + count))
    return rows.where(keep).withColumnRenamed("_r", "rank").drop("_n")


def even_picks(df: DataFrame, by: list[str], order: list[str], picks: int) -> DataFrame:
    """`picks` rows at even distances of an ordered group, the ends included."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    # row r is picked if some i has round(i (n - 1) / (picks - 1)) = r
    step = (F.col("_n") - 1) / F.lit(max(picks - 1, 1))
    near = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.floor(i * step + 0.5)))
    return rows.withColumn("_near", near).where("array_contains(_near, cast(_r as bigint))").withColumnRenamed("_r", "rank").drop("_n", "_near")


def top_rows(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two series frame by frame: left at even, right at odd places."""
    return left.withColumn("t", 2 * F.col("t")).unionByName(right.withColumn("t", 2 * F.col("t") + 1))


def stack_channels(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Channels of both, those of the right one after the left's `width` channels."""
    return left.unionByName(right.withColumn("ch", F.col("ch") + width))
