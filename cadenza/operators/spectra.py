"""Spectral jobs: frames of a signal by a join, transforms of Arrow batches of whole frames, bands as products with small banks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators.groups import edge_contrast, flatness
from cadenza.operators.matching import median_2d
from cadenza.operators.recurrences import band_pass, beats, biquad
from cadenza.operators.rows import is_peak, linear_resample
from cadenza.operators.segments import beat_synchronous, laplacian_segmentations, segment_links, stretched
from cadenza.sources.tables import settled
from cadenza.operators.windows import convolve, gaussian, moving_median, onset_strength, parabolic_peak, reflected, salience


def frames(series: DataFrame, width: int, hop: int, most: str | None = None) -> DataFrame:
    """Centred frames: series_id, frame, k (place in the frame), v, reflected at the ends; the last frame
    is left out. most: a column with the number of frames that a series has at most."""
    n = series.groupBy("series_id").agg(F.count("*").alias("_n"))
    rows = series.select("series_id", F.col("t").cast("int").alias("t"), "v", *[most] * bool(most)).join(n, "series_id").where("t >= 0 AND t < _n")
    period, final = F.greatest(2 * (F.col("_n") - 1), F.lit(1)), F.greatest(F.floor(F.col("_n") / hop) - 1, F.lit(0))
    final = F.least(final, F.col(most) - 1) if most else final
    low, high = F.lit(-(width // 2)).cast("long"), final * hop + width - 1 - width // 2
    # a frame of the series goes to each place that reflects onto it, and from there to the frames that hold the place: no grid of all places is joined, which Spark would take for a small table and broadcast
    at = lambda s: low + F.pmod(s - low, period)
    places = lambda s: F.when(at(s) <= high, F.sequence(at(s), high, period)).otherwise(F.array().cast("array<bigint>"))
    mirrored = (F.col("t") > 0) & (F.col("t") < F.col("_n") - 1)
    t = F.col("t").cast("long")
    rows = rows.withColumn("_p", F.explode(F.when(mirrored, F.concat(places(t), places(-t))).otherwise(places(t)))).withColumn("_k", F.col("_p") + width // 2)
    first, last = F.greatest(F.ceil((F.col("_k") - width + 1) / hop), F.lit(0)).cast("int"), F.least(F.floor(F.col("_k") / hop), final).cast("int")
    rows = rows.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("frame", F.explode(F.sequence("_a", "_b")))
    return rows.select("series_id", "frame", (F.col("_k") - F.col("frame") * hop).cast("int").alias("k"), "v")


def hann(width: int) -> list[float]:
    """Periodic Hann window."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / width) for k in range(width)]


def gathered(framed: DataFrame) -> DataFrame:
    """One row a frame: series_id, frame, x (its values in order)."""
    rows = framed.groupBy("series_id", "frame").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_x"))
    return rows.select("series_id", "frame", F.transform("_x", lambda p: p["v"]).alias("x"))


def projected(framed: DataFrame, basis: np.ndarray) -> DataFrame:
    """Products of frames with the columns of a complex basis: series_id, frame, re and im (arrays), a batch of frames at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.stack(b["x"].to_numpy()) @ basis
                yield pd.DataFrame({"series_id": b["series_id"], "frame": b["frame"], "re": list(z.real), "im": list(z.imag)})

    kind = framed.schema["series_id"].dataType.simpleString()
    return gathered(framed).mapInPandas(run, f"series_id {kind}, frame int, re array<double>, im array<double>")


def fourier(width: int, window: list[float] | None = None) -> np.ndarray:
    """Basis of the Fourier transform of weighted frames, bins up to the half."""
    k = np.arange(width)
    return np.array(window or hann(width))[:, None] * np.exp(-2j * np.pi * np.outer(k, np.arange(width // 2 + 1)) / width)


def stft_batches(framed: DataFrame, width: int) -> DataFrame:
    """Magnitudes of the Fourier transform of Hann-weighted frames: series_id, frame, mag (array)."""
    rows = projected(framed, fourier(width))
    return rows.select("series_id", "frame", F.zip_with("re", "im", F.hypot).alias("mag"))


def stft(framed: DataFrame, width: int) -> DataFrame:
    """The same with a row for each bin: series_id, frame, bin, mag."""
    return stft_batches(framed, width).select("series_id", "frame", F.posexplode("mag").alias("bin", "mag"))


def stft_complex(framed: DataFrame, width: int) -> DataFrame:
    """series_id, frame, bin, re, im."""
    rows = projected(framed, fourier(width)).select("series_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return rows.select("series_id", "frame", "bin", "z.re", "z.im")


def constant_q(series: DataFrame, hop: int, rate: float, lowest: float, bins: int, per_octave: int, halve: bool = True) -> DataFrame:
    """Constant-Q magnitudes of series (series_id, t, v): series_id, frame, bin, mag. Each bin has a Hann window of as many samples as its Q asks for, whole, around the frame's
    middle. Octave by octave, the series is first halved in rate (low pass, every second sample) as often as the octave's highest bin and the hop allow, so that windows stay
    as short as those of the highest octave; with halve = False all are taken at the full rate. Both forms agree but where a window reaches beyond an end of the series, which a
    halved one reflects at its own last sample."""
    top = lowest * 2 ** ((bins - 1) / per_octave)
    if top >= rate / 2:
        raise ValueError(f"the highest bin, {top:.6g}, must lie below half the rate, {rate / 2:.6g}")
    counts = series.groupBy("series_id").agg(F.greatest(F.floor(F.count("*") / hop), F.lit(1)).alias("_most"))
    at, out = {0: series.select("series_id", "t", "v")}, None
    for last in range(bins, 0, -per_octave):
        first, times = max(0, last - per_octave), 0
        while halve and hop % 2 ** (times + 1) == 0 and lowest * 2 ** ((last - 1) / per_octave) <= 0.4 * rate / 2 ** (times + 1):
            times += 1
            if times not in at:
                at[times] = settled(halved(at[times - 1]))
        low, slow = lowest * 2 ** (first / per_octave), rate / 2**times
        width = 2 * (int(constant_q_length(slow, low, per_octave)) // 2) + 1
        framed = frames(at[times].join(counts, "series_id"), width, hop // 2**times, "_most")  # joined before frames are made: what comes after looks small to Spark, and would be broadcast
        found = projected(framed, constant_q_basis(width, slow, low, last - first, per_octave))
        found = found.select("series_id", "frame", F.posexplode(F.zip_with("re", "im", F.hypot)).alias("bin", "mag")).withColumn("bin", F.col("bin") + first)
        out = found if out is None else out.union(found)
    return out


def constant_q_length(rate: float, frequency: float, per_octave: int) -> float:
    """Samples of the window of a bin."""
    return rate / frequency / (2 ** (1 / per_octave) - 1)


def constant_q_basis(width: int, rate: float, lowest: float, bins: int, per_octave: int) -> np.ndarray:
    """Columns of kernels at lowest · 2^(bin / per_octave), each with the sum of weights 1; an error if a window is longer than `width` (odd)."""
    n = np.arange(width) - width // 2
    out = np.zeros((width, bins), complex)
    for b in range(bins):
        f = lowest * 2 ** (b / per_octave)
        half = constant_q_length(rate, f, per_octave) / 2
        if int(half) > width // 2:
            raise ValueError(f"a window of {2 * half:.6g} samples does not fit into {width}")
        w = np.where(np.abs(n) <= half, 0.5 + 0.5 * np.cos(np.pi * n / half), 0.0)
        out[:, b] = w / w.sum() * np.exp(-2j * np.pi * f / rate * n)
    return out


def low_pass_taps(radius: int = 31) -> list[tuple[int, float]]:
    """A Blackman-windowed sinc that passes up to 0.2 and stops from 0.3 of the rate."""
    n = np.arange(-radius, radius + 1)
    w = np.sinc(n / 2) * (0.42 + 0.5 * np.cos(np.pi * n / (radius + 1)) + 0.08 * np.cos(2 * np.pi * n / (radius + 1)))
    return [(int(o), float(x)) for o, x in zip(n, w / w.sum()) if abs(x) > 1e-12]


def halved(series: DataFrame) -> DataFrame:
    """A series (series_id, t, v) at half its rate, reflected at its ends."""
    return convolve(series, low_pass_taps(), "reflect").where("t % 2 = 0").select("series_id", (F.col("t") / 2).cast("int").alias("t"), "v")


def filter_bank(spectrum: DataFrame, weights: list[tuple[int, int, float]]) -> DataFrame:
    """Bands as weighted sums of bins: weights (bin, band, weight) of a fixed bank."""
    bank = F.broadcast(spectrum.sparkSession.createDataFrame(weights, "bin int, band int, w double"))
    return spectrum.join(bank, "bin").groupBy("series_id", "frame", "band").agg(F.sum(F.col("mag") * F.col("w")).alias("v"))


def triangles(bins: int, bands: int) -> list[tuple[int, int, float]]:
    """Overlapping triangular bands at even distances over the bins."""
    step = (bins - 1) / (bands + 1)
    out = []
    for band in range(bands):
        for b in range(bins):
            w = max(0.0, 1 - abs(b - (band + 1) * step) / step)
            if w > 0:
                out.append((b, band, w))
    return out


def dct(bands: DataFrame, count: int, keep: int) -> DataFrame:
    """Orthonormal cosine transform (type II) over `count` bands, the first `keep` coefficients."""
    rows = [(b, c, math.sqrt((1 if c == 0 else 2) / count) * math.cos(math.pi * (b + 0.5) * c / count)) for b in range(count) for c in range(keep)]
    basis = F.broadcast(bands.sparkSession.createDataFrame(rows, "band int, coef int, w double"))
    return bands.join(basis, "band").groupBy("series_id", "frame", "coef").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """series_id, lag, r: products of frames `lag` apart, summed, over those at lag 0."""
    rows = series.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("_u", F.col("t") + F.col("lag"))
    met = rows.join(series.select("series_id", F.col("t").alias("_u"), F.col("v").alias("_w")), ["series_id", "_u"])
    sums = met.groupBy("series_id", "lag").agg(F.sum(F.col("v") * F.col("_w")).alias("r"))
    return sums.withColumn("r", F.try_divide("r", F.max(F.when(F.col("lag") == 0, F.col("r"))).over(Window.partitionBy("series_id"))))


def tempo(series: DataFrame, lags: int, rate: float, start: float = 120.0, spread: float = 1.0) -> DataFrame:
    """Beats a minute of the lag with the highest autocorrelation under a log-normal prior; the shorter lag
    on ties."""
    r = autocorrelation(series, lags).where("lag > 0").withColumn("bpm", 60.0 * rate / F.col("lag"))
    prior = F.exp(-0.5 * F.pow(F.log2(F.col("bpm") / start) / spread, F.lit(2.0)))
    best = F.max(F.struct(F.round(F.col("r") * prior, 9).alias("s"), (-F.col("lag")).alias("l")))
    return r.groupBy("series_id").agg(best.alias("m")).select("series_id", (60.0 * rate / -F.col("m.l")).alias("bpm"))


def by_bin(spectrum: DataFrame) -> DataFrame:
    """A spectrum (series_id, frame, bin, mag) as one series (series_id, t, v) for each bin; series_id holds both."""
    return spectrum.select(F.struct("series_id", "bin").alias("series_id"), F.col("frame").alias("t"), F.col("mag").alias("v"))


def harmonic_percussive(spectrum: DataFrame, k: int = 31, margin: float = 8.0, power: float = 2.0) -> DataFrame:
    """series_id, frame, bin, harmonic and percussive: the spectrum under soft masks of its medians along time and along bins."""
    # the value itself goes with its medians, so that nothing is joined
    along = moving_median(by_bin(spectrum.where("series_id IS NOT NULL")), k, "w")
    rows = along.select("series_id.series_id", F.col("t").alias("frame"), F.lit(0).alias("y"), "series_id.bin", F.col("w").alias("v"), F.col("v").alias("_h"))
    met = median_2d(rows, ["series_id", "frame"], "y", "bin", 1, k, {"v": "mag", "_h": "_h"}).select("series_id", "frame", F.col("bin").cast("int").alias("bin"), "mag", "_h", F.col("v").alias("_p"))
    split = margin == 1
    return met.select(
        "series_id", "frame", "bin",
        (F.col("mag") * N.soft_mask(F.col("_h"), F.col("_p") * margin, power, split)).alias("harmonic"),
        (F.col("mag") * N.soft_mask(F.col("_p"), F.col("_h") * margin, power, split)).alias("percussive"),
    )


def folded(spectrum: DataFrame, classes: int = 12, per_class: int = 1) -> DataFrame:
    """Chroma: sums of the bins of a constant-Q spectrum (per_class to a pitch class, centred on it) over octaves: series_id, frame, pitch, v."""
    pitch = F.pmod(F.floor((F.col("bin") + per_class // 2) / per_class), F.lit(classes)).cast("int")
    return spectrum.groupBy("series_id", "frame", pitch.alias("pitch")).agg(F.sum("mag").alias("v"))


def quantised(value: Column) -> Column:
    """Steps of a quarter above 0.05, 0.1, 0.2 and 0.4."""
    return sum((F.when(value > edge, 0.25).otherwise(0.0) for edge in (0.05, 0.1, 0.2, 0.4)), F.lit(0.0))


def quantiser() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knots, values and second derivatives of the natural cubic spline that quantised_smoothly() follows: level through 0.5 below 0.025, then one unit from each of
    the edges 0, 0.05, 0.1, 0.2, 0.4 to the next, and level at 4.5 above 0.5."""
    edges = [0.0, 0.05, 0.1, 0.2, 0.4]
    x = np.concatenate([np.linspace(-0.1, 0.025, 101)[:-1]] + [np.linspace(a, b, 11)[:-1] for a, b in zip([0.025, *edges[1:]], [*edges[1:], 0.5])] + [np.linspace(0.5, 1.1, 100)])
    rise = np.interp(x, [0, *edges[1:], 0.6], range(6))  # the last unit would end at 0.6
    y = np.where(x < 0.025 - 1e-12, 0.5, np.where(x >= 0.5 - 1e-12, 4.5, rise))
    h = np.diff(x)
    n = len(x)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return x, y, np.linalg.solve(system, right)


def quantised_smoothly(value: Column, sharpness: float = 20.0) -> Column:
    """quantised() with a smooth step: the value goes through a spline that makes the steps equally wide, then through logistic steps."""
    x, y, m = quantiser()
    knots = F.array(*[F.lit(float(v)) for v in x])
    at = F.least(F.greatest(F.size(F.filter(knots, lambda k: k < value)) - 1, F.lit(0)), F.lit(len(x) - 2))
    pick = lambda v: F.get(F.array(*[F.lit(float(u)) for u in v]), at)
    h = np.diff(x)
    t = value - F.get(knots, at)
    # coefficients of (value - knot) in each interval
    w = pick(y[:-1]) + t * (pick((y[1:] - y[:-1]) / h - h * (2 * m[:-1] + m[1:]) / 6) + t * (pick(m[:-1] / 2) + t * pick((m[1:] - m[:-1]) / (6 * h))))
    step, scale = F.floor(w - 0.5), 1 / (2 * (1 / (1 + math.exp(-sharpness)) - 0.5))
    return 0.25 * (step + scale / (1 + F.exp(-2 * sharpness * (w - 1 - step))))


def cens(chroma: DataFrame, smooth: int = 41) -> DataFrame:
    """Chroma energy statistics: each frame of unit sum, quantised, smoothed along time by a Hann window (zeros beyond the ends), of unit length."""
    unit = chroma.withColumn("v", F.coalesce(N.norm("l1", ["series_id", "frame"]), F.lit(0.0))).withColumn("v", quantised(F.col("v")))
    raw = hann(smooth + 2)
    kernel = [(k - (smooth + 2) // 2, w / sum(raw)) for k, w in enumerate(raw)]
    rows = unit.select(F.struct("series_id", "pitch").alias("series_id"), F.col("frame").cast("int").alias("t"), "v")
    rows = convolve(rows, kernel, "zero").select("series_id.series_id", F.col("t").alias("frame"), "series_id.pitch", "v")
    return rows.withColumn("v", F.coalesce(N.norm("l2", ["series_id", "frame"]), F.lit(0.0)))


def tonal_basis(classes: int = 12) -> list[tuple[int, int, float]]:
    """(pitch, axis, weight): sines and cosines of pitch classes on the circles of fifths, minor and major thirds; classes are 12/11 apart, both ends
    included."""
    out = []
    for axis, (turn, radius) in enumerate([(7 / 6, 1.0), (7 / 6, 1.0), (3 / 2, 1.0), (3 / 2, 1.0), (2 / 3, 0.5), (2 / 3, 0.5)]):
        for pitch in range(classes):
            out.append((pitch, axis, radius * math.cos(math.pi * (turn * pitch * 12 / (classes - 1) - 0.5 * (axis % 2 == 0)))))
    return out


def tonal_centroids(chroma: DataFrame) -> DataFrame:
    """series_id, frame, axis, v: chroma of unit sum on the six axes of tonal_basis()."""
    unit = chroma.withColumn("v", F.coalesce(N.norm("l1", ["series_id", "frame"]), F.lit(0.0)))
    basis = F.broadcast(chroma.sparkSession.createDataFrame(tonal_basis(), "pitch int, axis int, w double"))
    return unit.join(basis, "pitch").groupBy("series_id", "frame", "axis").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def pitch_peaks(spectrum: DataFrame, width: int, rate: float, threshold: float = 0.1) -> DataFrame:
    """series_id, frame, hz, mag: local maxima of each frame above a share of its largest value, between bins by a parabola."""
    frame = Window.partitionBy("series_id", "frame")
    shift, height = parabolic_peak("mag", frame.orderBy("bin"))
    rows = spectrum.withColumns({"_shift": shift, "_height": height, "_peak": is_peak("mag", frame.orderBy("bin")), "_top": F.max("mag").over(frame)})
    rows = rows.where(F.col("_peak") & (F.col("mag") > threshold * F.col("_top")))
    return rows.select("series_id", "frame", ((F.col("bin") + F.col("_shift")) * (rate / width)).alias("hz"), F.col("_height").alias("mag"))


def tuning(peaks: DataFrame, resolution: float = 0.01, per_octave: int = 12) -> DataFrame:
    """series_id, tuning: the offset from the nearest pitch, in parts of a class, that most peaks above the series' median magnitude have; the lower one on ties."""
    mid = peaks.groupBy("series_id").agg(F.expr("percentile_disc(0.5) within group (order by mag)").alias("_m"))
    off = F.pmod(per_octave * N.hz_to_octave(F.col("hz")), F.lit(1.0))
    off = F.when(off >= 0.5, off - 1).otherwise(off)
    rows = peaks.join(mid, "series_id").where("mag >= _m AND hz > 0").withColumn("bin", F.floor((off + 0.5) / resolution))
    counts = rows.groupBy("series_id", "bin").agg(F.count("*").alias("n"))
    return counts.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m")).select("series_id", (-F.col("m.b") * resolution - 0.5).alias("tuning"))


def pitch_class_profile(peaks: DataFrame, reference: float = 440.0, classes: int = 12, width: float = 1.0) -> DataFrame:
    """series_id, frame, pitch, v: squared magnitudes of peaks on the classes within half a width, weighed by a squared cosine; over the frame's largest."""
    place = classes * F.log2(F.col("hz") / reference)
    rows = peaks.where("hz > 0").withColumn("pitch", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    gap = F.pmod(place - F.col("pitch") + classes / 2, F.lit(float(classes))) - classes / 2
    rows = rows.withColumn("_d", gap).where(F.abs("_d") <= width / 2)
    sums = rows.groupBy("series_id", "frame", "pitch").agg(F.sum(F.pow(F.cos(F.col("_d") * (math.pi / width)), F.lit(2.0)) * F.col("mag") * F.col("mag")).alias("v"))
    return sums.withColumn("v", F.try_divide("v", F.max("v").over(Window.partitionBy("series_id", "frame"))))


def harmonic_weights(per_octave: int, decay: float = 0.6, tolerance: float = 2 / 3, octaves: int = 4) -> list[tuple[int, float]]:
    """Offsets in pitch bins at which a ratio of frequencies lies near a whole number, within `tolerance` semitones of 1, and its weight: a squared cosine of the distance times decay^(number - 1);
    the sum is 1."""
    reach, found = 2 ** (tolerance / 12), []
    for off in range(-octaves * per_octave, octaves * per_octave + 1):
        ratio = 2 ** (off / per_octave)
        number = round(ratio)
        share = abs(ratio - number) / math.log(reach)
        if number > 0 and share < 1:
            found.append((off, math.cos(share * math.pi / 2) ** 2 * decay ** (number - 1)))
    total = sum(w for _, w in found)
    return [(off, w / total) for off, w in found]


def harmonic_profile(
    spectrum: DataFrame, width: int, rate: float, lowest: float = 100.0, highest: float = 5000.0, floor_db: float = 80.0, local_db: float = 30.0, per_octave: int = 12,
    whitening: float | None = 1 / 3, decay: float = 0.6, tolerance: float = 2 / 3, norm: bool = False, threshold: float = 0.0,
) -> DataFrame:
    """Harmonic pitch class profile of a spectrum (series_id, frame, bin, mag): series_id, frame, pitch (0 to per_octave - 1), v.

    Bins between the two frequencies are taken in decibels above floor_db below the series' largest; what lies more than local_db below the frame's largest counts as nothing (if local_db is the
    smaller). Local maxima, placed between bins by a parabola, are summed on pitch bins (MIDI, per_octave to an octave) at linear magnitude; the mean over `whitening` of an octave around is
    taken off; each bin gives to those at near whole ratios (harmonic_weights); octaves are summed, without the series' highest, which is cut anywhere.

    norm: less the frame's smallest class, over its largest, and what is not above `threshold` is nothing. Frames without a peak have no rows; a frame with one has all its classes; null and zero
    magnitudes are no peaks. Only sums by frame and the series' two extremes are shuffled."""
    hz = F.col("bin") * (rate / width)
    rows = spectrum.where((hz > lowest) & (hz < highest)).select("series_id", "frame", "bin", F.when(F.col("mag") > 0, 20 * F.log10("mag")).alias("_db"))
    tops = rows.groupBy("series_id").agg(F.max("_db").alias("_top"))
    frame = Window.partitionBy("series_id", "frame")
    rows = rows.join(tops, "series_id").withColumn("_x", F.greatest(F.coalesce(F.col("_db") - F.col("_top") + floor_db, F.lit(0.0)), F.lit(0.0)))
    if local_db < floor_db:
        rows = rows.withColumn("_x", F.when(F.col("_x") >= F.max("_x").over(frame) - local_db, F.col("_x")).otherwise(0.0))
    shift, height = parabolic_peak("_x", frame.orderBy("bin"))
    peaks = rows.withColumns({"_shift": shift, "_height": height, "_peak": is_peak("_x", frame.orderBy("bin"))}).where("_peak")
    midi = 69 + 12 * F.log2((F.col("bin") + F.col("_shift")) * (rate / width) / 440)
    place = (midi * (per_octave / 12)).cast("int")
    profile = peaks.groupBy("series_id", "frame", place.alias("_p")).agg(F.sum(F.pow(F.lit(10.0), (F.col("_height") - floor_db) / 20)).alias("_v"))
    highest_octave = F.floor(F.max("_p").over(Window.partitionBy("series_id")) / per_octave) * per_octave
    profile = profile.withColumn("_end", highest_octave)
    span = int(per_octave * whitening) if whitening else 0
    if span:
        near = frame.orderBy("_p").rangeBetween(-(span // 2), (span - 1) // 2)
        profile = profile.withColumn("_v", F.greatest(F.col("_v") - F.sum("_v").over(near) / span, F.lit(0.0)))
    given = F.array(*[F.struct(F.lit(off).alias("off"), F.lit(w).alias("w")) for off, w in harmonic_weights(per_octave, decay, tolerance)])
    parts = profile.select("series_id", "frame", "_p", "_v", "_end", F.explode(given).alias("_g")).withColumn("_to", F.col("_p") + F.col("_g.off"))
    share = F.when((F.col("_to") >= 0) & (F.col("_to") < F.col("_end")), F.col("_v") * F.col("_g.w"))
    classes = [F.coalesce(F.sum(F.when(F.pmod(F.col("_to"), F.lit(per_octave)) == c, share)), F.lit(0.0)).alias(f"_{c}") for c in range(per_octave)]
    wide = parts.groupBy("series_id", "frame").agg(F.array(*classes).alias("_c"))
    if norm:
        low = F.array_min("_c")
        wide = wide.withColumn("_c", F.transform("_c", lambda v: v - low)).where(F.array_max("_c") > 0)
        top = F.array_max("_c")
        wide = wide.withColumn("_c", F.transform("_c", lambda v: v / top))
        if threshold > 0:
            wide = wide.withColumn("_c", F.transform("_c", lambda v: F.when(v > threshold, (1 - threshold) * (v - threshold)).otherwise(0.0)))
    return wide.select("series_id", "frame", F.posexplode("_c").alias("pitch", "v"))


def banded_onsets(series: DataFrame, width: int, hop: int, rate: float, cuts: tuple[float, float]) -> DataFrame:
    """series_id, band, t, v: onset strength of the whole signal and of what lies below, between and above two cut-offs."""
    low, high = cuts
    bands = {"full": series, "low": biquad(series, "low", low, rate), "mid": band_pass(series, low, high, rate), "high": biquad(series, "high", high, rate)}
    out = None
    for name, one in bands.items():
        rows = stft(frames(one, width, hop), width).select("series_id", F.col("frame").alias("t"), F.col("bin").alias("ch"), F.col("mag").alias("v"))
        found = onset_strength(rows).select("series_id", F.lit(name).alias("band"), "t", "v")
        out = found if out is None else out.unionByName(found)
    return out


def fused_onsets(bins: DataFrame) -> DataFrame:
    """series_id, t, v: five onset functions of a complex spectrum (series_id, frame, bin, re, im), each scaled to 0..1, summed, clamped at its 97 percent
    quantile and scaled: squared rises; rises; rises over the largest neighbouring bin before; the distance from the spectrum that goes on
    from the two frames before with their magnitude and turn; and a logarithmic divergence from the frame before."""
    bin_ = Window.partitionBy("series_id", "bin").orderBy("frame")
    around = Window.partitionBy("series_id", "frame").orderBy("bin").rowsBetween(-1, 1)
    rows = bins.withColumn("m", F.hypot("re", "im")).withColumn("wide", F.max("m").over(around))
    before = lambda c, k=1: F.coalesce(F.lag(c, k).over(bin_), F.lit(0.0))
    rows = rows.withColumns({"p": before("m"), "pw": before("wide"), "pr": before("re"), "pi": before("im"), "qr": before("re", 2), "qi": before("im", 2), "q": before("m", 2)})
    rise = F.greatest(F.col("m") - F.col("p"), F.lit(0.0))
    # the frame before, turned on by its own turn: p · (z / |z|)² · conj(y) / |y|, with z one and y two frames before
    scale = F.coalesce(F.try_divide(F.lit(1.0), F.col("p") * F.col("q")), F.lit(0.0))
    a, b = F.col("pr") * F.col("pr") - F.col("pi") * F.col("pi"), 2 * F.col("pr") * F.col("pi")
    er, ei = scale * (a * F.col("qr") + b * F.col("qi")), scale * (b * F.col("qr") - a * F.col("qi"))
    kinds = {
        "diff": F.sum(rise * rise), "flux": F.sum(rise), "superflux": F.sum(F.greatest(F.col("m") - F.col("pw"), F.lit(0.0))),
        "complex": F.sum(F.hypot(F.col("re") - er, F.col("im") - ei)), "divergence": F.sum(F.ln(1 + F.col("m") / (F.col("p") + 1e-6))),
    }
    each = rows.groupBy("series_id", F.col("frame").alias("t")).agg(*[v.alias(k) for k, v in kinds.items()])
    total = each.select("series_id", "t", sum((N.minmax(k) for k in kinds), F.lit(0.0)).alias("v"))
    return N.clamp(total, ["series_id"], None, 0.97).withColumn("v", N.minmax())


def tempogram(series: DataFrame, width: int, hop: int = 1) -> DataFrame:
    """Autocorrelation of each Hann-weighted stretch of an envelope, over its largest value: series_id, frame, lag, r."""
    window = np.array(hann(width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()) * window
                z = np.fft.rfft(x, 2 * width)
                r = np.fft.irfft(z * z.conj(), 2 * width)[:, :width]
                r = r / np.maximum(np.abs(r).max(axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"series_id": b["series_id"], "frame": b["frame"], "r": list(r)})

    kind = series.schema["series_id"].dataType.simpleString()
    rows = gathered(frames(series, width, hop)).mapInPandas(run, f"series_id {kind}, frame int, r array<double>")
    return rows.select("series_id", "frame", F.posexplode("r").alias("lag", "r"))


def local_pulse(series: DataFrame, width: int, rate: float, slowest: float = 60.0, fastest: float = 180.0) -> DataFrame:
    """series_id, t, v: the pulse that an envelope follows locally. Each stretch gives its strongest frequency between two tempi (beats a minute), as a
    windowed cosine with the stretch's phase; these are added where they overlap; the positive part is scaled to 0..1."""
    bpm = np.arange(width // 2 + 1) * 60.0 * rate / width
    near, window, basis = (bpm >= slowest) & (bpm <= fastest), np.array(hann(width)), fourier(width)
    if not near.any():
        raise ValueError("no frequency of the transform lies between the two tempi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(width)
        for b in batches:
            if len(b):
                z = np.where(near, np.stack(b["x"].to_numpy()) @ basis, 0)
                k = np.abs(z).argmax(axis=1)
                top = z[np.arange(len(z)), k]
                phase = np.where(np.abs(top) > 0, np.angle(top), np.nan)
                wave = np.nan_to_num(window * np.cos(2 * np.pi * np.outer(k, place) / width + phase[:, None]))
                # waves of a series are added within the batch, which is sorted
                ids, first, found = b["series_id"].tolist(), b["frame"].to_numpy(), []
                cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                for i, j in zip(cuts, [*cuts[1:], len(ids)]):
                    at = first[i:j] - first[i]
                    total, held = np.zeros(at[-1] + width), np.zeros(at[-1] + width, bool)
                    for k in place:
                        total[at + k] += wave[i:j, k]
                        held[at + k] = True
                    t = np.flatnonzero(held)
                    found.append((i, (t + first[i] - width // 2).astype("int32"), total[t]))
                of = np.repeat([i for i, *_ in found], [len(t) for _, t, _ in found])
                yield pd.DataFrame({"series_id": b["series_id"].iloc[of].reset_index(drop=True), "t": np.concatenate([t for _, t, _ in found]), "w": np.concatenate([w for *_, w in found])})

    kind = series.schema["series_id"].dataType.simpleString()
    rows = gathered(frames(series, width, 1)).sortWithinPartitions("series_id", "frame").mapInPandas(run, f"series_id {kind}, t int, w double")
    sums = rows.groupBy("series_id", "t").agg(F.sum("w").alias("v"))
    met = series.select("series_id", F.col("t").cast("int").alias("t")).join(sums, ["series_id", "t"], "left").withColumn("v", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    return met.withColumn("v", N.minmax())


def mean_chroma(estimates: dict[str, DataFrame], frames_: int) -> DataFrame:
    """Several chroma estimates (series_id, frame, pitch, v), each brought to one number of frames, averaged: series_id, t, ch, v."""
    out = None
    for one in estimates.values():
        keyed = one.select(F.struct("series_id", "pitch").alias("series_id"), F.col("frame").cast("int").alias("t"), "v")
        grid = linear_resample(keyed, frames_)
        out = grid if out is None else out.unionByName(grid)
    return out.groupBy("series_id", "t").agg(F.avg("v").alias("v")).select("series_id.series_id", "t", F.col("series_id.pitch").alias("ch"), "v")


#: The names and widths of the feature table's blocks, in the order of its columns.
FEATURES = (
    ("mfcc", 20), ("chroma", 12), ("tonnetz", 6), ("contrast", 7), ("flatness", 1), ("onset", 1), ("onset_low", 1), ("onset_mid", 1), ("onset_high", 1), ("pulse", 1),
    ("rms", 1), ("rms_low", 1), ("rms_mid", 1), ("rms_high", 1), ("drop", 1), ("drop_low", 1), ("drop_mid", 1), ("drop_high", 1),
)


def features(series: DataFrame, width: int = 64, hop: int = 2, rate: float = 24.0, clamp: bool = True, smooth: float = 0.1) -> DataFrame:
    """The blocks of FEATURES in long form: series_id, t, name, ch, v. All come from one spectrum and its harmonic and percussive parts; low, mid and high are thirds
    of the bins. Each channel is clamped to its peaks and above its lowest tenth, and smoothed."""
    bins, fps = width // 2 + 1, rate / hop
    split = settled(harmonic_percussive(stft(frames(series, width, hop), width)))  # all blocks read it
    whole_ = split.withColumn("mag", F.col("harmonic") + F.col("percussive"))
    frame_key = ["series_id", "frame"]
    name = lambda df, n, ch=None: df.select("series_id", F.col("frame").cast("int").alias("t"), F.lit(n).alias("name"), (F.lit(0) if ch is None else F.col(ch).cast("int")).alias("ch"), "v")
    bands = filter_bank(whole_.withColumn("mag", F.col("mag") * F.col("mag")), triangles(bins, 24)).withColumn("v", 10 * F.log10(F.greatest("v", F.lit(1e-10))))
    pitch = F.pmod(F.round(12 * F.log2(F.col("bin") * (rate / width))), F.lit(12)).cast("int")
    chroma = split.where("bin > 0").groupBy(*frame_key, pitch.alias("pitch")).agg(F.sum("harmonic").alias("v"))
    grid = chroma.select(*frame_key).distinct().withColumn("pitch", F.explode(F.sequence(F.lit(0), F.lit(11))))
    chroma = grid.join(chroma, [*frame_key, "pitch"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    steady = settled(cens(chroma))
    octave = F.least(F.floor(F.log2(F.greatest(F.col("bin"), F.lit(1)) + 0.0) + 1), F.lit(6)).cast("int")
    octave = F.when(F.col("bin") == 0, 0).otherwise(octave)
    contrast = edge_contrast(whole_.withColumn("band", octave), [*frame_key, "band"], "mag", "bin", 0.02).withColumnRenamed("contrast", "v")
    flat = whole_.withColumn("_m", F.col("mag") + 1e-10).groupBy(*frame_key).agg(flatness("_m").alias("v"))
    parts = {"": F.lit(True), "_low": F.col("bin") < bins // 3, "_mid": (F.col("bin") >= bins // 3) & (F.col("bin") < 2 * (bins // 3)), "_high": F.col("bin") >= 2 * (bins // 3)}
    out = [name(dct(bands, 24, 20), "mfcc", "coef"), name(steady, "chroma", "pitch"), name(tonal_centroids(steady), "tonnetz", "axis"), name(contrast, "contrast", "band"), name(flat, "flatness")]
    for part, where in parts.items():
        percussive = split.where(where).select("series_id", F.col("frame").alias("t"), F.col("bin").alias("ch"), F.col("percussive").alias("v"))
        out.append(name(onset_strength(percussive).withColumnRenamed("t", "frame"), f"onset{part}"))
        rms = split.where(where).groupBy(*frame_key).agg((F.sqrt(2 * F.sum(F.col("harmonic") * F.col("harmonic"))) / width).alias("v"))
        out.append(name(rms, f"rms{part}"))
        drop = N.emphasize(gaussian(rms.withColumnRenamed("frame", "t"), 10.0), 10.0, 0.5)
        out.append(name(drop.select("series_id", F.col("t").alias("frame"), "v"), f"drop{part}"))
    strength = onset_strength(split.select("series_id", F.col("frame").alias("t"), F.col("bin").alias("ch"), F.col("percussive").alias("v")), how="median")
    out.append(name(local_pulse(strength, 16, fps, 60.0, 240.0).withColumnRenamed("t", "frame"), "pulse"))
    long = out[0]
    for one in out[1:]:
        long = long.unionByName(one)
    keyed = settled(long.select(F.struct("series_id", "name", "ch").alias("series_id"), "t", F.coalesce("v", F.lit(0.0)).alias("v")))
    if clamp:
        keyed = N.clamp(N.clamp_to_peaks(keyed, 0.975), ["series_id"], 0.1, None)
    if smooth:
        keyed = gaussian(keyed, smooth * fps)
    return keyed.select("series_id.series_id", "t", "series_id.name", "series_id.ch", "v")


def wide_features(long: DataFrame) -> DataFrame:
    """series_id, t and one column for each channel of FEATURES (59)."""
    columns = [f"{n}_{k}" if w > 1 else n for n, w in FEATURES for k in range(w)]
    single = F.array(*[F.lit(n) for n, w in FEATURES if w == 1])
    key = F.when(F.array_contains(single, F.col("name")), F.col("name")).otherwise(F.concat_ws("_", "name", F.col("ch").cast("string")))
    # dealt by frame first: else the wide rows of the pivot are dealt, many for each frame
    return long.withColumn("_c", key).repartition("series_id", "t").groupBy("series_id", "t").pivot("_c", columns).agg(F.first("v"))


#: Features that a piece is segmented by.
SEGMENTED = ("chroma", "tonnetz", "mfcc", "contrast", "flatness", "rms", "drop", "onset")


def music_information(series: DataFrame, ks: tuple[int, ...] = (2, 4, 6, 8, 12, 16), width: int = 64, hop: int = 2, rate: float = 24.0, names: tuple[str, ...] = SEGMENTED) -> dict[str, DataFrame]:
    """Three tables of each series: `features` (series_id, t, name, ch, v), smoothed, weighted by their salience and scaled to 0 to 1; `segments` (series_id, name, k, t, label)
    of each feature of `names`, found at beats and spread over the frames; and `tempo`. Beats follow each series' own tempo."""
    long = settled(features(series, width, hop, rate))
    onsets = settled(long.where("name = 'onset'").select("series_id", "t", "v"))
    speed = settled(tempo(onsets, 24, rate / hop))
    found = settled(beats(onsets.join(speed.select("series_id", F.round(60.0 * rate / hop / F.col("bpm")).cast("int").alias("period")), "series_id"), None))
    rows = long.where(F.col("name").isin(*names)).groupBy(F.struct("series_id", "name").alias("series_id"), "t").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("_x"))
    rows = rows.select("series_id", "t", F.transform("_x", lambda c: c["v"]).alias("x"))
    each = found.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names]))).select(F.struct("series_id", "name").alias("series_id"), "t")
    points = settled(beat_synchronous(rows, each))
    segments = laplacian_segmentations(settled(segment_links(points)), list(ks))
    frames_ = stretched(segments, rows.groupBy("series_id").agg(F.count("*").alias("n")))
    keyed = long.select(F.struct("series_id", "name", "ch").alias("series_id"), "t", "v")
    weighted = salience(gaussian(keyed, 2.0)).withColumn("v", F.coalesce("v", F.lit(0.0))).withColumn("v", N.minmax())
    return {"features": weighted.select("series_id.series_id", "t", "series_id.name", "series_id.ch", "v"), "segments": frames_.select("series_id.series_id", "series_id.name", "k", "t", "label"), "tempo": speed}
