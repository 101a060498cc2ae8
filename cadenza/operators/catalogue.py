"""Features and measures by name, so that jobs can be put together from configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import measures, rows, spectra, windows

#: Name to a function from a series (series_id, t, v) and its rate to channels (series_id, t, ch, v).
FEATURES: dict[str, Callable[[DataFrame, float], DataFrame]] = {}
#: Name to a function from two groups of channels to one score a series (series_id, score).
MEASURES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def feature(name: str):
    """Register a feature under a name."""

    def put(f):
        FEATURES[name] = f
        return f

    return put


def compute(series: DataFrame, names: list[str], rate: float = 24.0) -> DataFrame:
    """series_id, t, name, ch, v of the named features."""
    out = None
    for name in names:
        one = series.transform(FEATURES[name], rate).select("series_id", "t", F.lit(name).alias("name"), "ch", "v")
        out = one if out is None else out.unionByName(one)
    return out


def compare(x: DataFrame, y: DataFrame, names: list[str]) -> DataFrame:
    """series_id, measure, score of the named measures."""
    out = None
    for name in names:
        one = MEASURES[name](x, y).select("series_id", F.lit(name).alias("measure"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def summarised(series: DataFrame, slices: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
    """One aggregate, which the caller gives as a function of the value, for each slice."""
    return rows.aggregate_slices(series, slices, how(F.col("v")))


@feature("value")
def value(series: DataFrame, rate: float) -> DataFrame:
    """The series itself."""
    return series.select("series_id", F.col("t").cast("int").alias("t"), F.lit(0).alias("ch"), "v")


@feature("flux")
def flux(series: DataFrame, rate: float) -> DataFrame:
    """Steps to the next frame."""
    return series.select("series_id", F.col("t").cast("int").alias("t"), F.lit(0).alias("ch"), windows.flux().alias("v"))


@feature("smooth")
def smooth(series: DataFrame, rate: float) -> DataFrame:
    """Smoothed over a twelfth of a second."""
    return windows.gaussian(series, rate / 12).select("series_id", "t", F.lit(0).alias("ch"), "v")


@feature("chroma")
def chroma(series: DataFrame, rate: float) -> DataFrame:
    """Folded constant-Q magnitudes."""
    bins = spectra.constant_q(series, 4, rate, rate / 16, 12, 6)
    return spectra.folded(bins).select("series_id", F.col("frame").alias("t"), F.col("pitch").alias("ch"), "v")


@feature("tonnetz")
def tonnetz(series: DataFrame, rate: float, base: str = "chroma") -> DataFrame:
    """Tonal centroids of another feature, named by `base`."""
    grid = FEATURES[base](series, rate).select("series_id", F.col("t").alias("frame"), F.col("ch").alias("pitch"), "v")
    return spectra.tonal_centroids(grid).select("series_id", F.col("frame").alias("t"), F.col("axis").alias("ch"), "v")


def _measure(name: str, family: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    MEASURES[name] = lambda x, y: family(x, y).select("series_id", F.col(name).alias("score"))


for _name in measures.RV_NAMES:
    _measure(_name, measures.moment_measures)
for _name in measures.SUBSPACE_NAMES:
    _measure(_name, measures.small_matrix_measures)
MEASURES["pearson"] = lambda x, y: measures.pearson_median(x, y).withColumnRenamed("r", "score")
