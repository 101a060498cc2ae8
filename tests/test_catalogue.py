"""Features and measures by name."""

from pyspark.sql import functions as F

from cadenza.operators import catalogue as K
from cadenza.sources import tables as S

FOLDER = "/root/testdata/sf0.001"


def test_features_by_name(spark):
    rows = S.events_series(spark, FOLDER).select("series_id", "t", "v")
    found = K.compute(rows, ["value", "flux", "smooth", "tonnetz"]).groupBy("name").agg(F.count_distinct("ch").alias("n")).collect()
    assert {r["name"]: r["n"] for r in found} == {"value": 1, "flux": 1, "smooth": 1, "tonnetz": 6}


def test_measures_by_name(spark):
    rows = S.vectors_long(spark, FOLDER)
    x = rows.where("ch < 8")
    found = K.compare(x, x, ["rv", "pearson", "svcca"]).groupBy("measure").agg(F.min("score").alias("s")).collect()
    assert {r["measure"]: round(r["s"], 6) for r in found} == {"rv": 1, "pearson": 1, "svcca": 1}


def test_slices_with_a_callback(spark):
    slices = spark.createDataFrame([(0, 0, 10), (1, 5, 20)], "slice_id int, start int, stop int")
    rows = S.events_series(spark, FOLDER)
    assert K.summarised(rows, slices, F.max).count() == 2 * rows.select("series_id").distinct().count()
