"""Queries over group statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import groups as G
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.sources import tables as S


def t_():
    """The frame as a long."""
    return F.col("t").cast("long").alias("t")



def frames(spark, d):
    return S.events_series(spark, d)


@query("a1_median_std", "SELECT l_returnflag, l_linestatus, round(median(l_quantity), 6) AS mid, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1, 2")
def a1(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.median("l_quantity")).alias("mid"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("std"))


@query("a2_group_profile", "SELECT o_orderpriority, min(o_totalprice) AS low, median(o_totalprice) AS mid, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1")
def a2(spark, d):
    p = "o_totalprice"
    return S.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(p).alias("low"), F.median(p).alias("mid"), F.round(F.avg(p), 4).alias("mean"), F.max(p).alias("high"), F.count("*").alias("n"))


@query("a3_marginals", "WITH c AS (SELECT p_brand, p_size, median(p_retailprice) AS m FROM part GROUP BY 1, 2) SELECT p_brand, p_size, round(avg(m), 6) AS mean, round(median(m), 6) AS mid FROM c GROUP BY GROUPING SETS ((p_brand), (p_size))")
def a3(spark, d):
    return G.marginals(S.table(spark, d, "part"), "p_brand", "p_size", "p_retailprice").select("p_brand", "p_size", r6(F.col("mean")).alias("mean"), r6(F.col("mid")).alias("mid"))


@query("a4_group_split_max", "SELECT l_shipmode AS kind, l_returnflag, max(l_extendedprice) AS high FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2")
def a4(spark, d):
    return S.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("kind"), "l_returnflag").agg(F.max("l_extendedprice").alias("high"))


@query("a5_histogram", "WITH b AS (SELECT c_mktsegment, least(floor((c_acctbal + 1000) / 500), 21)::INT AS bin FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000), n AS (SELECT c_mktsegment, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT *, round(n / (sum(n) OVER (PARTITION BY c_mktsegment) * 500), 9) AS density FROM n")
def a5(spark, d):
    return G.histogram(S.table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", -1000.0, 10000.0, 22).withColumn("density", F.round("density", 9))


@query("a6_a7_range_histogram", f"WITH {SERIES}, e AS (SELECT series_id, min(v) AS a, max(v) AS b FROM s GROUP BY 1), h AS (SELECT series_id, least(floor((v - a) / (b - a) * 10), 9)::INT AS bin, count(*) AS n FROM s JOIN e USING (series_id) GROUP BY 1, 2) SELECT *, round(n / max(n) OVER (PARTITION BY series_id), 6) AS scaled FROM h")
def a6(spark, d):
    return G.range_histogram(frames(spark, d), ["series_id"], "v", 10).withColumn("scaled", r6(F.col("scaled")))


@query("a8_confusion", "WITH g AS (SELECT a::INT AS target, b::INT AS predicted FROM range(10) AS x(a), range(10) AS y(b)), c AS (SELECT label AS target, (vec_id * 7 % 10)::INT AS predicted, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT target, predicted, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (target, predicted)")
def a8(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.col("label").alias("target"), (F.col("vec_id") * 7 % 10).alias("predicted"))
    return G.confusion(rows, "target", "predicted", 10)


@query("a9_directogram", f"WITH {SERIES}, a AS (SELECT series_id, abs(v) AS mag, (t * 37 % 256)::INT AS ang FROM s), c AS (SELECT i AS bin, i * 32 + 16 AS c FROM range(8) AS k(i)), m AS (SELECT a.*, (SELECT min(bin) FROM c WHERE ((c - ang) % 256 + 256) % 256 <= 32) AS bin FROM a) SELECT series_id, bin, round(sum(mag) / 255, 6) AS v FROM m GROUP BY 1, 2")
def a9(spark, d):
    rows = frames(spark, d).select("series_id", F.abs("v").alias("mag"), (F.col("t") * 37 % 256).alias("ang"))
    return G.directogram(rows, ["series_id"], "mag", "ang", 8).select("series_id", "bin", r6(F.col("v")).alias("v"))


@query("a10_frame_rms", f"WITH {SERIES} SELECT series_id, t // 8 AS frame, round(sqrt(avg(v * v)), 6) AS rms FROM s GROUP BY 1, 2")
def a10(spark, d):
    return frames(spark, d).groupBy("series_id", F.floor(F.col("t") / 8).alias("frame")).agg(r6(F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("rms"))


@query("a11_frame_variance", f"WITH {VECTORS} SELECT series_id, t, round(var_samp(v), 9) AS var FROM x GROUP BY 1, 2")
def a11(spark, d):
    return S.vectors_long(spark, d).groupBy("series_id", "t").agg(F.round(F.var_samp("v"), 9).alias("var")).select("series_id", t_(), "var")


@query("a12_laplace", "WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS location FROM customer GROUP BY 1) SELECT c_mktsegment, round(location, 6) AS location, round(avg(abs(c_acctbal - location)), 6) AS scale FROM customer JOIN m USING (c_mktsegment) GROUP BY 1, 2")
def a12(spark, d):
    return G.laplace_fit(S.table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", r6(F.col("location")).alias("location"), r6(F.col("scale")).alias("scale"))


@query("a13_t_statistic", "WITH g AS (SELECT c_mktsegment, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, avg(c_acctbal) FILTER (k = 0) AS m0, avg(c_acctbal) FILTER (k = 1) AS m1, var_samp(c_acctbal) FILTER (k = 0) AS s0, var_samp(c_acctbal) FILTER (k = 1) AS s1 FROM (SELECT *, c_nationkey % 2 AS k FROM customer) GROUP BY 1) SELECT c_mktsegment, round((m0 - m1) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)), 6) AS t, n0 + n1 - 2 AS dof FROM g")
def a13(spark, d):
    rows = S.table(spark, d, "customer").withColumn("k", F.col("c_nationkey") % 2)
    return G.t_statistic(rows, ["c_mktsegment"], "k", "c_acctbal").select("c_mktsegment", r6(F.col("t")).alias("t"), "dof")


PAIRS = "p AS (SELECT a.series_id, a.v AS x, b.v AS y FROM s a JOIN s b ON b.series_id = a.series_id + 1 AND b.t = a.t)"


def pairs(spark, d):
    a = frames(spark, d)
    return a.select("series_id", "t", F.col("v").alias("x")).join(a.select((F.col("series_id") - 1).alias("series_id"), "t", F.col("v").alias("y")), ["series_id", "t"])


@query("a14_a15_differences", f"WITH {SERIES}, {PAIRS} SELECT series_id, round(sum(abs(x - y)), 6) AS l1, round(sqrt(sum((x - y) * (x - y))), 6) AS l2, round(avg((x - y) * (x - y)), 6) AS mse FROM p GROUP BY 1")
def a14(spark, d):
    gap = F.col("x") - F.col("y")
    return pairs(spark, d).groupBy("series_id").agg(r6(F.sum(F.abs(gap))).alias("l1"), r6(F.sqrt(F.sum(gap * gap))).alias("l2"), r6(F.avg(gap * gap)).alias("mse"))


@query("a16_trials", "SELECT l_linenumber AS trial, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std FROM lineitem GROUP BY 1")
def a16(spark, d):
    return S.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("trial")).agg(r6(F.avg("l_discount")).alias("mean"), r6(F.stddev_pop("l_discount")).alias("std"))


@query("a17_bootstrap_median")
def a17(spark, d):
    rows = S.table(spark, d, "events").select("event_type", "event_id", "value")
    return G.bootstrap_median(rows, ["event_type"], "event_id", "value", 50)


@query("a18_density_mode", f"WITH {SERIES}, g AS (SELECT grp, x::DOUBLE AS x, avg(exp(-0.5 * pow((x - v) / 8, 2))) / (8 * sqrt(2 * pi())) AS d FROM s, range(0, 101, 10) AS k(x) GROUP BY 1, 2) SELECT grp, max_by(x, round(d, 12)) AS mode, round(max(d), 9) AS density FROM g GROUP BY 1")
def a18(spark, d):
    curve = G.density(frames(spark, d), ["grp"], "v", [float(x) for x in range(0, 101, 10)], 8.0)
    return curve.groupBy("grp").agg(F.max_by("x", F.round("density", 12)).alias("mode"), F.round(F.max("density"), 9).alias("density"))


@query("a19_flatness", "SELECT l_suppkey, round(exp(avg(ln(l_extendedprice))) / avg(l_extendedprice), 6) AS flat FROM lineitem GROUP BY 1")
def a19(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(G.flatness("l_extendedprice")).alias("flat"))


@query("a20_edge_contrast", f"WITH {SERIES}, r AS (SELECT *, t // 16 AS band, row_number() OVER (PARTITION BY series_id, t // 16 ORDER BY v, t) AS r, count(*) OVER (PARTITION BY series_id, t // 16) AS n FROM s), m AS (SELECT *, greatest(1, floor(0.25 * n)) AS m FROM r) SELECT series_id, band, round(avg(v) FILTER (r > n - m) - avg(v) FILTER (r <= m), 6) AS contrast FROM m GROUP BY 1, 2")
def a20(spark, d):
    rows = frames(spark, d).withColumn("band", F.floor(F.col("t") / 16))
    return G.edge_contrast(rows, ["series_id", "band"], "v", "t", 0.25).withColumn("contrast", r6(F.col("contrast")))


@query("a21_histogram_peak", f"WITH {SERIES}, h AS (SELECT series_id, floor(v / 10)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, bin) AS k FROM h) SELECT series_id, bin, n FROM r WHERE k = 1")
def a21(spark, d):
    counts = frames(spark, d).groupBy("series_id", F.floor(F.col("v") / 10).alias("bin")).agg(F.count("*").alias("n"))
    return counts.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m")).select("series_id", (-F.col("m.b")).alias("bin"), "m.n")


@query("a22_folded_sums", f"WITH {VECTORS} SELECT series_id, t, ch % 12 AS pitch, round(sum(v), 6) AS v FROM x WHERE ch < 60 GROUP BY 1, 2, 3")
def a22(spark, d):
    return S.vectors_long(spark, d).where("ch < 60").groupBy("series_id", "t", (F.col("ch") % 12).cast("long").alias("pitch")).agg(r6(F.sum("v")).alias("v")).select("series_id", t_(), "pitch", "v")


@query("a23_sparse_accumulate", f"WITH {SERIES} SELECT series_id, (abs(v) / 7)::BIGINT AS bin, round(sum(v), 6) AS total FROM (SELECT series_id, floor(abs(v) / 7) * 7 AS q, v FROM s) GROUP BY 1, 2".replace("(abs(v) / 7)::BIGINT", "(q / 7)::BIGINT"))
def a23(spark, d):
    return frames(spark, d).groupBy("series_id", F.floor(F.abs("v") / 7).alias("bin")).agg(r6(F.sum("v")).alias("total"))


@query("a24_distinct", "SELECT DISTINCT event_type, json_extract_string(props, '$.k')::INT AS k FROM events")
def a24(spark, d):
    return S.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()


@query("a25_weighted_average", f"WITH {VECTORS} SELECT series_id, t, round(sum(ch * (abs(v) + 1e-8)) / sum(abs(v) + 1e-8), 6) AS centre FROM x GROUP BY 1, 2")
def a25(spark, d):
    w = F.abs("v") + 1e-8
    return S.vectors_long(spark, d).groupBy("series_id", "t").agg(r6(F.sum(F.col("ch") * w) / F.sum(w)).alias("centre")).select("series_id", t_(), "centre")


@query("a26_strongest_channel", f"WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, ch) AS k FROM x) SELECT vec_id, ch FROM r WHERE k = 1")
def a26(spark, d):
    best = F.max(F.struct("v", (-F.col("ch")).alias("c")))
    return S.vectors_long(spark, d).groupBy("vec_id").agg(best.alias("m")).select("vec_id", (-F.col("m.c")).cast("long").alias("ch"))
