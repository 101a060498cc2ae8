"""Queries over filters, joins, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import rows as R
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.sources import tables as S


def t_():
    """The frame as a long."""
    return F.col("t").cast("long").alias("t")



def long_series(spark, d):
    return S.events_series(spark, d)


@query("p1_crop", f"WITH {SERIES} SELECT series_id, t, v FROM s WHERE t >= 10 AND t < 40")
def p1(spark, d):
    return R.crop(long_series(spark, d), 10, 40).select("series_id", t_(), "v")


@query("p2_min_length", f"WITH {SERIES} SELECT series_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 60")
def p2(spark, d):
    return R.longer_than(long_series(spark, d), 60).groupBy("series_id").agg(F.count("*").alias("n"))


@query("p3_result_filters", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'click' AND event_type NOT LIKE 'p%' AND value >= 0")
def p3(spark, d):
    return S.table(spark, d, "events").where((F.col("event_type") != "click") & ~F.col("event_type").startswith("p") & (F.col("value") >= 0)).select("event_id", "event_type", "value")


@query("p4_multi_equality", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1")
def p4(spark, d):
    rows = S.table(spark, d, "lineitem")
    return rows.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p5_range_mask", f"WITH {VECTORS} SELECT vec_id, ch, round(v, 6) AS v FROM x WHERE ch > 8 AND ch < 24")
def p5(spark, d):
    return S.vectors_long(spark, d).where((F.col("ch") > 8) & (F.col("ch") < 24)).select("vec_id", F.col("ch").cast("long").alias("ch"), r6(F.col("v")).alias("v"))


@query("p6_thresholds", f"WITH {SERIES}, a AS (SELECT series_id, t, CASE WHEN v < max(v) OVER (PARTITION BY series_id) - 40 THEN 0 ELSE v END AS v FROM s) SELECT series_id, t, CASE WHEN v < (SELECT max(v) FROM a) - 60 THEN 0 ELSE v END AS v FROM a")
def p6(spark, d):
    return R.global_threshold(R.local_threshold(long_series(spark, d), ["series_id"], 40.0), 60.0).select("series_id", t_(), "v")


@query("p7_peaks", f"WITH {SERIES}, w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, v FROM w WHERE v > a AND v > b")
def p7(spark, d):
    return long_series(spark, d).withColumn("peak", R.is_peak()).where("peak").select("series_id", t_(), "v")


@query("p8_half_peaks", f"WITH {SERIES}, w AS (SELECT *, lag(v, 1, 0.0) OVER o AS a, lead(v, 1, 0.0) OVER o AS b FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, count(*) AS n FROM w WHERE v > a AND v >= b GROUP BY 1")
def p8(spark, d):
    return long_series(spark, d).withColumn("peak", R.is_half_peak()).where("peak").groupBy("series_id").agg(F.count("*").alias("n"))


@query("p9_iqr_outliers", "WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer GROUP BY 1) SELECT c_custkey, c_acctbal FROM customer JOIN q USING (c_mktsegment) WHERE c_acctbal < a - 0.4 * (b - a) OR c_acctbal > b + 0.4 * (b - a)")
def p9(spark, d):
    return R.iqr_outliers(S.table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", 0.4).select("c_custkey", "c_acctbal")


@query("p10_perturb", f"WITH {VECTORS} SELECT 'negate' AS kind, ch, round(sum(CASE WHEN ch >= 8 AND ch < 16 THEN -v ELSE v END), 6) AS total FROM x GROUP BY 2 UNION ALL SELECT 'zero', ch, round(sum(CASE WHEN ch >= 8 AND ch < 16 THEN 0 ELSE v END), 6) FROM x GROUP BY 2 UNION ALL SELECT 'double', ch, round(sum(CASE WHEN ch >= 8 AND ch < 16 THEN 2 * v ELSE v END), 6) FROM x GROUP BY 2")
def p10(spark, d):
    rows, out = S.vectors_long(spark, d), None
    for kind in ("negate", "zero", "double"):
        one = R.perturb(rows, kind, 8, 16).groupBy("ch").agg(r6(F.sum("v")).alias("total")).select(F.lit(kind).alias("kind"), F.col("ch").cast("long").alias("ch"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("p11_keep_top", f"WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, ch) AS k FROM x) SELECT vec_id, round(sum(CASE WHEN k <= 5 THEN v ELSE 0 END), 6) AS total, count(*) AS n FROM r GROUP BY 1")
def p11(spark, d):
    return R.keep_top(S.vectors_long(spark, d), ["vec_id"], 5, "ch").groupBy("vec_id").agg(r6(F.sum("v")).alias("total"), F.count("*").alias("n"))


@query("p12_energy_sparsify", f"WITH {VECTORS}, r AS (SELECT *, sum(abs(v)) OVER (PARTITION BY vec_id ORDER BY abs(v), ch ROWS UNBOUNDED PRECEDING) AS a, sum(abs(v)) OVER (PARTITION BY vec_id) AS b FROM x) SELECT vec_id, count(*) FILTER (a >= 0.25 * b) AS held FROM r GROUP BY 1")
def p12(spark, d):
    return R.drop_small_energy(S.vectors_long(spark, d), ["vec_id"], 0.25, "ch").groupBy("vec_id").agg(F.count_if(F.col("v") != 0).alias("held"))


@query("p13_scale_ranges", f"WITH {SERIES} SELECT series_id, t, CASE WHEN t >= 20 AND t < 25 THEN v * 2 WHEN t >= 5 AND t < 10 THEN v * 0.5 ELSE v END AS v FROM s")
def p13(spark, d):
    return R.scale_ranges(long_series(spark, d), [(5, 10, 0.5), (20, 25, 2.0)]).select("series_id", t_(), "v")


@query("j1_align", f"WITH {SERIES}, y AS (SELECT series_id - 1 AS series_id, t, v FROM s) SELECT s.series_id, count(*) AS n, round(sum(s.v * y.v), 6) AS dot FROM s JOIN y ON y.series_id = s.series_id AND y.t = s.t GROUP BY 1")
def j1(spark, d):
    a = long_series(spark, d)
    return R.align(a, a.withColumn("series_id", F.col("series_id") - 1)).groupBy("series_id").agg(F.count("*").alias("n"), r6(F.sum(F.col("x") * F.col("y"))).alias("dot"))


@query("j2_feature_pairs", f"WITH {VECTORS}, k AS (SELECT series_id, t, ch, v FROM x) SELECT a.ch AS ch_x, b.ch AS ch_y, round(corr(a.v, b.v), 6) AS r FROM k a JOIN k b USING (series_id, t) WHERE a.ch < b.ch GROUP BY 1, 2")
def j2(spark, d):
    rows = S.vectors_long(spark, d)
    left = rows.select("series_id", "t", F.col("ch").cast("long").alias("ch_x"), F.col("v").alias("x"))
    right = rows.select("series_id", "t", F.col("ch").cast("long").alias("ch_y"), F.col("v").alias("y"))
    return left.join(right, ["series_id", "t"]).where("ch_x < ch_y").groupBy("ch_x", "ch_y").agg(r6(F.corr("x", "y")).alias("r"))


@query("j3_locate", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM n), f AS (SELECT event_id * 7 % (SELECT count(*) FROM events) AS g FROM events) SELECT g, series_id, g - st AS t FROM f JOIN c ON g >= st AND g < st + n")
def j3(spark, d):
    lengths = long_series(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    events = S.table(spark, d, "events")
    total = events.agg(F.count("*").alias("_all"))
    frames = events.crossJoin(F.broadcast(total)).select((F.col("event_id") * 7 % F.col("_all")).alias("g"))
    return R.locate(frames, lengths, "series_id")


MARKS = "m AS (SELECT series_id, t AS start, grp AS label FROM s WHERE t % 13 = 3)"


@query("j4_label_intervals", f"WITH {SERIES}, {MARKS}, n AS (SELECT *, lead(start) OVER (PARTITION BY series_id ORDER BY start) AS stop FROM m) SELECT s.series_id, s.t, n.label FROM s LEFT JOIN n ON n.series_id = s.series_id AND s.t >= n.start AND (s.t < n.stop OR n.stop IS NULL)")
def j4(spark, d):
    rows = long_series(spark, d)
    marks = rows.where("t % 13 = 3").select("series_id", F.col("t").alias("start"), F.col("grp").alias("label"))
    return R.label_intervals(rows, marks).select("series_id", t_(), "label")


@query("j5_beat_sync", f"WITH {SERIES}, b AS (SELECT *, count(*) FILTER (v > 70) OVER (PARTITION BY series_id ORDER BY t) AS beat FROM s) SELECT series_id, beat, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS mid FROM b GROUP BY 1, 2")
def j5(spark, d):
    rows = long_series(spark, d)
    return R.beat_intervals(rows, rows.where("v > 70")).groupBy("series_id", "beat").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.median("v")).alias("mid"))


@query("j6_aggregate_slices", f"WITH {SERIES}, c AS (SELECT * FROM (VALUES (0, 0, 10), (1, 5, 25), (2, 20, 40)) AS c(slice_id, a, b)) SELECT series_id, slice_id, round(max(v), 6) AS v FROM s JOIN c ON t >= a AND t < b GROUP BY 1, 2")
def j6(spark, d):
    slices = spark.createDataFrame([(0, 0, 10), (1, 5, 25), (2, 20, 40)], "slice_id int, start int, stop int")
    return R.aggregate_slices(long_series(spark, d), slices, F.max("v")).select("series_id", "slice_id", r6(F.col("v")).alias("v"))


PALETTE = "pal AS (SELECT vec_id AS p, ch AS d, v FROM x WHERE vec_id < 8)"


@query("j7_palette_lookup", f"WITH {SERIES}, {VECTORS}, {PALETTE} SELECT s.series_id, d, round(sum(pal.v), 6) AS total FROM s JOIN pal ON p = s.t % 8 GROUP BY 1, 2")
def j7(spark, d):
    palette = S.vectors_long(spark, d).where("vec_id < 8").select(F.col("vec_id").alias("p"), F.col("ch").cast("long").alias("d"), F.col("v").alias("_v"))
    rows = long_series(spark, d).withColumn("p", (F.col("t") % 8).cast("long"))
    return rows.join(palette, "p").groupBy("series_id", "d").agg(r6(F.sum("_v")).alias("total"))


@query("j8_palette_mix", f"WITH {SERIES}, {VECTORS}, {PALETTE} SELECT s.series_id, s.t, d, round(sum((s.v + p) / 100 * pal.v), 6) AS v FROM s CROSS JOIN pal GROUP BY 1, 2, 3")
def j8(spark, d):
    palette = S.vectors_long(spark, d).where("vec_id < 8").select(F.col("vec_id").alias("p"), F.col("ch").cast("long").alias("d"), "v")
    weights = long_series(spark, d).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    mixed = R.mix(weights.select("series_id", "t", "p", ((F.col("v") + F.col("p")) / 100).alias("w")), palette)
    return mixed.select("series_id", t_(), "d", r6(F.col("v")).alias("v"))


@query("j9_pairs_within", f"WITH {SERIES}, k AS MATERIALIZED (SELECT * FROM s) SELECT a.series_id, count(*) AS n, round(sum(abs(a.v - b.v)), 6) AS gap FROM k a JOIN k b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1")
def j9(spark, d):
    pairs = R.pairs_within(long_series(spark, d), "t", ["v"])
    return pairs.groupBy("series_id").agg(F.count("*").alias("n"), r6(F.sum(F.abs(F.col("v_a") - F.col("v_b")))).alias("gap"))


@query("j12_nearest_resample", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT series_id, n, unnest(range(32)) AS i FROM n) SELECT g.series_id, i AS t, v FROM g JOIN s ON s.series_id = g.series_id AND s.t = i * n // 32")
def j12(spark, d):
    return R.nearest_resample(long_series(spark, d), 32).select("series_id", t_(), "v")


LINEAR = "n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT series_id, n, i, greatest({place}, 0.0) AS x FROM (SELECT series_id, n, unnest(range(40)) AS i FROM n)), h AS (SELECT *, least(floor(x), n - 1)::BIGINT AS lo, least(floor(x) + 1, n - 1)::BIGINT AS hi FROM g) SELECT h.series_id, i AS t, round(a.v * (1 - least(x - lo, 1.0)) + b.v * least(x - lo, 1.0), 6) AS v FROM h JOIN s a ON a.series_id = h.series_id AND a.t = lo JOIN s b ON b.series_id = h.series_id AND b.t = hi"


@query("j13_linear_resample", f"WITH {SERIES}, " + LINEAR.format(place="(i + 0.5::DOUBLE) * n / 40 - 0.5"))
def j13(spark, d):
    return R.linear_resample(long_series(spark, d), 40).select("series_id", t_(), r6(F.col("v")).alias("v"))


@query("j14_attach_cached", "WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) SELECT o_orderkey, coalesce(q, -o_totalprice) AS score, q IS NULL AS computed FROM orders LEFT JOIN f ON k = o_orderkey")
def j14(spark, d):
    cached = S.table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    met = S.table(spark, d, "orders").join(cached, "o_orderkey", "left")
    return met.select("o_orderkey", F.coalesce("q", -F.col("o_totalprice")).alias("score"), F.col("q").isNull().alias("computed"))


@query("j16_track_table", "WITH k AS (SELECT p_partkey AS id, (p_size // 10)::VARCHAR || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS mss, p_brand FROM part), q AS (SELECT *, split_part(mss, ':', 1)::INT * 60 + split_part(mss, ':', 2)::INT AS sec FROM k), r AS (SELECT *, lead(sec) OVER (PARTITION BY p_brand ORDER BY sec, id) AS nxt FROM q) SELECT id, (greatest(sec, 30) - 30) * 24 AS first_frame, (least(coalesce(nxt, 240), 240) - 30) * 24 AS past_frame FROM r WHERE sec < 240 AND coalesce(nxt, 240) > 30")
def j16(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.concat_ws(":", F.floor(F.col("p_size") / 10).cast("string"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")).alias("mss"))
    parts = F.split("mss", ":")
    rows = rows.withColumn("sec", parts[0].cast("int") * 60 + parts[1].cast("int"))
    stop = F.coalesce(F.lead("sec").over(Window.partitionBy("p_brand").orderBy("sec", "id")), F.lit(240))
    rows = rows.withColumn("stop", stop).where("sec < 240 AND stop > 30")
    return rows.select("id", (F.greatest("sec", F.lit(30)) - 30).alias("a"), (F.least("stop", F.lit(240)) - 30).alias("b")).select("id", (F.col("a") * 24).alias("first_frame"), (F.col("b") * 24).alias("past_frame"))


@query("j17_wrap_slice", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT series_id, n, unnest(range(30)) AS i FROM n) SELECT g.series_id, i AS t, v FROM g JOIN s ON s.series_id = g.series_id AND s.t = (i + 37) % n")
def j17(spark, d):
    return R.wrap_slice(long_series(spark, d), 37, 30).select("series_id", t_(), "v")


@query("j18_linear_resample_ends", f"WITH {SERIES}, " + LINEAR.format(place="i::DOUBLE * (n - 1) / 39"))
def j18(spark, d):
    return R.linear_resample(long_series(spark, d), 40, ends=True).select("series_id", t_(), r6(F.col("v")).alias("v"))


@query("k1_largest", f"WITH {SERIES} SELECT series_id, t, v FROM s ORDER BY v DESC, series_id, t LIMIT 25")
def k1(spark, d):
    return long_series(spark, d).orderBy(F.desc("v"), "series_id", "t").limit(25).select("series_id", t_(), "v")


@query("k2_top_spread", f"WITH {VECTORS}, c AS (SELECT ch FROM x GROUP BY ch ORDER BY round(stddev_samp(v), 9) DESC, ch LIMIT 6) SELECT series_id, round(avg(v * v), 6) AS energy FROM x WHERE ch IN (SELECT ch FROM c) GROUP BY 1")
def k2(spark, d):
    rows = S.vectors_long(spark, d)
    top = rows.groupBy("ch").agg(F.round(F.stddev_samp("v"), 9).alias("_s")).orderBy(F.desc("_s"), "ch").limit(6)
    return rows.join(top, "ch", "left_semi").groupBy("series_id").agg(r6(F.avg(F.col("v") * F.col("v"))).alias("energy"))


@query("k3_top_peaks", f"WITH {SERIES}, c AS (SELECT t, avg(v) AS m FROM s GROUP BY 1), p AS (SELECT *, lag(m) OVER (ORDER BY t) AS a, lead(m) OVER (ORDER BY t) AS b FROM c) SELECT t, round(m, 6) AS mean FROM p WHERE m > a AND m > b ORDER BY m DESC, t LIMIT 5")
def k3(spark, d):
    curve = long_series(spark, d).groupBy("t").agg(F.avg("v").alias("m"))
    peaks = curve.withColumn("peak", R.is_peak("m", Window.partitionBy(F.lit(0)).orderBy("t"))).where("peak")
    return peaks.orderBy(F.desc("m"), "t").limit(5).select(t_(), r6(F.col("m")).alias("mean"))


@query("k4_rank_bands", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, rank FROM r WHERE (rank >= 0 AND rank < 5) OR (rank >= n // 4 AND rank < n // 4 + 5) OR (rank >= n // 2 AND rank < n // 2 + 5)")
def k4(spark, d):
    picked = R.rank_bands(S.table(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal", "c_custkey"], [(0.0, 5), (0.25, 5), (0.5, 5)])
    return picked.select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("k5_even_picks", f"WITH {SERIES}, r AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s), p AS (SELECT DISTINCT series_id, floor(i * ((n - 1) / 8.0) + 0.5)::BIGINT AS t FROM r, range(9) AS k(i)) SELECT series_id, t, v FROM s JOIN p USING (series_id, t)")
def k5(spark, d):
    return R.even_picks(long_series(spark, d), ["series_id"], ["t"], 9).select("series_id", t_(), "v")


@query("k6_number_in_name", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::INT AS number FROM customer")
def k6(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).cast("int").alias("number")).orderBy("number")


@query("k9_top_channels", f"WITH {VECTORS}, q AS (SELECT series_id, t, ch, abs(v) AS v FROM x), c AS (SELECT ch FROM q GROUP BY ch ORDER BY round(sum(v), 9) DESC, ch LIMIT 8) SELECT series_id, t, ch, round(v / sum(v) OVER (PARTITION BY series_id, t), 6) AS share FROM q WHERE ch IN (SELECT ch FROM c)")
def k9(spark, d):
    rows = S.vectors_long(spark, d).withColumn("v", F.abs("v"))
    top = rows.groupBy("ch").agg(F.round(F.sum("v"), 9).alias("_s")).orderBy(F.desc("_s"), "ch").limit(8)
    share = F.col("v") / F.sum("v").over(Window.partitionBy("series_id", "t"))
    return rows.join(top, "ch", "left_semi").select("series_id", t_(), F.col("ch").cast("long").alias("ch"), r6(share).alias("share"))


@query("u1_concatenate", "SELECT 'c' AS side, c_nationkey AS nation, round(c_acctbal, 6) AS bal FROM customer UNION ALL SELECT 's', s_nationkey, round(s_acctbal, 6) FROM supplier")
def u1(spark, d):
    left = S.table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"), r6(F.col("c_acctbal")).alias("bal"))
    return left.unionByName(S.table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"), r6(F.col("s_acctbal")).alias("bal")))


@query("u2_stack_channels", f"WITH {VECTORS}, k AS (SELECT series_id, t, ch, v FROM x) SELECT ch, round(sum(v), 6) AS total FROM (SELECT ch, v FROM k UNION ALL SELECT ch + 64, -v FROM k) GROUP BY 1")
def u2(spark, d):
    rows = S.vectors_long(spark, d).select("series_id", "t", F.col("ch").cast("long").alias("ch"), "v")
    return R.stack_channels(rows, rows.withColumn("v", -F.col("v")), 64).groupBy("ch").agg(r6(F.sum("v")).alias("total"))


@query("u3_unique", "SELECT DISTINCT p_brand, p_size FROM part")
def u3(spark, d):
    return S.table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("u4_difference", "SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def u4(spark, d):
    return S.table(spark, d, "orders").select("o_custkey").exceptAll(S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")))


@query("u5_interleave", f"WITH {SERIES} SELECT series_id, 2 * t AS t, v FROM s UNION ALL SELECT series_id, 2 * t + 1, -v FROM s")
def u5(spark, d):
    rows = long_series(spark, d).select("series_id", t_(), "v")
    return R.interleave(rows, rows.withColumn("v", -F.col("v")))
