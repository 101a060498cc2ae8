"""Queries over sources and dataset layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.sources import tables as S

HASH = "((({id} * 1103515245 + {seed} * 12345) % 2147483648 + 7919) * 1103515245 + {seed} * 12345) % 2147483648 / 2147483648.0"


@query("s1_scan_series", f"WITH {SERIES} SELECT series_id, count(*) AS n, max(t) AS last_t, round(sum(v), 6) AS total FROM s GROUP BY 1")
def s1(spark, d):
    return S.events_series(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), F.max("t").cast("long").alias("last_t"), r6(F.sum("v")).alias("total"))


@query("s2_union_groups", "SELECT 'o' AS corpus, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'c', c_mktsegment, count(*) FROM customer GROUP BY 2")
def s2(spark, d):
    both = S.union_groups({"o": S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind")), "c": S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"))})
    return both.groupBy("corpus", "kind").agg(F.count("*").alias("n"))


@query("s3_melt", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME name VALUE val")
def s3(spark, d):
    wide = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return S.melt(wide, ["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"])


@query("s4_pivot_matrix", "SELECT l_returnflag, max(q) FILTER (l_linestatus = 'O') AS \"O\", max(q) FILTER (l_linestatus = 'F') AS \"F\" FROM (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def s4(spark, d):
    long = S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(F.sum("l_quantity")).alias("q"))
    return S.pivot_matrix(long, "l_returnflag", "l_linestatus", "q", ["O", "F"])


@query("s6_resume", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def s6(spark, d):
    done = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.resume(S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("s7_split", f"WITH {SERIES} SELECT DISTINCT series_id, CASE WHEN {HASH.format(id='series_id', seed=42)} < 0.8 THEN 'train' ELSE 'val' END AS part FROM s")
def s7(spark, d):
    return S.split(S.events_series(spark, d)).select("series_id", "part").distinct()


SLICES = """p AS (SELECT s.*, k.start AS st, (t - k.start) // {n} AS k FROM s, (VALUES {starts}) AS k(start) WHERE t >= k.start),
q AS (SELECT *, max(k) OVER (PARTITION BY series_id, st) AS last FROM p),
w AS (SELECT series_id, (st + k * {n})::INT AS o, (t - st - k * {n})::INT AS t_rel, v FROM q WHERE k < last)"""


@query("s8_overlapping_slices", f"WITH {SERIES}, {SLICES.format(n=16, starts='(0), (4), (8), (12)')} SELECT series_id, o AS \"offset\", count(*) AS n, round(sum(v * (t_rel + 1)), 6) AS moment FROM w GROUP BY 1, 2")
def s8(spark, d):
    rows = S.overlapping_slices(S.events_series(spark, d), 16)
    return rows.groupBy("series_id", "offset").agg(F.count("*").alias("n"), r6(F.sum(F.col("v") * (F.col("t_rel") + 1))).alias("moment"))


@query("s9_chunks", f"WITH {SERIES}, {SLICES.format(n=10, starts='(0)')} SELECT series_id, o AS \"offset\", t_rel, v FROM w")
def s9(spark, d):
    return S.chunks(S.events_series(spark, d), 10).select("series_id", "offset", "t_rel", "v")


@query("s10_slices_with_lineage", f"WITH {SERIES}, {SLICES.format(n=24, starts='(0), (6), (12), (18)')} SELECT series_id, o AS \"offset\", list(v ORDER BY t_rel) AS x, 'user-' || series_id AS file FROM w GROUP BY 1, 2")
def s10(spark, d):
    rows = S.overlapping_slices(S.events_series(spark, d), 24).groupBy("series_id", "offset")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_rel", "v"))), lambda x: x["v"])
    return rows.agg(ordered.alias("x")).withColumn("file", F.concat(F.lit("user-"), F.col("series_id").cast("string")))


@query("s11_sliding_windows", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), st AS (SELECT series_id, unnest(range(0, n - 12 + 1, 3))::INT AS start FROM n WHERE n >= 12) SELECT st.series_id, st.start, count(*) AS n, round(avg(v), 6) AS mean FROM st JOIN s ON s.series_id = st.series_id AND t BETWEEN start AND start + 11 GROUP BY 1, 2")
def s11(spark, d):
    rows = S.sliding_windows(S.events_series(spark, d), 12, 3)
    return rows.groupBy("series_id", "start").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


@query("s12_train_stats", f"WITH {VECTORS} SELECT ch, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x WHERE vec_id % 5 <> 0 GROUP BY 1")
def s12(spark, d):
    return S.train_stats(S.vectors_long(spark, d).where("vec_id % 5 <> 0"), "ch").select("ch", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("s13_zscore", f"WITH {SERIES}, m AS (SELECT grp, avg(v) AS mean, stddev_pop(v) AS std FROM s GROUP BY 1) SELECT series_id, t, round((v - mean) / std, 6) AS z FROM s JOIN m USING (grp)")
def s13(spark, d):
    rows = S.events_series(spark, d)
    return S.zscore(rows, S.train_stats(rows, "grp"), "grp").select("series_id", F.col("t").cast("long").alias("t"), r6(F.col("z")).alias("z"))


@query("s14_profile", f"WITH {SERIES} SELECT grp, round(min(v), 6) AS low, round(median(v), 6) AS mid, round(avg(v), 6) AS mean, round(max(v), 6) AS high, count(v) AS n FROM s GROUP BY 1")
def s14(spark, d):
    return S.profile(S.events_series(spark, d), "grp").select("grp", *[r6(F.col(c)).alias(c) for c in ("low", "mid", "mean", "high")], "n")


@query("s15_random_crop", f"WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s), c AS (SELECT *, floor({HASH.format(id='series_id', seed=9)} * (n - 20 + 1))::INT AS o FROM n WHERE n >= 20) SELECT series_id, t, o AS \"offset\", v FROM c WHERE t >= o AND t < o + 20")
def s15(spark, d):
    return S.random_crop(S.events_series(spark, d), 20, 9).select("series_id", F.col("t").cast("long").alias("t"), "offset", "v")


@query("s16_shuffle", f"SELECT event_id, {HASH.format(id='event_id', seed=3)} AS place FROM events")
def s16(spark, d):
    return S.shuffle_order(S.table(spark, d, "events"), "event_id", 3).select("event_id", "place")


@query("s17_quarantine", "SELECT try_cast(json_extract_string(props, '$.k') AS INT) > 50 IS TRUE AS good, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def s17(spark, d):
    good, bad = S.quarantine(S.table(spark, d, "events"), F.get_json_object("props", "$.k").try_cast("int") > 50)
    tally = [F.count("*").alias("n"), r6(F.sum("value")).alias("total")]
    return good.groupBy(F.lit(True).alias("good")).agg(*tally).unionByName(bad.groupBy(F.lit(False).alias("good")).agg(*tally))


@query("s18_pad_to_grid", f"WITH {SERIES}, g AS (SELECT series_id, unnest(range(0, (ceil((max(t) + 1) / 24.0) * 24)::BIGINT)) AS t FROM s GROUP BY series_id) SELECT g.series_id, g.t, coalesce(s.v, 0) AS v FROM g LEFT JOIN s ON s.series_id = g.series_id AND s.t = g.t")
def s18(spark, d):
    return S.pad_to_grid(S.events_series(spark, d), 24).select("series_id", F.col("t").cast("long").alias("t"), "v")


@query("s19_truncate_to_common", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1 HAVING n >= 50) SELECT s.series_id, t, v FROM s JOIN n USING (series_id) WHERE t < (SELECT min(n) FROM n)")
def s19(spark, d):
    return S.truncate_to_common(S.events_series(spark, d), 50).select("series_id", F.col("t").cast("long").alias("t"), "v")


@query("s20_config_table", f"WITH {SERIES} SELECT series_id, 1 + series_id % 5 AS depth, 'kind' || (series_id % 3) AS kind, round(avg(v), 6) AS level FROM s GROUP BY 1")
def s20(spark, d):
    own = S.events_series(spark, d).groupBy("series_id").agg(r6(F.avg("v")).alias("level"))
    config = own.select("series_id", (1 + F.col("series_id") % 5).alias("depth"), F.concat(F.lit("kind"), (F.col("series_id") % 3).cast("string")).alias("kind"), "level")
    return S.config_rows(S.config_json(config), "depth long, kind string, level double")


@query("s5_write_table", "SELECT 'parquet' AS kind, event_type AS grp, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY 2 UNION ALL SELECT 'csv', event_type, count(*), round(sum(value), 5) FROM events GROUP BY 2")
def s5(spark, d):
    """Rows appended to two kinds of result tables, read back."""
    rows, folder, out = S.table(spark, d, "events").select(F.col("event_type").alias("grp"), "event_id", "value"), S.scratch(spark), None
    for kind in ("parquet", "csv"):
        S.write_table(rows, f"{folder}/{kind}", kind, ["grp"])
        reader = spark.read.schema("event_id long, value double, grp string")
        back = (reader.option("header", True).csv if kind == "csv" else reader.parquet)(f"{folder}/{kind}")
        one = back.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total")).select(F.lit(kind).alias("kind"), "grp", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out
