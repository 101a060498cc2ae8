"""Batch forms of the streaming jobs, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.plans._register import SERIES, query, r6
from cadenza.operators.recurrences import bilinear, legendre_memory
from cadenza.plans.aggregates import PAIRS, pairs
from cadenza.plans.recurrence import ORDER, STEP, projection_sql
from cadenza.sources import tables as S
from cadenza.streaming import jobs as J


def events(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("v"), F.col("event_type").alias("grp"))


@query("t1_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, user_id AS series_id, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1, 2")
def t1(spark, d):
    return J.tumbling(events(spark, d), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "series_id", r6(F.col("rms")).alias("rms"), r6(F.col("mean")).alias("mean"), "high")


@query("t2_sliding", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP - INTERVAL 1 DAY * k AS start, user_id AS series_id, round(avg(value), 6) AS mean, count(*) AS n FROM events, range(3) AS r(k) GROUP BY 1, 2")
def t2(spark, d):
    return J.sliding(events(spark, d), "3 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "series_id", r6(F.col("mean")).alias("mean"), "n")


@query("t3_sessions", "WITH g AS (SELECT user_id AS series_id, ts, value, coalesce((ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts) AS run FROM g) SELECT min(ts)::TIMESTAMP AS start, series_id, count(*) AS n, round(sum(value), 6) AS total FROM r GROUP BY series_id, run")
def t3(spark, d):
    return J.sessions(events(spark, d), "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "series_id", "n", r6(F.col("total")).alias("total"))


@query("t6_enriched", f"WITH {SERIES}, m AS (SELECT grp, avg(v) AS mean, stddev_pop(v) AS std FROM s GROUP BY 1) SELECT user_id AS series_id, ts::TIMESTAMP AS ts, round((value - mean) / std, 6) AS z FROM events JOIN m ON grp = event_type")
def t6(spark, d):
    rows = events(spark, d)
    return J.enriched(rows, S.train_stats(rows, "grp"), "grp").select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("z")).alias("z"))


@query("t7_running_moments", f"WITH {SERIES}, {PAIRS} SELECT series_id, count(*) AS n, round(sum(x), 5) AS sx, round(sum(y), 5) AS sy, round(sum(x * x), 4) AS sxx, round(sum(x * y), 4) AS sxy, round(sum(y * y), 4) AS syy FROM p GROUP BY 1")
def t7(spark, d):
    m = J.running_moments(pairs(spark, d))
    return m.select("series_id", "n", *[F.round(c, 5).alias(c) for c in ("sx", "sy")], *[F.round(c, 4).alias(c) for c in ("sxx", "sxy", "syy")])


@query("t4_differences", "SELECT * FROM (SELECT user_id AS series_id, ts::TIMESTAMP AS ts, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)), 6) AS step FROM events) WHERE step IS NOT NULL")
def t4(spark, d):
    return J.differences(events(spark, d)).select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), r6(F.col("step")).alias("step"))


@query("t5_projection", projection_sql())
def t5(spark, d):
    rows = J.projected(events(spark, d), *bilinear(*legendre_memory(ORDER), STEP))
    t = F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1
    return rows.select("series_id", t.cast("long").alias("t"), *[r6(F.get("state", F.lit(i))).alias(f"c{i}") for i in range(ORDER)])
