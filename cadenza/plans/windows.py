"""Queries over window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators import windows as W
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.sources import tables as S


def t_():
    """The frame as a long."""
    return F.col("t").cast("long").alias("t")


def v_():
    """The value, rounded."""
    return r6(F.col("v")).alias("v")

OVER = "WINDOW o AS (PARTITION BY series_id ORDER BY t)"


def frames(spark, d):
    return S.events_series(spark, d)


@query("w1_difference", f"WITH {SERIES} SELECT series_id, t, round(coalesce(lead(v) OVER o - v, v - lag(v) OVER o), 6) AS v FROM s {OVER}")
def w1(spark, d):
    return frames(spark, d).select("series_id", t_(), r6(W.difference()).alias("v"))


@query("w2_flux", f"WITH {SERIES} SELECT series_id, t, round(lead(v, 1, 0.0) OVER o - v, 6) AS v FROM s {OVER}")
def w2(spark, d):
    return frames(spark, d).select("series_id", t_(), r6(W.flux()).alias("v"))


def kernel_sql(sigma: float) -> str:
    return "k AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in W.gaussian_kernel(sigma)) + ") AS k(o, w))"


COUNTS = "n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1)"
CIRCULAR = "CASE WHEN least((SELECT max(o) FROM k), 3 * n) > n AND s.t + o < -n THEN 0 WHEN least((SELECT max(o) FROM k), 3 * n) > n AND s.t + o >= 2 * n THEN n - 1 ELSE ((s.t + o) % n + n) % n END"
REFLECT = "least(((s.t + o) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2), 2 * n - 2 - ((s.t + o) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2))"
EDGE = "least(greatest(s.t + o, 0), n - 1)"
SMOOTH = "SELECT s.series_id, s.t, sum(w * b.v) / sum(w) AS v FROM s JOIN n USING (series_id) CROSS JOIN k JOIN s b ON b.series_id = s.series_id AND b.t = {place} WHERE abs(o) <= 3 * n GROUP BY 1, 2"


@query("w3_velocity", f"WITH {SERIES}, {COUNTS}, {kernel_sql(1.5)}, g AS ({SMOOTH.format(place=CIRCULAR)}) SELECT series_id, t, round(coalesce(v - lag(v) OVER o, lead(v) OVER o - v), 6) AS v FROM g {OVER}")
def w3(spark, d):
    smooth = W.gaussian(frames(spark, d), 1.5)
    step = F.coalesce(F.col("v") - F.lag("v").over(W.in_order()), F.lead("v").over(W.in_order()) - F.col("v"))
    return smooth.select("series_id", t_(), r6(step).alias("v"))


@query("w4_onset_envelope", f"WITH {SERIES}, f AS (SELECT series_id, t, greatest(lead(v, 1, 0.0) OVER o - v, 0) AS v FROM s {OVER}), q AS (SELECT series_id, quantile_cont(v, 0.025) AS a, quantile_cont(v, 0.975) AS b FROM f GROUP BY 1), c AS (SELECT series_id, t, least(greatest(v, a), b) AS v FROM f JOIN q USING (series_id)) SELECT series_id, t, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) AS v FROM c WINDOW w AS (PARTITION BY series_id)")
def w4(spark, d):
    rises = frames(spark, d).withColumn("v", F.greatest(W.flux(), F.lit(0.0)))
    return N.standardize(rises, ["series_id"], 0.025, 0.975).select("series_id", t_(), v_())


@query("w5_onset_strength", f"WITH {VECTORS}, r AS (SELECT series_id, t, ch, coalesce(greatest(v - lag(v) OVER (PARTITION BY series_id, ch ORDER BY t), 0), 0) AS v FROM x), m AS (SELECT series_id, t, avg(v) AS v FROM r GROUP BY 1, 2) SELECT series_id, t, round(lag(v, 2, 0.0) OVER o, 6) AS v FROM m {OVER}")
def w5(spark, d):
    return W.onset_strength(S.vectors_long(spark, d)).select("series_id", t_(), v_())


@query("w6_moving_median", f"WITH {SERIES}, {COUNTS}, k AS (SELECT unnest(range(-2, 3)) AS o) SELECT s.series_id, s.t, round(quantile_disc(b.v, 0.5), 6) AS v FROM s JOIN n USING (series_id) CROSS JOIN k JOIN s b ON b.series_id = s.series_id AND b.t = {REFLECT} GROUP BY 1, 2")
def w6(spark, d):
    return W.moving_median(frames(spark, d), 5).select("series_id", t_(), v_())


@query("w8_gaussian", " UNION ALL ".join(f"SELECT * FROM (WITH {SERIES}, {COUNTS}, {kernel_sql(2.0)} SELECT '{m}' AS mode, series_id, t, round(v, 6) AS v FROM ({SMOOTH.format(place=p)}))" for m, p in (("circular", CIRCULAR), ("reflect", REFLECT), ("replicate", EDGE))))
def w8(spark, d):
    out = None
    for mode in ("circular", "reflect", "replicate"):
        one = W.gaussian(frames(spark, d), 2.0, mode).select(F.lit(mode).alias("mode"), "series_id", t_(), v_())
        out = one if out is None else out.unionByName(one)
    return out


@query("w8_gaussian_wide", f"WITH {SERIES}, {COUNTS}, {kernel_sql(80.0)} SELECT series_id, t, round(v, 5) AS v FROM ({SMOOTH.format(place=CIRCULAR)})")
def w8_wide(spark, d):
    """A kernel wider than most series."""
    return W.gaussian(frames(spark, d), 80.0).select("series_id", t_(), F.round("v", 5).alias("v"))


@query("w9_causal_hann", f"WITH {SERIES}, {COUNTS}, h AS (SELECT -i AS o, 0.5 + 0.5 * cos(pi() * i / 6) AS h FROM range(6) AS k(i)), k AS (SELECT o, h / sum(h) OVER () AS w FROM h) SELECT series_id, t, round(v, 6) AS v FROM ({SMOOTH.format(place=EDGE)})")
def w9(spark, d):
    return W.causal_hann(frames(spark, d), 6).select("series_id", t_(), v_())


@query("w10_whiten", f"WITH {VECTORS} SELECT vec_id, ch, round(greatest(v - avg(v) OVER (PARTITION BY vec_id ORDER BY ch ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0), 6) AS v FROM x")
def w10(spark, d):
    return W.whiten(S.vectors_long(spark, d), ["vec_id"], "ch", 3).select("vec_id", F.col("ch").cast("long").alias("ch"), v_())


@query("w11_harmonic_sum", f"WITH {SERIES}, {COUNTS}, k AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (3, 0.5), (7, 0.25)) AS k(o, w)) SELECT s.series_id, s.t, round(sum(w * b.v), 6) AS v FROM s CROSS JOIN k JOIN s b ON b.series_id = s.series_id AND b.t = s.t + o GROUP BY 1, 2")
def w11(spark, d):
    return W.convolve(frames(spark, d), [(0, 1.0), (3, 0.5), (7, 0.25)], "zero").select("series_id", t_(), v_())


@query("w12_salience", f"WITH {SERIES}, {COUNTS}, a AS (SELECT * FROM (WITH {kernel_sql(1.0)} {SMOOTH.format(place=CIRCULAR)})), b AS (SELECT * FROM (WITH {kernel_sql(4.0)} {SMOOTH.format(place=CIRCULAR)})) SELECT s.series_id, s.t, round(pow(a.v / b.v, 2) * s.v, 6) AS v FROM s JOIN a USING (series_id, t) JOIN b USING (series_id, t)")
def w12(spark, d):
    return W.salience(frames(spark, d), 1.0, 4.0).select("series_id", t_(), v_())


@query("w13_ranks", f"WITH {SERIES} SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY v, t) AS ordinal, count(*) OVER (PARTITION BY series_id ORDER BY round(v / 10) RANGE UNBOUNDED PRECEDING) AS most FROM s")
def w13(spark, d):
    rows = frames(spark, d).withColumn("_k", F.round(F.col("v") / 10))
    return rows.select("series_id", t_(), W.ordinal_rank("v", "t", W.whole()).cast("long").alias("ordinal"), W.max_rank("_k", W.whole()).alias("most"))


@query("w14_random_ties", f"WITH {SERIES} SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY floor(v / 20), ((series_id * 1000 + t) * 1103515245 + 4 * 12345) % 2147483648, t) AS r FROM s")
def w14(spark, d):
    order = W.whole().orderBy(F.floor(F.col("v") / 20), S.lcg(F.col("series_id") * 1000 + F.col("t"), 4), "t")
    return frames(spark, d).select("series_id", t_(), F.row_number().over(order).cast("long").alias("r"))


@query("w15_cumulative", f"WITH {SERIES} SELECT series_id, t, round(sum(v * v) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(v * v) OVER (PARTITION BY series_id), 6) AS share FROM s")
def w15(spark, d):
    return frames(spark, d).withColumn("v", F.col("v") * F.col("v")).select("series_id", t_(), r6(W.cumulative_share()).alias("share"))


@query("w16_runs", f"WITH {SERIES}, c AS (SELECT *, coalesce((grp <> lag(grp) OVER o)::INT, 0) AS c FROM s {OVER}), r AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c) SELECT series_id, run, grp, min(t) AS start, count(*) AS n FROM r GROUP BY 1, 2, 3")
def w16(spark, d):
    return W.runs(frames(spark, d), "grp").groupBy("series_id", "run", "grp").agg(F.min("t").cast("long").alias("start"), F.count("*").alias("n"))


@query("w17_circular_shift", f"WITH {SERIES} SELECT series_id, (t + 11) % count(*) OVER (PARTITION BY series_id) AS t, v FROM s")
def w17(spark, d):
    return W.circular_shift(frames(spark, d), 11).select("series_id", t_(), "v")


DIAGONALS = f"""{SERIES}, p AS (SELECT a.series_id, a.t AS i, b.t AS j, b.t - a.t AS lag, abs(a.v - b.v) AS v FROM s a JOIN s b ON a.series_id = b.series_id),
g AS (SELECT *, i - min(i) OVER w AS q, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY series_id, lag)), o AS (SELECT unnest(range(-3, 4)) AS o),
m AS (SELECT g.series_id, g.lag, g.i, g.j, CASE WHEN n = 1 THEN 0 ELSE least(((q + o) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2), 2 * n - 2 - ((q + o) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2)) END AS src FROM g, o),
f AS (SELECT m.series_id, m.i, m.j, quantile_disc(g.v, 0.5) AS v FROM m JOIN g ON g.series_id = m.series_id AND g.lag = m.lag AND g.q = m.src GROUP BY 1, 2, 3)"""


@query("w18_diagonal_median", f"WITH {DIAGONALS} SELECT series_id, i, round(sum(v), 5) AS total, round(max(v), 5) AS high FROM f GROUP BY 1, 2")
def w18(spark, d):
    rows = frames(spark, d).select("series_id", "t", "v")
    cells = rows.select("series_id", F.col("t").alias("i"), F.col("v").alias("x")).join(rows.select("series_id", F.col("t").alias("j"), F.col("v").alias("y")), "series_id")
    filtered = W.diagonal_median(cells.select("series_id", "i", "j", F.abs(F.col("x") - F.col("y")).alias("v")), 7)
    return filtered.groupBy("series_id", F.col("i").cast("long").alias("i")).agg(F.round(F.sum("v"), 5).alias("total"), F.round(F.max("v"), 5).alias("high"))


@query("w19_parabolic", f"WITH {SERIES}, w AS (SELECT series_id, t, lag(v) OVER o AS a, v AS b, lead(v) OVER o AS c FROM s {OVER}) SELECT series_id, t, round(0.5 * (a - c) / (a - 2 * b + c), 5) AS shift, round(b - 0.25 * (a - c) * (0.5 * (a - c) / (a - 2 * b + c)), 5) AS height FROM w WHERE b > a AND b > c")
def w19(spark, d):
    shift, height = W.parabolic_peak("v", W.in_order())
    peak = (F.col("v") > F.lag("v").over(W.in_order())) & (F.col("v") > F.lead("v").over(W.in_order()))
    return frames(spark, d).withColumns({"shift": shift, "height": height, "_p": peak}).where("_p").select("series_id", t_(), F.round("shift", 5).alias("shift"), F.round("height", 5).alias("height"))


@query("w22_delayed", f"WITH {SERIES} SELECT series_id, t, lag(v, 1, -1.0::DOUBLE) OVER o AS v FROM s {OVER}")
def w22(spark, d):
    return W.delayed(frames(spark, d), -1.0).select("series_id", t_(), "v")
