"""Queries over dependence measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators import measures as M
from cadenza.operators import windows as W
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.plans.aggregates import PAIRS, pairs
from cadenza.sources import tables as S


def halves(spark, d):
    """The first 32 channels of each label's vectors against the other 32."""
    rows = S.vectors_long(spark, d)
    return rows.where(F.col("ch") < 32), rows.where(F.col("ch") >= 32).withColumn("ch", F.col("ch") - 32)


def halves_sql(p: str, scale: str) -> str:
    """Sums of squared moments of both halves, their traces and the sums of products of the rows' energies; p: prefix of the names;
    scale: what the centred value is divided by."""
    side = lambda name, where, ch: f"{p}{name} AS (SELECT series_id, t, {ch} AS ch, (v - avg(v) OVER w) / {scale} AS v FROM x WHERE {where} WINDOW w AS (PARTITION BY series_id, ch))"
    sums = lambda l, r: f"{p}{l}{r} AS (SELECT l.series_id, l.ch AS i, r.ch AS j, sum(l.v * r.v) AS m FROM {p}{l} l JOIN {p}{r} r ON l.series_id = r.series_id AND l.t = r.t GROUP BY 1, 2, 3), {p}{l}{r}s AS (SELECT series_id, sum(m * m) AS {l}{r}, sum(m) FILTER (i = j) AS {l}{r}t FROM {p}{l}{r} GROUP BY 1)"
    energy = f"{p}e AS (SELECT series_id, sum(p * q) AS pq, sum(p * p) AS pp, sum(q * q) AS qq, count(*) AS n FROM (SELECT series_id, t, sum(v * v) AS p FROM {p}a GROUP BY 1, 2) JOIN (SELECT series_id, t, sum(v * v) AS q FROM {p}b GROUP BY 1, 2) USING (series_id, t) GROUP BY 1)"
    whole = f"{p}m AS (SELECT * FROM {p}abs JOIN {p}aas USING (series_id) JOIN {p}bbs USING (series_id) JOIN {p}e USING (series_id))"
    return ", ".join([side("a", "ch < 32", "ch"), side("b", "ch >= 32", "ch - 32"), sums("a", "b"), sums("a", "a"), sums("b", "b"), energy, whole])


@query("m9_m13_m19_moment_measures", f"WITH {VECTORS}, {halves_sql('c', '1')} SELECT series_id, round(ab / sqrt(aa * bb), 6) AS rv, round((ab - pq) / sqrt((aa - pp) * (bb - qq)), 6) AS rv2, round(abt / sqrt(aat * bbt), 6) AS r1, round(ab / sqrt(aa * bb), 6) AS cka FROM cm")
def m9(spark, d):
    return M.moment_measures(*halves(spark, d)).select("series_id", *[r6(F.col(c)).alias(c) for c in ("rv", "rv2", "r1", "cka")])


LOSS = "({a} - (n - 1) / (n - 2) * ({a} - {s} / pow(n - 1, 2)))"


@query("m10_m11_m22_adjusted", f"""WITH {VECTORS}, {halves_sql('c', '1')}, {halves_sql('z', 'stddev_samp(v) OVER w')},
k AS (SELECT c.series_id, c.n::DOUBLE AS n, c.ab, c.aa, c.bb, c.aat, c.bbt, z.ab AS sab, z.aa AS saa, z.bb AS sbb, z.pq, z.pp, z.qq FROM cm c JOIN zm z USING (series_id)),
f AS (SELECT *, {LOSS.format(a='1024', s='sab')} AS la, {LOSS.format(a='1024', s='saa')} AS lb, {LOSS.format(a='1024', s='sbb')} AS lc, ab / sqrt(aa * bb) AS rv, sqrt(aat * aat / aa * bbt * bbt / bb) / (n - 1) AS ex FROM k)
SELECT series_id, round(CASE WHEN lb * lc > 0 THEN (ab * la / sab) / sqrt((aa * lb / saa) * (bb * lc / sbb)) END, 6) AS rv_adjusted, round((rv - ex) / (1 - ex), 6) AS rv_less_expected, round((sab - pq) / sqrt((saa - pp) * (sbb - qq)), 6) AS rv2_standard FROM f""")
def m10(spark, d):
    return M.moment_measures(*halves(spark, d)).select("series_id", *[r6(F.col(c)).alias(c) for c in ("rv_adjusted", "rv_less_expected", "rv2_standard")])


@query("m12_autocorrelation", f"""WITH {VECTORS}, c AS (SELECT series_id, t, ch, v - avg(v) OVER (PARTITION BY series_id, ch) AS v FROM x),
r AS (SELECT series_id, t, list(v ORDER BY ch) FILTER (ch < 32) AS a, list(v ORDER BY ch) FILTER (ch >= 32) AS b FROM c GROUP BY 1, 2)
SELECT p.series_id, round(corr(list_cosine_similarity(p.a, q.a), list_cosine_similarity(p.b, q.b)), 6) AS r FROM r p JOIN r q ON p.series_id = q.series_id AND p.t < q.t GROUP BY 1""")
def m12(spark, d):
    return M.moment_measures(*halves(spark, d)).select("series_id", r6(F.col("autocorrelation")).alias("r"))


@query("m1_pearson_median", f"WITH {VECTORS}, r AS (SELECT a.series_id, a.ch, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.series_id = b.series_id AND a.t = b.t AND b.ch = a.ch + 32 WHERE a.ch < 32 GROUP BY 1, 2) SELECT series_id, round(quantile_disc(r, 0.5), 6) AS r FROM r GROUP BY 1")
def m1(spark, d):
    return M.pearson_median(*halves(spark, d)).select("series_id", r6(F.col("r")).alias("r"))


@query("m2_m4_concordance", f"WITH {SERIES}, {PAIRS} SELECT series_id, round(2 * corr(x, y) * stddev_samp(x) * stddev_samp(y) / (var_samp(x) + var_samp(y) + pow(avg(x) - avg(y), 2)), 6) AS ccc, round(corr(x, y), 6) AS r FROM p GROUP BY 1")
def m2(spark, d):
    return pairs(spark, d).groupBy("series_id").agg(r6(M.concordance("x", "y")).alias("ccc"), r6(F.corr("x", "y")).alias("r"))


@query("m3_spearman", f"WITH {SERIES}, {PAIRS}, k AS (SELECT series_id, floor(x / 5) AS x, floor(y / 5) AS y FROM p), r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2 AS a, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2 AS b FROM k) SELECT series_id, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def m3(spark, d):
    rows = pairs(spark, d).select("series_id", F.floor(F.col("x") / 5).alias("x"), F.floor(F.col("y") / 5).alias("y"))
    return M.spearman(rows, ["series_id"], "x", "y").select("series_id", r6(F.col("rho")).alias("rho"))


@query("m5_matthews", "WITH d AS (SELECT label AS a, ((vec_id % 7 + label) % 10)::INT AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT sum(n) AS s, coalesce(sum(n) FILTER (a = b), 0) AS c FROM c), ta AS (SELECT a AS k, sum(n) AS x FROM c GROUP BY 1), tb AS (SELECT b AS k, sum(n) AS y FROM c GROUP BY 1) SELECT 1 AS one, round(((s.c * s.s - (SELECT sum(x * y) FROM ta JOIN tb USING (k))) / sqrt((s.s * s.s - (SELECT sum(x * x) FROM ta))::DOUBLE * (s.s * s.s - (SELECT sum(y * y) FROM tb))))::DOUBLE, 6) AS mcc FROM s")
def m5(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.lit(1).alias("one"), F.col("label").alias("a"), ((F.col("vec_id") % 7 + F.col("label")) % 10).cast("int").alias("b"))
    return M.matthews(rows, ["one"], "a", "b").select("one", r6(F.col("mcc")).alias("mcc"))


XI = "c AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}), r AS (SELECT *, count(*) OVER (PARTITION BY {by} ORDER BY y) / n AS r, count(*) OVER (PARTITION BY {by} ORDER BY y DESC) / n AS g FROM c), d AS (SELECT *, abs(lead(r) OVER (PARTITION BY {by} ORDER BY x, t) - r) AS s FROM r), xi AS (SELECT {by}, 1 - avg(s) * (any_value(n) - 1) / (2 * any_value(n)) / avg(g * (1 - g)) AS xi FROM d GROUP BY ALL)"


@query("m6_xi", f"WITH {SERIES}, p AS (SELECT a.series_id, a.t, a.v AS x, b.v AS y FROM s a JOIN s b ON b.series_id = a.series_id + 1 AND b.t = a.t), {XI.format(by='series_id', rows='p')} SELECT series_id, round(xi, 6) AS xi FROM xi")
def m6(spark, d):
    return M.xi(pairs(spark, d), ["series_id"], "x", "y", "t").select("series_id", r6(F.col("xi")).alias("xi"))


@query("m7_xi_columns", f"WITH {VECTORS}, k AS (SELECT vec_id AS t, ch, v FROM x), p AS (SELECT a.ch AS i, b.ch AS j, a.t, a.v AS x, b.v AS y FROM k a JOIN k b USING (t) WHERE a.ch <> b.ch), {XI.format(by='i, j', rows='p')} SELECT i, j, round(xi, 6) AS xi FROM xi")
def m7(spark, d):
    rows = S.vectors_long(spark, d).select(F.col("vec_id").alias("t"), F.col("ch").cast("long").alias("ch"), "v")
    return M.xi_columns(rows).select("i", "j", r6(F.col("xi")).alias("xi"))


@query("m14_m15_m17_m20_m21_subspaces")
def m17(spark, d):
    return M.small_matrix_measures(*halves(spark, d))


@query("m16_significance")
def m16(spark, d):
    return M.smi_significance(*halves(spark, d), 20)


@query("m18_pooled")
def m18(spark, d):
    x, y = halves(spark, d)
    cut = lambda df, k: (df.where(F.col("ch") < k), df.where(F.col("ch") >= k))
    (xa, xb), (ya, yb) = cut(x, 20), cut(y, 12)
    return M.pooled_measures({"first": (xa, ya), "second": (xb, yb)}).select("series_id", "procrustes", "smi")


FIRST_LAST = "p AS (SELECT series_id, t, 'f' || (ch // 16) AS name, ch, v FROM x)"
PAIR_RV2 = """w AS (SELECT series_id, name, t, ch, v - avg(v) OVER (PARTITION BY series_id, name, ch) AS v FROM p), r AS (SELECT series_id, name, t, list(v ORDER BY ch) AS x FROM w GROUP BY ALL),
g AS (SELECT l.series_id, l.name, l.t AS i, k.t AS j, list_dot_product(l.x, k.x) AS g FROM r l JOIN r k ON l.series_id = k.series_id AND l.name = k.name AND l.t <> k.t),
s2 AS (SELECT l.series_id, l.name AS a, k.name AS b, sum(l.g * k.g) / sqrt(sum(l.g * l.g) * sum(k.g * k.g)) AS rv2 FROM g l JOIN g k ON l.series_id = k.series_id AND l.i = k.i AND l.j = k.j AND l.name IN ('f0', 'f1') AND k.name IN ('f2', 'f3') GROUP BY ALL),
st AS (SELECT series_id, name, ch, abs(lead(v) OVER o - v) / max(abs(v)) OVER c AS s, v FROM p WINDOW c AS (PARTITION BY series_id, name, ch), o AS (PARTITION BY series_id, name, ch ORDER BY t)),
fc AS (SELECT series_id, name, max(s) AS s, avg(d) / (sqrt(sum(q)) + 1e-8) AS d FROM (SELECT series_id, name, ch, max(s) AS s, stddev_samp(v) AS d, sum(v * v) AS q FROM st GROUP BY ALL) GROUP BY ALL)"""


@query("m24_feature_pairs", f"WITH {VECTORS}, {FIRST_LAST}, {PAIR_RV2} SELECT s2.series_id, a, b, round(rv2, 5) AS rv2, round(fa.s + fb.s, 5) AS smooth, round(fa.d + fb.d, 5) AS spread FROM s2 JOIN fc fa ON fa.series_id = s2.series_id AND fa.name = a JOIN fc fb ON fb.series_id = s2.series_id AND fb.name = b")
def m24(spark, d):
    rows = S.vectors_long(spark, d).withColumn("name", F.concat(F.lit("f"), F.floor(F.col("ch") / 16).cast("string")))
    found = M.feature_pairs(rows.where("ch < 32"), rows.where("ch >= 32"))
    return found.select("series_id", "a", "b", *[F.round(c, 5).alias(c) for c in ("rv2", "smooth", "spread")])


@query("m28_scaled_autocorrelation", f"WITH {VECTORS}, k AS (SELECT series_id, t, ch, (v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) AS v FROM x WINDOW c AS (PARTITION BY series_id, ch)), r AS (SELECT series_id, t, list(v ORDER BY ch) AS x FROM k GROUP BY 1, 2), p AS (SELECT a.series_id, a.t AS i, b.t AS j, list_dot_product(a.x, b.x) AS a FROM r a JOIN r b USING (series_id)) SELECT series_id, i, j, round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w), 5) AS a FROM p WINDOW w AS (PARTITION BY series_id)")
def m28(spark, d):
    return M.scaled_autocorrelation(S.vectors_long(spark, d)).select("series_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("a", 5).alias("a"))


@query("m23_autocorrelation_weight", f"WITH {VECTORS}, k AS (SELECT series_id, t, ch, (v - avg(v) OVER c) / stddev_samp(v) OVER c AS v FROM x WINDOW c AS (PARTITION BY series_id, ch)), r AS (SELECT series_id, t, list(v ORDER BY ch) AS x FROM k GROUP BY 1, 2), p AS (SELECT a.series_id, list_dot_product(a.x, b.x) AS a FROM r a JOIN r b USING (series_id)) SELECT series_id, round((max(a) - min(a)) / (avg(a) - min(a)), 5) AS weight FROM p GROUP BY 1")
def m23(spark, d):
    return M.autocorrelation_weight(S.vectors_long(spark, d)).select("series_id", F.round("weight", 5).alias("weight"))


@query("m8_conditional_dependence")
def m8(spark, d):
    rows = S.events_series(spark, d)
    order = Window.partitionBy("series_id").orderBy("t")
    lagged = rows.select("series_id", "t", F.col("v").alias("y"), F.array(F.lag("v", 1, 0.0).over(order), F.lag("v", 2, 0.0).over(order), F.lag("v", 3, 0.0).over(order)).alias("x"))
    return M.conditional_dependence(lagged, 3)


def smooth_sql(to: str, source: str, sigma: float) -> str:
    """Circular smoothing of a table (series_id, t, v) as further table expressions."""
    kernel = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in W.gaussian_kernel(sigma))
    return f"{to}n AS (SELECT series_id, count(*) AS n FROM {source} GROUP BY 1), {to} AS (SELECT s.series_id, s.t, sum(w * b.v) AS v FROM {source} s JOIN {to}n USING (series_id) CROSS JOIN (VALUES {kernel}) AS k(o, w) JOIN {source} b ON b.series_id = s.series_id AND b.t = ((s.t + o) % n + n) % n GROUP BY 1, 2)"


def envelope_sql(to: str, source: str) -> str:
    """What M25 does with an envelope: smoothed, clamped to its peaks and scaled, clamped below, smoothed, of unit length."""
    return f"""{smooth_sql(to + 'a', source, 2.0)}, {to}r AS (SELECT series_id, t, round(v, 9) AS v FROM {to}a), {to}p AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS h FROM {to}r WINDOW o AS (PARTITION BY series_id ORDER BY t)),
{to}k AS (SELECT series_id, quantile_cont(v, 0.975) AS b FROM {to}p WHERE v > l AND v > h GROUP BY 1), {to}c AS (SELECT series_id, t, greatest(least(v, coalesce(b, v)), 0) AS v FROM {to}r LEFT JOIN {to}k USING (series_id)),
{to}s AS (SELECT series_id, t, v / max(v) OVER (PARTITION BY series_id) AS v FROM {to}c), {to}q AS (SELECT series_id, quantile_cont(v, 0.1) AS q FROM {to}s GROUP BY 1), {to}d AS (SELECT series_id, t, least(greatest(v, q), 1) AS v FROM {to}s JOIN {to}q USING (series_id)),
{smooth_sql(to, to + 'd', 1.0)}"""


@query("m25_rhythmic", f"WITH {SERIES}, xs AS (SELECT series_id, t, v FROM s), ys AS (SELECT series_id - 1 AS series_id, t, v FROM s), {envelope_sql('ex', 'xs')}, {envelope_sql('ey', 'ys')} SELECT series_id, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 5) AS r FROM ex a JOIN ey b USING (series_id, t) GROUP BY 1")
def m25(spark, d):
    rows = S.events_series(spark, d).select("series_id", "t", "v")
    first, other = M.rhythmic_envelope(rows, 24.0), M.rhythmic_envelope(rows.withColumn("series_id", F.col("series_id") - 1), 24.0)
    met = first.withColumnRenamed("v", "x").join(other.withColumnRenamed("v", "y"), ["series_id", "t"])
    return M.rhythmic_reactivity(met).select("series_id", F.round("r", 5).alias("r"))


INFO = f"""WITH {SERIES}, p AS (SELECT a.series_id, a.t, a.v AS x, b.v AS y FROM s a JOIN s b ON b.series_id = a.series_id + 1 AND b.t = a.t), k AS (SELECT series_id, t, greatest(least(x / 100, 1), 0) * 255 AS x, greatest(least(y / 100, 1), 0) * 255 AS y FROM p),
g AS (SELECT b, b * 255.0 / 31 AS c FROM range(32) AS r(b)),
kx AS (SELECT series_id, t, b, exp(-0.5 * pow((x - c) / 8.0, 2)) AS w FROM k, g), ky AS (SELECT series_id, t, b, exp(-0.5 * pow((y - c) / 8.0, 2)) AS w FROM k, g),
px AS (SELECT series_id, avg(w) AS w FROM kx GROUP BY series_id, b), py AS (SELECT series_id, avg(w) AS w FROM ky GROUP BY series_id, b), pj AS (SELECT kx.series_id, sum(kx.w * ky.w) AS w FROM kx JOIN ky USING (series_id, t) GROUP BY kx.series_id, kx.b, ky.b),
h AS (SELECT series_id, s, -sum(p * log2(p + 1e-10)) AS h FROM (SELECT series_id, s, w / (sum(w) OVER (PARTITION BY series_id, s) + 1e-10) AS p FROM (SELECT *, 1 AS s FROM px UNION ALL SELECT *, 2 FROM py UNION ALL SELECT *, 3 FROM pj)) GROUP BY 1, 2)"""


@query("m26_mutual_information", f"{INFO} SELECT series_id, round(sum(CASE WHEN s < 3 THEN h ELSE -h END), 5) AS mi, round(2 * sum(CASE WHEN s < 3 THEN h ELSE -h END) / sum(CASE WHEN s < 3 THEN h END), 5) AS normalised FROM h GROUP BY 1")
def m26(spark, d):
    unit = lambda c: F.greatest(F.least(F.col(c) / 100, F.lit(1.0)), F.lit(0.0)).alias(c)
    found = M.mutual_information(pairs(spark, d).select("series_id", unit("x"), unit("y")), 32, 2.0)
    return found.select("series_id", F.round("mi", 5).alias("mi"), F.round("normalised", 5).alias("normalised"))


@query("m27_covariance", f"WITH {VECTORS}, k AS (SELECT vec_id, ch, v FROM x) SELECT a.ch AS i, b.ch AS j, round(covar_samp(a.v, b.v), 9) AS cov, round(avg(a.v * b.v), 9) AS raw FROM k a JOIN k b USING (vec_id) GROUP BY 1, 2")
def m27(spark, d):
    rows = S.vectors_long(spark, d)
    both = rows.select("vec_id", F.col("ch").cast("long").alias("i"), F.col("v").alias("x")).join(rows.select("vec_id", F.col("ch").cast("long").alias("j"), F.col("v").alias("y")), "vec_id")
    return both.groupBy("i", "j").agg(F.round(F.covar_samp("x", "y"), 9).alias("cov"), F.round(F.avg(F.col("x") * F.col("y")), 9).alias("raw"))


DIFF = "f AS (SELECT series_id, t, grp, v AS v0, abs(coalesce(lead(v) OVER o - v, v - lag(v) OVER o)) AS v FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t))"
FLAG = f"""WITH {SERIES}, {DIFF}, w AS (SELECT f.*, lag(v) OVER o AS a, lead(v) OVER o AS b FROM f WINDOW o AS (PARTITION BY series_id ORDER BY t)),
k AS (SELECT series_id, quantile_cont(v, 0.9) AS bound FROM w WHERE v > a AND v > b GROUP BY 1), cl AS (SELECT f.series_id, t, grp, v0, least(v, coalesce(bound, v)) AS v FROM f LEFT JOIN k USING (series_id)),
p AS (SELECT series_id, t, grp, (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q + 1e-8) AS x, v0 * v0 AS y FROM cl WINDOW q AS (PARTITION BY series_id)), g AS (SELECT series_id, grp FROM s WHERE t = 0), {XI.format(by='series_id', rows='(SELECT series_id, t, round(x, 9) AS x, y FROM p)')}
SELECT grp, count(*) AS n, round(median(round(xi, 9)), 6) AS mid, round(stddev_samp(round(xi, 9)), 6) AS std FROM xi JOIN g USING (series_id) GROUP BY 1"""


@query("flagship", FLAG)
def flagship(spark, d):
    """Absolute difference of each series, clamped to its peaks and scaled, against its energy: Chatterjee's
    xi for each series, then median and deviation by the type of the first event."""
    rows = S.events_series(spark, d)
    steps = rows.withColumn("_v", F.col("v")).withColumn("v", F.abs(W.difference()))
    scaled = N.clamp_to_peaks(steps, 0.9).withColumn("x", F.round(N.minmax(), 9)).withColumn("y", F.col("_v") * F.col("_v"))
    scores = M.xi(scaled.select("series_id", "t", "x", "y"), ["series_id"], "x", "y", "t").withColumn("xi", F.round("xi", 9))
    first = rows.where("t = 0").select("series_id", "grp")
    return scores.join(first, "series_id").groupBy("grp").agg(F.count("*").alias("n"), r6(F.median("xi")).alias("mid"), r6(F.stddev_samp("xi")).alias("std"))
