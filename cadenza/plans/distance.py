"""Queries over distances of distributions and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import distances as D
from cadenza.operators.matching import misaligned
from cadenza.plans._register import LCG, SERIES, VECTORS, query, r6
from cadenza.plans.aggregates import pairs
from cadenza.sources import tables as S


def sides(spark, d):
    """Vectors of a label, the even ids against the odd ones, numbered within their side."""
    rows = S.vectors_long(spark, d)
    return rows.withColumn("side", (F.col("t") % 2).cast("int")).withColumn("t", F.floor(F.col("t") / 2).cast("int"))


@query("d1_d10_d11_gaussian_distances")
def d1(spark, d):
    """All vectors with an even label against those with an odd one."""
    rows = S.vectors_long(spark, d)
    return D.gaussian_distances(rows.select(F.lit(0).alias("series_id"), (F.col("series_id") % 2).cast("int").alias("side"), F.col("vec_id").alias("t"), "ch", "v"), "side")


@query("d2_square_roots", f"WITH {VECTORS} SELECT a.ch AS i, b.ch AS j, round(covar_samp(a.v, b.v), 8) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2")
def d2(spark, d):
    """The square of the square root, which is the covariance."""
    rows = S.vectors_long(spark, d).select(F.lit(0).alias("series_id"), F.col("vec_id").alias("t"), "ch", "v")
    r = D.square_roots(rows)
    met = r.select(F.col("i").alias("i"), F.col("j").alias("k"), F.col("r").alias("a")).join(r.select(F.col("i").alias("k"), "j", F.col("r").alias("b")), "k")
    return met.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.round(F.sum(F.col("a") * F.col("b")), 8).alias("v"))


PROJECT = f"""z AS (SELECT series_id, (t % 2)::INT AS side, t // 2 AS t, ch, v FROM x),
pr AS (SELECT series_id, side, k, t, sum(v * ({LCG.format(id=LCG.format(id='ch * 1009 + k', seed=1) + ' + 7919', seed=1)} / 2147483648.0 - 0.5)) AS p FROM z, range(6) AS q(k) GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, side, k ORDER BY p, t) AS up, row_number() OVER (PARTITION BY series_id, side, k ORDER BY p DESC, t DESC) AS down FROM pr),
m1 AS (SELECT a.series_id, a.k, a.up AS r, a.p AS x, b.p AS y FROM rk a JOIN rk b ON a.series_id = b.series_id AND a.k = b.k AND a.up = b.up AND a.side = 0 AND b.side = 1),
m2 AS (SELECT a.series_id, a.k, a.up AS r, a.p AS x, b.p AS y FROM rk a JOIN rk b ON a.series_id = b.series_id AND a.k = b.k AND a.up = b.down AND a.side = 0 AND b.side = 1),
c1 AS (SELECT a.series_id, a.k, avg(pow(pow(a.x - b.x, 2) - pow(a.y - b.y, 2), 2)) AS c FROM m1 a JOIN m1 b USING (series_id, k) GROUP BY 1, 2),
c2 AS (SELECT a.series_id, a.k, avg(pow(pow(a.x - b.x, 2) - pow(a.y - b.y, 2), 2)) AS c FROM m2 a JOIN m2 b USING (series_id, k) GROUP BY 1, 2)"""


@query("d5_sliced_gromov_wasserstein", f"WITH {VECTORS}, {PROJECT} SELECT series_id, round(avg(least(c1.c, c2.c)), 9) AS sgw FROM c1 JOIN c2 USING (series_id, k) GROUP BY 1")
def d5(spark, d):
    return D.sliced_gromov_wasserstein(sides(spark, d), "side", 6).select("series_id", F.round("sgw", 9).alias("sgw"))


SPLIT = "v AS (SELECT label AS series_id, (vec_id % 2)::INT AS side, vec_id AS t, embedding::DOUBLE[] AS x FROM embeddings)"


def arrays(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("label").alias("series_id"), (F.col("vec_id") % 2).cast("int").alias("side"), F.col("vec_id").alias("t"), F.col("embedding").alias("x"))


@query("d3_kernel_distance", f"WITH {SPLIT}, p AS (SELECT a.series_id, a.side AS sa, b.side AS sb, pow(list_dot_product(a.x, b.x) / 64 + 1, 3) AS k FROM v a JOIN v b ON a.series_id = b.series_id AND a.t <> b.t) SELECT series_id, round(avg(k) FILTER (sa = 0 AND sb = 0) + avg(k) FILTER (sa = 1 AND sb = 1) - 2 * avg(k) FILTER (sa = 0 AND sb = 1), 6) AS kid FROM p GROUP BY 1")
def d3(spark, d):
    return D.kernel_distance(arrays(spark, d), "side", 64).select("series_id", r6(F.col("kid")).alias("kid"))


DTW = """WITH RECURSIVE {series}, p AS (SELECT a.series_id, list(a.v ORDER BY a.t) AS x, list(b.v ORDER BY a.t) AS y FROM s a JOIN s b ON b.series_id = a.series_id + 1 AND b.t = a.t GROUP BY 1),
r AS (SELECT series_id, x, y, 1 AS i, [0.0::DOUBLE] || list_transform(range(1, len(y) + 1), lambda j: 'inf'::DOUBLE) AS c FROM p
UNION ALL SELECT series_id, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [CASE WHEN abs(i - j) > 8 THEN 'inf'::DOUBLE ELSE pow(x[i] - y[j], 2) END, least(c[j], c[j + 1])]),
  lambda acc, e: list_append(acc, e[1] + least(e[2], acc[len(acc)])), ['inf'::DOUBLE]) FROM r WHERE i <= len(x))
SELECT series_id AS pair_id, round(sqrt(c[len(c)]), 5) AS dtw FROM r WHERE i = len(x) + 1"""


@query("d7_dtw", DTW.format(series=SERIES))
def d7(spark, d):
    return D.dtw(pairs(spark, d).withColumnRenamed("series_id", "pair_id"), 8).select("pair_id", F.round("dtw", 5).alias("dtw"))


@query("d9_knn_entropy", f"WITH {SPLIT}, p AS (SELECT a.series_id, a.t, min(round(list_distance(a.x, b.x), 9)) AS d FROM v a JOIN v b ON a.series_id = b.series_id AND a.t <> b.t GROUP BY 1, 2) SELECT series_id, round(64 * avg(ln(d)) + ln(count(*) - 1), 5) AS entropy FROM p GROUP BY 1")
def d9(spark, d):
    return D.knn_entropy(arrays(spark, d), 64).select("series_id", F.round("entropy", 5).alias("entropy"))


@query("d12_info_nce", "WITH v AS (SELECT label AS series_id, vec_id AS t, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings), s AS (SELECT a.series_id, a.t, a.t = b.t AS own, list_dot_product(a.x, b.y) / 0.07 AS s FROM v a JOIN v b USING (series_id)), l AS (SELECT series_id, t, ln(sum(exp(s))) - max(s) FILTER (own) AS l FROM s GROUP BY 1, 2) SELECT series_id, round(avg(l), 6) AS loss FROM l GROUP BY 1")
def d12(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.col("label").alias("series_id"), F.col("vec_id").alias("t"), F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return D.info_nce(rows).select("series_id", r6(F.col("loss")).alias("loss"))


@query("d4_sample_quality", f"""WITH {SPLIT}, p AS (SELECT a.series_id, a.side AS sa, a.t AS ta, b.side AS sb, b.t AS tb, round(list_distance(a.x, b.x), 9) AS d FROM v a JOIN v b ON a.series_id = b.series_id AND (a.side <> b.side OR a.t <> b.t)),
q AS (SELECT *, row_number() OVER (PARTITION BY series_id, sa, ta ORDER BY d, tb) AS r FROM p WHERE sa = sb), h AS (SELECT p.*, (p.d <= q.d)::INT AS i FROM p JOIN q ON q.series_id = p.series_id AND q.sa = p.sa AND q.ta = p.ta AND q.r = 5 WHERE p.sa <> p.sb),
g AS (SELECT series_id, tb, max(i) AS y, sum(i) AS n FROM h WHERE sa = 0 GROUP BY 1, 2), e AS (SELECT series_id, tb, max(i) AS y FROM h WHERE sa = 1 GROUP BY 1, 2), c AS (SELECT series_id, ta, max(i) AS y FROM h WHERE sa = 0 GROUP BY 1, 2)
SELECT series_id, round(avg(y), 6) AS precision, round((SELECT avg(e.y) FROM e WHERE e.series_id = g.series_id), 6) AS recall, round(avg(n) / 5, 6) AS density, round((SELECT avg(c.y) FROM c WHERE c.series_id = g.series_id), 6) AS coverage FROM g GROUP BY series_id""")
def d4(spark, d):
    return D.sample_quality(arrays(spark, d), "side", 5).select("series_id", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "density", "coverage")])


@query("d6_feature_distances")
def d6(spark, d):
    rows = S.vectors_long(spark, d).withColumn("name", F.concat(F.lit("f"), F.floor(F.col("ch") / 16).cast("string")))
    return D.feature_distances(rows.where("ch < 32"), rows.where("ch >= 32"), 4)


@query("d6_pooled_distances")
def d6b(spark, d):
    rows = S.vectors_long(spark, d).withColumn("name", F.concat(F.lit("f"), F.floor(F.col("ch") / 16).cast("string")))
    return D.pooled_distances(rows.where("ch < 32"), rows.where("ch >= 32"), 4)


@query("d13_subseries")
def d13(spark, d):
    return D.subseries(S.events_series(spark, d), 32, 5)


@query("d13_triplet_loss", "WITH v AS (SELECT label AS series_id, vec_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), a AS (SELECT series_id, x FROM v WHERE r = 1), l AS (SELECT v.series_id, r, ln(1 + exp(CASE WHEN r = 2 THEN -1 ELSE 1 END * list_dot_product(v.x, a.x))) AS l FROM v JOIN a USING (series_id) WHERE r > 1) SELECT series_id, round(avg(l) FILTER (r = 2) + coalesce(avg(l) FILTER (r > 2), 0), 6) AS loss FROM l GROUP BY 1")
def d13b(spark, d):
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = S.table(spark, d, "embeddings").select(F.col("label").alias("series_id"), place.alias("k"), F.col("embedding").alias("x"))
    return D.triplet_loss(rows.withColumn("role", F.when(F.col("k") == 1, "anchor").when(F.col("k") == 2, "positive").otherwise("negative"))).select("series_id", r6(F.col("loss")).alias("loss"))


WINDOWED = f"""WITH {SERIES}, n AS (SELECT series_id, max(t) + 1 AS n FROM s GROUP BY 1 HAVING n > 12), q AS (SELECT series_id, p AS patch, floor({LCG.format(id=LCG.format(id='(series_id * 1009 + p)', seed=4) + ' + 7919', seed=4)} / 2147483648.0 * (n - 12))::INT AS a FROM n, range(3) AS r(p)),
f AS (SELECT series_id, 'x' AS name, t, v FROM s UNION ALL SELECT series_id, 'y', t, -v FROM s)
SELECT q.series_id, patch, name, count(*) AS n, round(sum(v * (t - a + 1)), 5) AS moment FROM q JOIN f ON f.series_id = q.series_id AND t >= a AND t < a + 12 GROUP BY 1, 2, 3"""


@query("d14_aligned_windows", WINDOWED)
def d14(spark, d):
    rows = S.events_series(spark, d).select("series_id", F.lit("x").alias("name"), "t", "v")
    both = rows.unionByName(rows.select("series_id", F.lit("y").alias("name"), "t", -F.col("v")).toDF("series_id", "name", "t", "v"))
    found = D.aligned_windows(both, 3, 12).groupBy("series_id", F.col("patch").cast("long").alias("patch"), "name")
    return found.agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * (F.col("t_rel") + 1)), 5).alias("moment"))


@query("d15_comparison")
def d15(spark, d):
    """Each series with the next one, and with the next one's frames in a random order."""
    rows = S.events_series(spark, d).select("series_id", "t", "v")
    first = rows.withColumnRenamed("v", "x").withColumn("x", F.col("x") / 100)
    other = rows.select((F.col("series_id") - 1).alias("series_id"), "t", (F.col("v") / 100).alias("v"))
    mixed = misaligned(other, S.lcg(F.col("series_id") * 1000 + F.col("t"), 77))
    groups = S.union_groups({"aligned": first.join(other.withColumnRenamed("v", "y"), ["series_id", "t"]), "misaligned": first.join(mixed.withColumnRenamed("v", "y"), ["series_id", "t"])})
    return D.comparison(groups, 4, 8, 32, 2.0)


@query("d16_sensitivity")
def d16(spark, d):
    rows = S.vectors_long(spark, d).select("series_id", "t", "ch", "v")
    blocks = {f"block{k}": (8 * k, 8 * k + 8) for k in range(4)}
    return D.sensitivity(rows.where("ch < 32"), rows.where("ch >= 32").withColumn("ch", F.col("ch") - 32), blocks, ("zero", "negate", "double", "random"), 3, 2)
