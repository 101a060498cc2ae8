"""Queries over scalar and per-series functions, and quantiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators import rows as R
from cadenza.operators.neighbours import nearest_pairs
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.sources import tables as S


def t_():
    """The frame as a long."""
    return F.col("t").cast("long").alias("t")


def v_():
    """The value, rounded."""
    return r6(F.col("v")).alias("v")



def frames(spark, d):
    return S.events_series(spark, d)


MINMAX = "({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w + 1e-8)"


@query("n1_minmax", f"WITH {SERIES} SELECT series_id, t, round({MINMAX.format(x='v')}, 6) AS v FROM s WINDOW w AS (PARTITION BY series_id)")
def n1(spark, d):
    return frames(spark, d).select("series_id", t_(), r6(N.minmax()).alias("v"))


QS = "q AS (SELECT series_id, quantile_cont(v, {a}) AS a, quantile_cont(v, {b}) AS b FROM s GROUP BY 1), c AS (SELECT series_id, t, least(greatest(v, a), b) AS v FROM s JOIN q USING (series_id))"


@query("n2_standardize", f"WITH {SERIES}, {QS.format(a=0.25, b=0.75)} SELECT series_id, t, round({MINMAX.format(x='v')}, 6) AS v FROM c WINDOW w AS (PARTITION BY series_id)")
def n2(spark, d):
    return N.standardize(frames(spark, d), ["series_id"]).select("series_id", t_(), v_())


@query("n3_clamp", f"WITH {SERIES}, {QS.format(a=0.1, b=0.9)} SELECT series_id, t, round(v, 6) AS v FROM c")
def n3(spark, d):
    return N.clamp(frames(spark, d), ["series_id"], 0.1, 0.9).select("series_id", t_(), v_())


PEAKS = "w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)), k AS (SELECT series_id, quantile_cont(v, {q}) AS bound FROM w WHERE v > a AND v > b GROUP BY 1), p AS (SELECT series_id, t, least(v, coalesce(bound, v)) AS v FROM s LEFT JOIN k USING (series_id))"


@query("n4_clamp_to_peaks", f"WITH {SERIES}, {PEAKS.format(q=0.5)} SELECT series_id, t, round(v, 6) AS v FROM p")
def n4(spark, d):
    return N.clamp_to_peaks(frames(spark, d), 0.5).select("series_id", t_(), v_())


@query("n5_envelope", f"WITH {SERIES}, {PEAKS.format(q=0.6)} SELECT series_id, t, round(greatest(v, 0) / max(greatest(v, 0)) OVER (PARTITION BY series_id), 6) AS v FROM p")
def n5(spark, d):
    return N.envelope(frames(spark, d), 0.6).select("series_id", t_(), v_())


@query("n6_emphasize", f"WITH {SERIES}, l AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM s WINDOW w AS (PARTITION BY series_id)), x AS (SELECT *, (v - lo) / (hi - lo) AS x FROM l), q AS (SELECT series_id, quantile_cont(x, 0.7) AS q FROM x GROUP BY 1), y AS (SELECT x.*, x * (1 + tanh(4 * (x - q))) AS y FROM x JOIN q USING (series_id)) SELECT series_id, t, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) * (hi - lo) + lo, 6) AS v FROM y WINDOW w AS (PARTITION BY series_id)")
def n6(spark, d):
    return N.emphasize(frames(spark, d), 4.0, 0.7).select("series_id", t_(), v_())


@query("n7_row_norms", f"WITH {VECTORS} SELECT vec_id, ch, round(v / sum(abs(v)) OVER w, 6) AS l1, round(v / sqrt(sum(v * v) OVER w), 6) AS l2, round(v / max(abs(v)) OVER w, 6) AS top FROM x WINDOW w AS (PARTITION BY vec_id)")
def n7(spark, d):
    norms = [r6(N.norm(kind, ["vec_id"])).alias(name) for kind, name in (("l1", "l1"), ("l2", "l2"), ("max", "top"))]
    return S.vectors_long(spark, d).select("vec_id", F.col("ch").cast("long").alias("ch"), *norms)


@query("n8_decibel", f"WITH {SERIES}, b AS (SELECT series_id, t, 10 * log10(greatest(pow(v / 1000, 4), 1e-10)) AS v FROM s) SELECT series_id, t, round(greatest(v, (SELECT max(v) FROM b) - 40), 6) AS v FROM b")
def n8(spark, d):
    return N.decibel(frames(spark, d).withColumn("v", F.pow(F.col("v") / 1000, F.lit(4.0))), span=40.0).select("series_id", t_(), v_())


@query("n9_mel", f"WITH {SERIES}, f AS (SELECT series_id, t, 20 + abs(v) * 30 AS f FROM s), m AS (SELECT *, CASE WHEN f >= 1000 THEN 15 + ln(f / 1000) * (27 / ln(6.4)) ELSE f * 3 / 200 END AS m FROM f) SELECT series_id, t, round(m, 6) AS slaney, round(2595 * log10(1 + f / 700), 6) AS htk, round(CASE WHEN m >= 15 THEN 1000 * exp((m - 15) * (ln(6.4) / 27)) ELSE m * 200 / 3 END, 6) AS back FROM m")
def n9(spark, d):
    f = 20 + F.abs("v") * 30
    return frames(spark, d).select("series_id", t_(), r6(N.hz_to_mel(f)).alias("slaney"), r6(N.hz_to_mel(f, htk=True)).alias("htk"), r6(N.mel_to_hz(N.hz_to_mel(f))).alias("back"))


@query("n10_octave_midi", f"WITH {SERIES}, f AS (SELECT series_id, t, 20 + abs(v) * 30 AS f FROM s) SELECT series_id, t, round(log2(f / 27.5), 6) AS octave, round(12 * log2(f / 440) + 69, 6) AS midi FROM f")
def n10(spark, d):
    f = 20 + F.abs("v") * 30
    return frames(spark, d).select("series_id", t_(), r6(N.hz_to_octave(f)).alias("octave"), r6(N.hz_to_midi(f)).alias("midi"))


@query("n11_polar", "SELECT vec_id, round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2), 6) AS mag, round(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE), 6) AS ang FROM embeddings")
def n11(spark, d):
    mag, ang = N.polar(F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"))
    return S.table(spark, d, "embeddings").select("vec_id", r6(mag).alias("mag"), r6(ang).alias("ang"))


RGB = "c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12 AS b FROM lineitem), h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS gap FROM c), u AS (SELECT *, CASE WHEN gap = 0 THEN 0 WHEN hi = r THEN (g - b) / gap WHEN hi = g THEN (b - r) / gap + 2 ELSE (r - g) / gap + 4 END / 6 AS u FROM h)"


@query("n12_colour", f"WITH {RGB} SELECT k, n, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round(u - floor(u), 6) AS hue, round(gap / hi, 6) AS sat, round(hi, 6) AS val FROM u")
def n12(spark, d):
    r, g, b = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12
    h, s, v = N.hsv(r, g, b)
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r6(N.luma(r, g, b)).alias("luma"), r6(h).alias("hue"), r6(s).alias("sat"), r6(v).alias("val"))


@query("n15_soft_mask", f"WITH {SERIES}, a AS (SELECT series_id, t, greatest(v, 0) AS x, greatest(60 - v, 0) AS y FROM s) SELECT series_id, t, round(CASE WHEN greatest(x, y) <= 0 THEN 0.5 ELSE pow(x / greatest(x, y), 2) / (pow(x / greatest(x, y), 2) + pow(y / greatest(x, y), 2)) END, 6) AS m FROM a")
def n15(spark, d):
    x, y = F.greatest("v", F.lit(0.0)), F.greatest(60 - F.col("v"), F.lit(0.0))
    return frames(spark, d).select("series_id", t_(), r6(N.soft_mask(x, y)).alias("m"))


LCG1 = "(({id}) * 1103515245 + {seed} * 12345) % 2147483648"


@query("n17_weighted_choice", f"WITH o AS (SELECT * FROM (VALUES ('a', 0.0, 0.5), ('b', 0.5, 0.8), ('c', 0.8, 1.0)) AS o(option, a, b)), u AS (SELECT event_id, (({LCG1.format(id='event_id', seed=21)} + 7919) * 1103515245 + 21 * 12345) % 2147483648 / 2147483648.0 AS u FROM events) SELECT event_id, option FROM u JOIN o ON u >= a AND u < b")
def n17(spark, d):
    options = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "option string, weight double")
    return N.weighted_choice(S.table(spark, d, "events").select("event_id"), options, S.uniform(F.col("event_id"), 21))


@query("n18_sample_rows", f"SELECT event_id FROM events ORDER BY {LCG1.format(id='event_id', seed=8)}, event_id LIMIT 40")
def n18(spark, d):
    return N.sample_rows(S.table(spark, d, "events").select("event_id"), F.struct(S.lcg(F.col("event_id"), 8), "event_id"), 40)


@query("n19_permute_share", f"WITH {SERIES}, c AS (SELECT *, (series_id * 31 + t) % 3 = 0 AS c FROM s), o AS (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, row_number() OVER (PARTITION BY series_id ORDER BY {LCG1.format(id='series_id * 1000 + t', seed=5)}, t) AS j FROM c WHERE c) SELECT a.series_id, a.t, b.v FROM o a JOIN o b ON a.series_id = b.series_id AND a.i = b.j UNION ALL SELECT series_id, t, v FROM c WHERE NOT c")
def n19(spark, d):
    chosen, key = (F.col("series_id") * 31 + F.col("t")) % 3 == 0, S.lcg(F.col("series_id") * 1000 + F.col("t"), 5)
    return N.permute_share(frames(spark, d), chosen, key).select("series_id", t_(), "v")


@query("n20_perturbation_grid", f"WITH {SERIES} SELECT k.s AS strength, round(avg(v * k.s + k.s), 6) AS mean, round(avg(pow(abs(v) / 100, k.s)), 6) AS power FROM s, (VALUES (0.5::DOUBLE), (1), (2)) AS k(s) GROUP BY 1")
def n20(spark, d):
    rows = frames(spark, d).withColumn("strength", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0)])))
    k = F.col("strength")
    return rows.groupBy("strength").agg(r6(F.avg(F.col("v") * k + k)).alias("mean"), r6(F.avg(F.pow(F.abs("v") / 100, k))).alias("power"))


@query("n21_name_parsing", "SELECT p_partkey, split_part(p_type, ' ', 1) AS head, regexp_extract(p_brand, '#([0-9])', 1) AS digit, regexp_replace(p_brand, '^Brand', 'B') AS short FROM part")
def n21(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("head"), F.regexp_extract("p_brand", "#([0-9])", 1).alias("digit"), F.regexp_replace("p_brand", "^Brand", "B").alias("short"))


PAIR = "a AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS x, y.embedding::DOUBLE[] AS y FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


def neighbours(spark, d):
    left = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    right = S.table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return left.join(right, "vec_id")


@query("n22_slerp", f"WITH {PAIR}, g AS (SELECT *, acos(least(greatest(list_dot_product(x, y), -1), 1)) AS w FROM a) SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * sin(0.75 * w) / sin(w) + z[2] * sin(0.25 * w) / sin(w))), 5) AS total FROM g")
def n22(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(F.aggregate(N.slerp(F.col("x"), F.col("y"), F.lit(0.25)), F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("n23_cosine", f"WITH {PAIR} SELECT vec_id, round(list_cosine_similarity(x, y), 5) AS cos, round(list_dot_product(x, y), 5) AS dot FROM a")
def n23(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(N.cosine(F.col("x"), F.col("y")), 5).alias("cos"), F.round(N.dot(F.col("x"), F.col("y")), 5).alias("dot"))


@query("n24_minkowski", f"WITH {PAIR} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 2))) + 1e-8), 5) AS d2, round(pow(list_sum(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 4))) + 1e-8, 0.25), 5) AS d4 FROM a")
def n24(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(N.minkowski(F.col("x"), F.col("y")), 5).alias("d2"), F.round(N.minkowski(F.col("x"), F.col("y"), 4), 5).alias("d4"))


@query("n25_contrast", f"WITH {SERIES} SELECT series_id, t, round(sin(v / 100 * (pi() / 2) + 0.1 * sin(4 * (v / 100 * (pi() / 2)))), 6) AS v FROM s")
def n25(spark, d):
    return frames(spark, d).select("series_id", t_(), r6(N.contrast(F.col("v") / 100)).alias("v"))


@query("n26_magnitude_phase", "SELECT vec_id, round(pow(sqrt(embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2), 1.5), 6) AS power, round(cos(atan2(embedding[4]::DOUBLE, embedding[3]::DOUBLE)), 6) AS re FROM embeddings")
def n26(spark, d):
    mag, ang = N.polar(F.get("embedding", F.lit(2)).cast("double"), F.get("embedding", F.lit(3)).cast("double"))
    return S.table(spark, d, "embeddings").select("vec_id", r6(F.pow(mag, F.lit(1.5))).alias("power"), r6(F.cos(ang)).alias("re"))


K8 = """f AS (SELECT *, floor(q * (n - 1)) AS lo, ceil(q * (n - 1)) AS hi, q * (n - 1) AS place FROM (SELECT s.grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM s) CROSS JOIN (VALUES (0.025::DOUBLE), (0.5), (0.9)) AS k(q)),
e AS (SELECT grp, q, place, lo, min(v) FILTER (r = lo OR r = hi) AS a, max(v) FILTER (r = lo OR r = hi) AS b, hi FROM f GROUP BY ALL)"""
RULES = {"linear": "a * (1 - (place - lo)) + b * (place - lo)", "midpoint": "(a + b) / 2", "lower": "a", "higher": "b", "nearest": "CASE WHEN place - lo > 0.5 THEN b WHEN place - lo < 0.5 THEN a WHEN lo % 2 = 1 THEN b ELSE a END"}


@query("k8_quantiles", f"WITH {SERIES}, {K8} " + " UNION ALL ".join(f"SELECT '{k}' AS how, grp, q, round({v}, 6) AS value FROM e" for k, v in RULES.items()))
def k8(spark, d):
    found = N.quantiles(frames(spark, d), ["grp"], [0.025, 0.5, 0.9], tuple(RULES))
    return found.select("how", "grp", "q", r6(F.col("value")).alias("value"))


@query("k7_nearest_pairs", f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, round(list_distance(a.x, b.x), 9) AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p) SELECT vec_id, k AS rank, other, round(d, 5) AS d FROM r WHERE k <= 3")
def k7(spark, d):
    rows = S.table(spark, d, "embeddings")
    left, right = rows.select(F.col("label").alias("series_id"), "vec_id", F.col("embedding").alias("x")), rows.select(F.col("label").alias("series_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    pairs = nearest_pairs(left, right, ("vec_id", "other"), 3).select("vec_id", "other", "d")
    return R.top_rows(pairs, ["vec_id"], ["d", "other"], 3).select("vec_id", F.col("rank").cast("long").alias("rank"), "other", F.round("d", 5).alias("d"))
