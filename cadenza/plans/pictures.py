"""Queries over pixel frames (each embedding is an 8 by 8 frame of its label's video) and vector mixing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import groups as G
from cadenza.operators import pictures as V
from cadenza.operators import windows as W
from cadenza.operators.rows import mix
from cadenza.plans._register import LCG, SERIES, VECTORS, query, r6
from cadenza.plans.windows import CIRCULAR, COUNTS, SMOOTH, kernel_sql
from cadenza.sources import tables as S


def t_():
    """The frame as a long."""
    return F.col("t").cast("long").alias("t")



def pixels(spark, d):
    rows = S.vectors_long(spark, d)
    return rows.select(F.col("series_id").alias("video_id"), "t", F.floor(F.col("ch") / 8).alias("y"), (F.col("ch") % 8).cast("long").alias("x"), "v")


PIX = f"{VECTORS}, px AS (SELECT series_id AS video_id, t, ch // 8 AS y, ch % 8 AS x, v FROM x)"


@query("v1_histograms", f"WITH {PIX}, en AS (SELECT video_id, t, min(v) AS a, max(v) AS b FROM px GROUP BY 1, 2), h AS (SELECT video_id, t, least(floor((v - a) / (b - a) * 6), 5)::INT AS bin, count(*) AS n FROM px JOIN en USING (video_id, t) GROUP BY 1, 2, 3) SELECT *, round(n / max(n) OVER (PARTITION BY video_id, t), 6) AS scaled FROM h")
def v1(spark, d):
    return G.range_histogram(pixels(spark, d), ["video_id", "t"], "v", 6).select("video_id", t_(), "bin", "n", r6(F.col("scaled")).alias("scaled"))


@query("v2_frame_difference", f"WITH {PIX}, s AS (SELECT *, abs(lead(v) OVER (PARTITION BY video_id, y, x ORDER BY t) - v) AS d FROM px), f AS (SELECT video_id, t, sum(d) AS d FROM s GROUP BY 1, 2) SELECT video_id, t, round(coalesce(d, lag(d) OVER (PARTITION BY video_id ORDER BY t)), 6) AS d FROM f")
def v2(spark, d):
    return V.frame_difference(pixels(spark, d)).select("video_id", t_(), r6(F.col("d")).alias("d"))


@query("v3_frame_variance", f"WITH {PIX} SELECT video_id, t, round(var_samp(v), 9) AS var FROM px GROUP BY 1, 2")
def v3(spark, d):
    return pixels(spark, d).groupBy("video_id", "t").agg(F.round(F.var_samp("v"), 9).alias("var")).select("video_id", t_(), "var")


@query("v5_bands", f"WITH {PIX} SELECT video_id, t, CASE WHEN y < 3 THEN 'low' WHEN y < 6 THEN 'mid' ELSE 'high' END AS band, round(avg(v * v), 9) AS energy FROM px GROUP BY 1, 2, 3")
def v5(spark, d):
    band = F.when(F.col("y") < 3, "low").when(F.col("y") < 6, "mid").otherwise("high").alias("band")
    return pixels(spark, d).groupBy("video_id", "t", band).agg(F.round(F.avg(F.col("v") * F.col("v")), 9).alias("energy")).select("video_id", t_(), "band", "energy")


@query("v8_centre_crop", f"WITH {PIX} SELECT video_id, t, y, x - 1 AS x, round(v, 6) AS v FROM px WHERE y < 6 AND x BETWEEN 1 AND 6")
def v8(spark, d):
    return V.centre_crop(pixels(spark, d).where("y < 6"), 6, 8).select("video_id", t_(), "y", "x", r6(F.col("v")).alias("v"))


@query("v9_circle_mix", f"WITH {PIX}, q AS (SELECT *, least(greatest((2 + 1.5 - sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2))) / 1.5, 0), 1) AS p FROM px) SELECT video_id, t, y, x, round(v * p - v * (1 - p), 6) AS v FROM q")
def v9(spark, d):
    rows = pixels(spark, d)
    return V.circle_mix(rows, rows.withColumn("v", -F.col("v")), 3.5, 3.5, 2.0, 1.5).select("video_id", t_(), "y", "x", r6(F.col("v")).alias("v"))


@query("v10_pooled", f"WITH {PIX} SELECT video_id, t, y // 4 AS y, x // 4 AS x, round(avg(v), 9) AS v FROM px GROUP BY 1, 2, 3, 4")
def v10(spark, d):
    return V.pooled(pixels(spark, d), 4).select("video_id", t_(), "y", "x", F.round("v", 9).alias("v"))


@query("g2_blend", f"WITH {SERIES}, {VECTORS}, a AS (SELECT ch AS d, max(v) FILTER (vec_id = 0) AS p, max(v) FILTER (vec_id = 1) AS q FROM x GROUP BY 1) SELECT s.series_id, s.t, d, round(p * (s.v / 100) + q * (1 - s.v / 100), 6) AS v FROM s CROSS JOIN a")
def g2(spark, d):
    pick = lambda k: F.max(F.when(F.col("vec_id") == k, F.col("v")))
    palette = S.vectors_long(spark, d).where("vec_id < 2").groupBy(F.col("ch").cast("long").alias("d")).agg(pick(0).alias("p"), pick(1).alias("q"))
    rows = S.events_series(spark, d).crossJoin(F.broadcast(palette))
    return rows.select("series_id", t_(), "d", r6(V.blend(F.col("p"), F.col("q"), F.col("v") / 100)).alias("v"))


@query("g4_smoothed_lookup", f"WITH {SERIES.replace('value AS v', '(event_id % 8)::DOUBLE AS v')}, {COUNTS}, {kernel_sql(1.25)} SELECT series_id, t, round(v, 6) AS v FROM ({SMOOTH.format(place=CIRCULAR)})")
def g4(spark, d):
    rows = S.scan_series(S.table(spark, d, "events").withColumn("k", (F.col("event_id") % 8).cast("double")), "user_id", "ts", "k")
    return W.gaussian(rows, 1.25).select("series_id", t_(), r6(F.col("v")).alias("v"))


LAYERS = "b AS (SELECT series_id, t, ch // 8 AS layer, ch % 8 AS d, v FROM x)"


@query("g5_merge_layers", f"WITH {VECTORS}, {LAYERS} SELECT 'average' AS how, series_id, layer, round(sum(CASE WHEN layer >= 2 AND layer < 5 AND t % 2 = 0 THEN 0 ELSE v END), 6) AS total FROM b GROUP BY 2, 3 UNION ALL SELECT 'overwrite', series_id, layer, round(sum(CASE WHEN layer >= 2 AND layer < 5 AND t % 2 = 0 THEN -v ELSE v END), 6) FROM b GROUP BY 2, 3 UNION ALL SELECT 'modulate', series_id, layer, round(sum(CASE WHEN layer >= 2 AND layer < 5 AND t % 2 = 0 THEN -v * 0.25 + v * 0.75 ELSE v END), 6) FROM b GROUP BY 2, 3")
def g5(spark, d):
    base = S.vectors_long(spark, d).select("series_id", "t", F.floor(F.col("ch") / 8).alias("layer"), (F.col("ch") % 8).alias("d"), "v")
    patch, out = base.where("t % 2 = 0").withColumn("v", -F.col("v")), None
    for how in ("average", "overwrite", "modulate"):
        one = V.merge_layers(base, patch, 2, 5, how, F.lit(0.25)).groupBy("series_id", "layer").agg(r6(F.sum("v")).alias("total")).select(F.lit(how).alias("how"), "series_id", "layer", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("g8_residual", f"WITH {SERIES} SELECT series_id, t, round(avg(v) OVER w, 6) AS \"offset\", round(v - avg(v) OVER w, 6) AS residual FROM s WINDOW w AS (PARTITION BY series_id)")
def g8(spark, d):
    return V.residual(S.events_series(spark, d), ["series_id"]).select("series_id", t_(), r6(F.col("offset")).alias("offset"), r6(F.col("residual")).alias("residual"))


@query("g9_gates", f"WITH {VECTORS}, e AS (SELECT vec_id, ch, exp((v - max(v) OVER (PARTITION BY vec_id, ch // 8)) / 0.1) AS e FROM x) SELECT vec_id, ch, round(e / sum(e) OVER (PARTITION BY vec_id, ch // 8), 6) AS gate FROM e".replace("e AS (SELECT vec_id, ch, exp", "ex AS (SELECT vec_id, ch, exp").replace("AS gate FROM e", "AS gate FROM ex"))
def g9(spark, d):
    rows = S.vectors_long(spark, d).withColumn("group", F.floor(F.col("ch") / 8))
    return V.gates(rows, ["vec_id", "group"], 0.1).select("vec_id", F.col("ch").cast("long").alias("ch"), r6(F.col("gate")).alias("gate"))


@query("g13_value_lookup", f"WITH {SERIES} SELECT series_id, t, floor(((v + 2.5) % 8 + 8) % 8)::BIGINT AS p FROM s")
def g13(spark, d):
    rows = S.events_series(spark, d)
    return rows.select("series_id", t_(), V.value_lookup(rows, 2.5, 8).alias("p"))


@query("g14_tiled", f"WITH {SERIES}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT series_id, n, unnest(range(100)) AS i FROM n) SELECT g.series_id, i AS t, v FROM g JOIN s ON s.series_id = g.series_id AND s.t = i % n")
def g14(spark, d):
    return V.tiled(S.events_series(spark, d), 100).select("series_id", t_(), "v")


@query("g1_spline")
def g1(spark, d):
    palette = S.vectors_long(spark, d).where("vec_id < 6").select(F.col("vec_id").cast("int").alias("p"), F.col("ch").alias("d"), "v")
    return V.spline(palette, 6, 48)


DFT = f"""{PIX}, fq AS (SELECT video_id, t, ky, kx, sqrt(pow(sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)), 2)) / 64 AS m FROM px, range(4) AS a(ky), range(4) AS b(kx) GROUP BY 1, 2, 3, 4),
qb AS (SELECT video_id, quantile_cont(m, 0.0015) AS lo, quantile_cont(m, 0.9985) AS hi FROM fq GROUP BY 1), rd AS (SELECT video_id, t, floor(sqrt(ky * ky + kx * kx))::INT AS radius, avg(least(greatest(m, lo), hi)) AS v FROM fq JOIN qb USING (video_id) GROUP BY 1, 2, 3)"""


@query("v4_radial_spectrum", f"WITH {DFT} SELECT video_id, t, radius, round(v, 7) AS v FROM rd WHERE radius > 0")
def v4(spark, d):
    return V.radial_spectrum(pixels(spark, d)).select("video_id", t_(), "radius", F.round("v", 7).alias("v"))


def flow(spark, d):
    """Magnitude (0 to 255) and angle (0 to 255) of each pixel, from pairs of neighbouring pixels."""
    rows = pixels(spark, d)
    return rows.select("video_id", "t", "y", "x", F.floor(F.abs("v") * 255).cast("int").alias("mag"), F.pmod(F.floor(F.col("v") * 1000), F.lit(256)).cast("int").alias("ang"))


FLOW = f"""{PIX}, fl AS (SELECT video_id, t, y, x, floor(abs(v) * 255)::INT AS mag, (((floor(v * 1000)::BIGINT) % 256 + 256) % 256)::INT AS ang FROM px),
bn AS (SELECT video_id, t, mag, (SELECT min(b) FROM range(8) AS r(b) WHERE ((b * 32 + 16 - ang) % 256 + 256) % 256 <= 32) AS bin FROM fl), sm AS (SELECT video_id, t, bin, sum(mag) / 255 AS v FROM bn GROUP BY 1, 2, 3),
gd AS (SELECT DISTINCT video_id, t, b AS bin FROM fl, range(8) AS r(b)), fu AS (SELECT gd.*, coalesce(sm.v, 0) AS v FROM gd LEFT JOIN sm USING (video_id, t, bin)), nn AS (SELECT video_id, max(t) AS z FROM fu GROUP BY 1),
md AS (SELECT a.video_id, a.t, a.bin, quantile_disc(b.v, 0.5) AS v FROM fu a JOIN nn USING (video_id) CROSS JOIN (VALUES (-1), (0), (1)) AS p(dt) CROSS JOIN (VALUES (-1), (0), (1)) AS q(db) JOIN fu b ON b.video_id = a.video_id AND b.t = CASE WHEN a.t + dt < 0 THEN 1 WHEN a.t + dt > z THEN z - 1 ELSE a.t + dt END AND b.bin = CASE WHEN a.bin + db < 0 THEN 1 WHEN a.bin + db > 7 THEN 6 ELSE a.bin + db END GROUP BY 1, 2, 3)"""


@query("v6_direction_spectrum", f"WITH {FLOW} SELECT video_id, t, bin, round(v, 6) AS v FROM md")
def v6(spark, d):
    return V.direction_spectrum(flow(spark, d), 8).select("video_id", t_(), F.col("bin").cast("long").alias("bin"), r6(F.col("v")).alias("v"))


ONSETS = "rs AS (SELECT video_id, t, sum(greatest(n - v, 0)) AS v FROM (SELECT *, lead(v, 1, 0.0) OVER (PARTITION BY video_id, {bin} ORDER BY t) AS n FROM {source}) GROUP BY 1, 2), qq AS (SELECT video_id, quantile_cont(v, 0.025) AS a, quantile_cont(v, 0.975) AS b FROM rs GROUP BY 1), oc AS (SELECT video_id, t, least(greatest(v, a), b) AS v FROM rs JOIN qq USING (video_id)) SELECT video_id AS series_id, t, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 5) AS v FROM oc WINDOW w AS (PARTITION BY video_id)"


@query("v7_direction_onsets", f"WITH {FLOW}, {ONSETS.format(bin='bin', source='md')}")
def v7(spark, d):
    rows = V.direction_spectrum(flow(spark, d), 8).select(F.col("video_id").alias("series_id"), "t", F.col("bin").alias("ch"), "v")
    return V.spectrum_onsets(rows).select("series_id", t_(), F.round("v", 5).alias("v"))


@query("v7_spectral_onsets", f"WITH {DFT}, rp AS (SELECT * FROM rd WHERE radius > 0), {ONSETS.format(bin='radius', source='rp')}")
def v7b(spark, d):
    rows = V.radial_spectrum(pixels(spark, d)).select(F.col("video_id").alias("series_id"), "t", F.col("radius").alias("ch"), "v")
    return V.spectrum_onsets(rows).select("series_id", t_(), F.round("v", 5).alias("v"))


def chroma_weights(spark, d):
    rows = S.vectors_long(spark, d).groupBy("series_id", "t", (F.col("ch") % 12).cast("long").alias("p"))
    return rows.agg(F.sum(F.abs("v")).alias("w"))


def palette(spark, d):
    return S.vectors_long(spark, d).where("vec_id < 12").select(F.col("vec_id").alias("p"), F.col("ch").cast("long").alias("d"), "v")


WEIGHTS = "cw AS (SELECT series_id, t, ch % 12 AS p, sum(abs(v)) AS w FROM x GROUP BY 1, 2, 3), pl AS (SELECT vec_id AS p, ch AS d, v FROM x WHERE vec_id < 12), cn AS (SELECT series_id, t, p, w / sum(w) OVER (PARTITION BY series_id, t) AS w FROM cw), mx AS (SELECT cn.series_id, t, d, sum(w * v) AS v FROM cn JOIN pl USING (p) GROUP BY 1, 2, 3)"


@query("g3_chroma_mix", f"WITH {VECTORS}, {WEIGHTS} SELECT series_id, t, d, round(v, 6) AS v FROM mx")
def g3(spark, d):
    weights = chroma_weights(spark, d).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("series_id", "t")))
    return mix(weights, palette(spark, d)).select("series_id", t_(), "d", r6(F.col("v")).alias("v"))


@query("g6_patch_stack", f"WITH {VECTORS}, {LAYERS}, p1 AS (SELECT series_id, t, layer, d, CASE WHEN layer < 4 THEN (v - v) / 2 ELSE v END AS v FROM b), p2 AS (SELECT p1.series_id, p1.t, p1.layer, p1.d, CASE WHEN p1.layer >= 2 AND p1.layer < 6 AND p1.t % 2 = 0 THEN 2 * b.v * 0.25 + p1.v * 0.75 ELSE p1.v END AS v FROM p1 JOIN b USING (series_id, t, layer, d)), p3 AS (SELECT p2.series_id, p2.t, p2.layer, p2.d, CASE WHEN p2.layer = 7 AND p2.t % 3 = 0 THEN 1.0 ELSE p2.v END AS v FROM p2) SELECT series_id, t, layer, round(sum(v), 6) AS total FROM p3 GROUP BY 1, 2, 3")
def g6(spark, d):
    base = S.vectors_long(spark, d).select("series_id", "t", F.floor(F.col("ch") / 8).alias("layer"), (F.col("ch") % 8).alias("d"), "v")
    steps = [
        (base.withColumn("v", -F.col("v")), 0, 4, "average", 0.0),
        (base.where("t % 2 = 0").withColumn("v", 2 * F.col("v")), 2, 6, "modulate", 0.25),
        (base.where("t % 3 = 0").withColumn("v", F.lit(1.0)), 7, 8, "overwrite", 0.0),
    ]
    return V.patched(base, steps).groupBy("series_id", t_(), "layer").agg(r6(F.sum("v")).alias("total"))


def u_sql(ident: str, seed: int) -> str:
    return f"({LCG.format(id=LCG.format(id=f'({ident})', seed=seed) + ' + 7919', seed=seed)} / 2147483648.0)"


def normal_sql(ident: str, seed: int, other: int) -> str:
    return f"sqrt(-2 * ln(1 - {u_sql(ident, seed)})) * cos(2 * pi() * {u_sql(ident, other)})"


NOISE = f"nz AS MATERIALIZED (SELECT (id // 16)::INT AS m, (id // 4 % 4)::INT AS y, (id % 4)::INT AS x, {normal_sql('id', 5, 6)} AS z FROM range(48) AS r(id)), ny AS MATERIALIZED (SELECT (id // 16)::INT AS m, (id // 4 % 4)::INT AS y, (id % 4)::INT AS x, {normal_sql('id', 15, 16)} AS z FROM range(48) AS r(id))"


@query("g7_noise", f"""WITH {SERIES}, {NOISE}, mo AS (SELECT series_id, t, m, ((t + 1) * (m + 1) % 7) / 7.0 AS w FROM s, range(3) AS r(m)), n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1),
bl AS (SELECT series_id, t, nz.y, nz.x, sum(w * nz.z + (1 - w) * ny.z) AS v FROM mo JOIN nz ON nz.m = mo.m JOIN ny ON ny.m = nz.m AND ny.y = nz.y AND ny.x = nz.x GROUP BY 1, 2, 3, 4), mu AS (SELECT series_id, t, y, x, sum(w * z) AS v FROM mo JOIN nz ON nz.m = mo.m GROUP BY 1, 2, 3, 4),
wd AS (SELECT y, x, max(z) FILTER (m = 0) AS a, max(z) FILTER (m = 1) AS b, max(z) FILTER (m = 2) AS c FROM nz GROUP BY 1, 2), l1 AS (SELECT series_id, t, y, x, sin(cos(t * 4 * pi() / greatest(n - 1, 1) + a) * 10 + b) * c AS v FROM s JOIN n USING (series_id), wd), lo AS (SELECT series_id, t, y, x, v / (sqrt(avg(v * v) OVER (PARTITION BY series_id, t)) + pow(2, -23)) AS v FROM l1)
SELECT bl.series_id, bl.t, round(sum((bl.v + lo.v) / 2 * (bl.y * 4 + bl.x + 1)), 4) AS average, round(sum((mu.v * 0.3 + lo.v * 0.7) * 2 + 1), 4) AS modulated FROM bl JOIN lo USING (series_id, t, y, x) JOIN mu USING (series_id, t, y, x) GROUP BY 1, 2""")
def g7(spark, d):
    rows = S.events_series(spark, d)
    first, second = V.noise_base(spark, 3, 4, 4, 5), V.noise_base(spark, 3, 4, 4, 15)
    weights = rows.select("series_id", "t").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("w", F.pmod((F.col("t") + 1) * (F.col("m") + 1), F.lit(7)) / 7.0)
    blended, product = V.noise_blend(first, second, weights), V.noise_blend(first, None, weights)
    looped = V.noise_loop(first, rows.select("series_id", "t", F.count("*").over(Window.partitionBy("series_id")).alias("n")), 2.0, 5.0)
    a = V.noise_pair(blended, looped).groupBy("series_id", "t").agg(F.round(F.sum(F.col("v") * (F.col("y") * 4 + F.col("x") + 1)), 4).alias("average"))
    b = V.noise_pair(product, looped, F.lit(0.3)).groupBy("series_id", "t").agg(F.round(F.sum(2 * F.col("v") + 1), 4).alias("modulated"))
    return a.join(b, ["series_id", "t"]).select("series_id", t_(), "average", "modulated")


ID = "series_id * 1009 + step"


@query("g10_n16_configured", f"WITH {SERIES}, g AS (SELECT DISTINCT series_id, k AS step FROM s, range(5) AS r(k)) SELECT series_id, step, CASE WHEN {u_sql(ID, 3)} < 2 / 7.0 THEN '4' WHEN {u_sql(ID, 3)} < 4 / 7.0 THEN '8' WHEN {u_sql(ID, 3)} < 6 / 7.0 THEN '16' ELSE '32' END AS bars, CASE WHEN {u_sql(ID, 13)} < 0.25 THEN 'average' ELSE 'modulate' END AS merge, round(0.666 + 0.5 * CASE WHEN {normal_sql(ID, 104, 105)} >= 0 THEN 1 ELSE -1 END * (5 / sqrt(26.0) * ({normal_sql(ID, 104, 105)}) + sqrt(1 - 25 / 26.0) * ({normal_sql(ID, 106, 107)})), 6) AS weight FROM g")
def g10(spark, d):
    choices = {"bars": {"4": 2, "8": 2, "16": 2, "32": 1}, "merge": {"average": 1, "modulate": 3}}
    found = V.configured(S.events_series(spark, d), 5, choices, 3)
    return found.select("series_id", F.col("step").cast("long").alias("step"), "bars", "merge", r6(F.col("weight")).alias("weight"))


@query("g11_control")
def g11(spark, d):
    out = None
    for sigma in (1.0, 4.0, 16.0):
        one = V.control(S.events_series(spark, d), 8, sigma, 21).withColumn("sigma", F.lit(sigma))
        out = one if out is None else out.unionByName(one)
    return out


@query("g11_driven", f"WITH {VECTORS}, {WEIGHTS}, s AS (SELECT series_id * 64 + d AS series_id, t, v FROM mx), {COUNTS}, {kernel_sql(1.5)} SELECT series_id // 64 AS series_id, t, series_id % 64 AS d, round(v, 6) AS v FROM ({SMOOTH.format(place=CIRCULAR)})")
def g11b(spark, d):
    return V.driven(chroma_weights(spark, d), palette(spark, d), 1.5).select("series_id", t_(), "d", r6(F.col("v")).alias("v"))


@query("g12_cross_faded")
def g12(spark, d):
    rows = S.table(spark, d, "embeddings")
    rows = rows.select(F.col("label").alias("series_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), F.col("embedding").alias("x"))
    return V.cross_faded(rows, rows.where("t % 10 = 9").select("series_id", F.col("t").alias("start")), 6)


@query("g12_smoothed_before", f"WITH {SERIES.replace('s AS', 'z AS', 1)}, b AS (SELECT series_id, t AS start, greatest(t - 6, 0) AS first FROM z WHERE t % 13 = 12), w AS (SELECT z.series_id, z.t, z.v, start, first FROM z JOIN b ON b.series_id = z.series_id AND z.t >= first AND z.t < start), s AS (SELECT series_id * 1000 + start AS series_id, t - first AS t, v FROM w), {COUNTS}, {kernel_sql(2.0)}, g AS ({SMOOTH.format(place=CIRCULAR)}) SELECT z.series_id, z.t, round(coalesce(g.v, z.v), 6) AS v FROM z LEFT JOIN w ON w.series_id = z.series_id AND w.t = z.t LEFT JOIN g ON g.series_id = w.series_id * 1000 + w.start AND g.t = w.t - w.first")
def g12b(spark, d):
    rows = S.events_series(spark, d).select("series_id", "t", "v")
    return V.smoothed_before(rows, rows.where("t % 13 = 12").select("series_id", F.col("t").alias("start")), 6, 2.0).select("series_id", t_(), r6(F.col("v")).alias("v"))
