"""Queries over self-similarity and spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scalars as N
from cadenza.operators import distances as D
from cadenza.operators import segments as C
from cadenza.operators import spectra as X
from cadenza.operators.matching import neighbour_median
from cadenza.plans._register import SERIES, VECTORS, query, r6
from cadenza.plans.windows import COUNTS
from cadenza.sources import tables as S


def vectors(spark, d):
    rows = S.table(spark, d, "embeddings")
    return rows.select(F.col("label").alias("series_id"), F.col("embedding").alias("x"), "vec_id").withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("vec_id")) - 1).drop("vec_id")


VEC = "v AS (SELECT label AS series_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding::DOUBLE[] AS x FROM embeddings)"
DIST = f"{VEC}, d AS (SELECT a.series_id, a.t AS i, b.t AS j, round(sqrt(pow(list_distance(a.x, b.x), 2) + 1e-8), 9) AS d FROM v a JOIN v b ON a.series_id = b.series_id AND a.t <> b.t)"


def rec(width: int) -> str:
    """Recurrence links w of frames at least so far apart; n: frames of each series."""
    return f"""{DIST}, n AS (SELECT series_id, count(*) AS n FROM v GROUP BY 1), k AS (SELECT d.*, row_number() OVER (PARTITION BY series_id, i ORDER BY d, j) AS r, n FROM d JOIN n USING (series_id) WHERE abs(i - j) >= {width}),
h AS (SELECT series_id, i, j, d FROM k WHERE r <= 2 * ceil(sqrt(greatest(n - {2 * width - 1}, 1)))), m AS (SELECT h.* FROM h SEMI JOIN h g ON h.series_id = g.series_id AND h.i = g.j AND h.j = g.i),
b AS (SELECT series_id, quantile_disc(x, 0.5) AS b FROM (SELECT series_id, i, max(d) AS x FROM m GROUP BY 1, 2) GROUP BY 1), w AS (SELECT m.series_id, i, j, exp(-d / b) AS w FROM m JOIN b USING (series_id))"""


REC = rec(1)
#: Medians me of 7 cells along each diagonal of w.
ALONG = """lg AS (SELECT series_id, i - j AS lag, j, w FROM w), us AS (SELECT DISTINCT lg.series_id, lag, n FROM lg JOIN n USING (series_id)),
gr AS (SELECT series_id, lag, n, unnest(range(n)) AS j FROM us), fu AS (SELECT gr.series_id, gr.lag, gr.n, gr.j, coalesce(lg.w, 0) AS w FROM gr LEFT JOIN lg USING (series_id, lag, j)), oo AS (SELECT unnest(range(-3, 4)) AS o),
me AS (SELECT f.series_id, f.lag, f.n, f.j, quantile_disc(g.w, 0.5) AS w FROM fu f CROSS JOIN oo JOIN fu g ON g.series_id = f.series_id AND g.lag = f.lag AND g.j = f.n - 1 - abs(f.n - 1 - abs(f.j + o)) GROUP BY 1, 2, 3, 4)"""
PATH = "q AS (SELECT series_id, i, j, d * d AS q FROM d WHERE j = i + 1), qm AS (SELECT series_id, quantile_disc(q, 0.5) AS m FROM q GROUP BY 1), pa AS (SELECT series_id, i, j, exp(-q / m) AS w FROM q JOIN qm USING (series_id))"
#: Symmetric links a of the balanced combination of recurrence and path.
BALANCED = f"""{rec(3)}, {ALONG}, {PATH}, rp AS (SELECT series_id, j + lag AS i, j, w AS r, 0 AS p FROM me WHERE w > 0 AND j + lag >= 0 AND j + lag < n UNION ALL SELECT series_id, i, j, 0, w FROM pa UNION ALL SELECT series_id, j, i, 0, w FROM pa),
de AS (SELECT series_id, i, sum(r) AS r, sum(p) AS p FROM rp GROUP BY 1, 2), mu AS (SELECT series_id, sum(p * (p + r)) / sum((p + r) * (p + r)) AS m FROM de GROUP BY 1), mi AS (SELECT series_id, i, j, (m * r + (1 - m) * p) / 2 AS w FROM rp JOIN mu USING (series_id)),
a AS (SELECT series_id, i, j, sum(w) AS w FROM (FROM mi UNION ALL SELECT series_id, j, i, w FROM mi) GROUP BY 1, 2, 3)"""


@query("c1_distances", f"WITH {DIST} SELECT series_id, i, round(avg(d), 5) AS mean, round(min(d), 5) AS low FROM d GROUP BY 1, 2")
def c1(spark, d):
    return C.distances(vectors(spark, d)).groupBy("series_id", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("d"), 5).alias("mean"), F.round(F.min("d"), 5).alias("low"))


@query("c2_recurrence", f"WITH {REC} SELECT series_id, count(*) AS links, round(sum(w), 4) AS weight FROM w GROUP BY 1")
def c2(spark, d):
    return C.recurrence(vectors(spark, d)).groupBy("series_id").agg(F.count("*").alias("links"), F.round(F.sum("w"), 4).alias("weight"))


@query("c4_path_similarity", f"WITH {DIST}, q AS (SELECT series_id, i, j, d * d AS q FROM d WHERE j = i + 1), m AS (SELECT series_id, quantile_disc(q, 0.5) AS m FROM q GROUP BY 1) SELECT series_id, i, round(exp(-q / m), 5) AS w FROM q JOIN m USING (series_id)")
def c4(spark, d):
    return C.path_similarity(vectors(spark, d)).select("series_id", F.col("i").cast("long").alias("i"), F.round("w", 5).alias("w"))


@query("c5_laplacian", f"WITH {BALANCED}, g AS (SELECT series_id, i, sum(w) AS d FROM a GROUP BY 1, 2) SELECT a.series_id, a.i, count(*) AS links, round(sum(-a.w / sqrt(x.d * y.d)), 5) AS row_sum, round(sum(-a.w / sqrt(x.d * y.d) * (a.j + 1)), 3) AS moment FROM a JOIN g x ON x.series_id = a.series_id AND x.i = a.i JOIN g y ON y.series_id = a.series_id AND y.i = a.j GROUP BY 1, 2")
def c5(spark, d):
    return C.laplacian(C.segment_links(vectors(spark, d))).groupBy("series_id", F.col("i").cast("long").alias("i")).agg(F.count("*").alias("links"), F.round(F.sum("l"), 5).alias("row_sum"), F.round(F.sum(F.col("l") * (F.col("j") + 1)), 3).alias("moment"))


@query("c6_laplacian_segments")
def c6(spark, d):
    return C.laplacian_segmentations(C.segment_links(vectors(spark, d)), [2, 4, 6, 8])


@query("c3_timelag_median", f"WITH {REC}, {ALONG} SELECT series_id, j + lag AS i, j, round(w, 6) AS w FROM me WHERE w > 0 AND j + lag >= 0 AND j + lag < n")
def c3(spark, d):
    rows = vectors(spark, d)
    counts = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    return C.timelag_median(C.recurrence(rows), counts).select("series_id", "i", "j", r6(F.col("w")).alias("w"))


@query("c7_seeds")
def c7(spark, d):
    return C.seeds(vectors(spark, d), 4)


@query("c8_soft_k_means")
def c8(spark, d):
    return C.soft_k_means(vectors(spark, d), 3, 4)


@query("c9_k_means")
def c9(spark, d):
    return C.k_means(S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), 10).select("vec_id", "cluster")


@query("c10_principal")
def c10(spark, d):
    rows = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return C.principal(rows, 4).select("vec_id", "components")


def warped_pairs(spark, d):
    """Distances by dynamic time warping between the daily means of event types, and the types."""
    daily = S.table(spark, d, "events").groupBy(F.col("event_type").alias("item"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    t = F.row_number().over(Window.partitionBy("item").orderBy("day")) - 1
    rows = daily.withColumn("t", t)
    met = rows.select(F.col("item").alias("a"), "t", F.col("v").alias("x")).join(rows.select(F.col("item").alias("b"), "t", F.col("v").alias("y")), "t").where("a <> b")
    keyed = met.select(F.struct("a", "b").alias("pair_id"), "t", "x", "y")
    return D.dtw(keyed, 8).select("pair_id.a", "pair_id.b", F.col("dtw").alias("d")), rows.select("item").distinct()


@query("c11_medoids")
def c11(spark, d):
    return C.medoids(*warped_pairs(spark, d), 2)


@query("c11_linkage")
def c11b(spark, d):
    pairs, items = warped_pairs(spark, d)
    return C.linkage(pairs.where("a < b"), items, 2)


@query("c12_relabelled")
def c12(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.lit(0).alias("series_id"), F.col("vec_id").alias("t"), F.col("label").alias("target"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(3)) % 10).alias("predicted"))
    return C.relabelled(rows, 10)


@query("c14_gramian", f"WITH {SERIES}, k AS MATERIALIZED (SELECT series_id, t, acos(least(greatest(2 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) - 1, -1), 1)) AS a FROM s WINDOW w AS (PARTITION BY series_id)) SELECT a.series_id, a.t AS i, round(sum(cos(a.a + b.a)), 5) AS total FROM k a JOIN k b USING (series_id) GROUP BY 1, 2")
def c14(spark, d):
    return C.gramian(S.events_series(spark, d)).groupBy("series_id", F.col("i").cast("long").alias("i")).agg(F.round(F.sum("g"), 5).alias("total"))


FRAMES = f"{COUNTS}, fr AS (SELECT series_id, frame, k, ((frame * 4 + k - 4) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) AS m, n FROM (SELECT series_id, n, unnest(range(greatest(n // 4, 1))) AS frame FROM n), range(8) AS r(k)), ff AS (SELECT fr.series_id, frame, k, v FROM fr JOIN s ON s.series_id = fr.series_id AND s.t = least(m, 2 * n - 2 - m))"
STFT = f"{FRAMES}, sp AS (SELECT series_id, frame, b AS bin, sqrt(pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 8)) * cos(2 * pi() * k * b / 8)), 2) + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 8)) * sin(2 * pi() * k * b / 8)), 2)) AS mag FROM ff, range(5) AS q(b) GROUP BY 1, 2, 3)"


def spectrum(spark, d):
    return X.stft(X.frames(S.events_series(spark, d), 8, 4), 8)


@query("x1_frames", f"WITH {SERIES}, {FRAMES} SELECT series_id, frame, round(sum(v * (k + 1)), 5) AS moment FROM ff GROUP BY 1, 2")
def x1(spark, d):
    return X.frames(S.events_series(spark, d), 8, 4).groupBy("series_id", F.col("frame").cast("long").alias("frame")).agg(F.round(F.sum(F.col("v") * (F.col("k") + 1)), 5).alias("moment"))


@query("x2_stft", f"WITH {SERIES}, {STFT} SELECT series_id, frame, bin, round(mag, 5) AS mag FROM sp")
def x2(spark, d):
    return spectrum(spark, d).select("series_id", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), F.round("mag", 5).alias("mag"))


@query("x2_stft_batches", f"WITH {SERIES}, {STFT} SELECT series_id, frame, round(sum(mag), 4) AS total FROM sp GROUP BY 1, 2")
def x2b(spark, d):
    rows = X.stft_batches(X.frames(S.events_series(spark, d), 8, 4), 8)
    return rows.select("series_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("mag", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


BANK = f"{STFT}, bk AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in X.triangles(5, 3)) + ") AS bk(bin, band, w)), bd AS (SELECT series_id, frame, band, sum(mag * w) AS v FROM sp JOIN bk USING (bin) GROUP BY 1, 2, 3)"


@query("x3_filter_bank", f"WITH {SERIES}, {BANK} SELECT series_id, frame, band, round(v, 5) AS v FROM bd")
def x3(spark, d):
    return X.filter_bank(spectrum(spark, d), X.triangles(5, 3)).select("series_id", F.col("frame").cast("long").alias("frame"), "band", F.round("v", 5).alias("v"))


@query("x4_cepstrum", f"WITH {SERIES}, {BANK} SELECT series_id, frame, c::INT AS coef, round(sum(ln(v + 1) * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / 3.0) * cos(pi() * (band + 0.5) * c / 3)), 5) AS v FROM bd, range(2) AS q(c) GROUP BY 1, 2, 3")
def x4(spark, d):
    bands = X.filter_bank(spectrum(spark, d), X.triangles(5, 3)).withColumn("v", F.ln(F.col("v") + 1))
    return X.dct(bands, 3, 2).select("series_id", F.col("frame").cast("long").alias("frame"), "coef", F.round("v", 5).alias("v"))


@query("x14_tempo", f"WITH {SERIES}, a AS (SELECT x.series_id, l AS lag, sum(x.v * y.v) AS r FROM s x CROSS JOIN range(17) AS q(l) JOIN s y ON y.series_id = x.series_id AND y.t = x.t + l GROUP BY 1, 2), z AS (SELECT a.series_id, a.lag, a.r / b.r AS r, 60.0 * 24 / a.lag AS bpm FROM a JOIN a b ON a.series_id = b.series_id AND b.lag = 0 WHERE a.lag > 0), p AS (SELECT *, round(r * exp(-0.5 * pow(log2(bpm / 120), 2)), 9) AS sc FROM z), t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sc DESC, lag) AS k FROM p) SELECT series_id, round(bpm::DOUBLE, 6) AS bpm FROM t WHERE k = 1")
def x14(spark, d):
    return X.tempo(S.events_series(spark, d), 16, 24.0).select("series_id", r6(F.col("bpm")).alias("bpm"))


def masked_sql(k: int) -> str:
    """Medians along frames and along bins of the spectrum sp, reflected, and soft masks."""
    at = lambda x, n: f"CASE WHEN {n} = 1 THEN 0 ELSE least((({x}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2), 2 * {n} - 2 - (({x}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2)) END"
    return f"""fc AS (SELECT series_id, max(frame) + 1 AS fn FROM sp GROUP BY 1), ok AS (SELECT unnest(range({-(k // 2)}, {k // 2 + 1})) AS o),
hm AS (SELECT a.series_id, a.frame, a.bin, quantile_disc(b.mag, 0.5) AS h FROM sp a JOIN fc USING (series_id) CROSS JOIN ok JOIN sp b ON b.series_id = a.series_id AND b.bin = a.bin AND b.frame = {at('a.frame + o', 'fn')} GROUP BY 1, 2, 3),
pm AS (SELECT a.series_id, a.frame, a.bin, quantile_disc(b.mag, 0.5) AS p FROM sp a CROSS JOIN ok JOIN sp b ON b.series_id = a.series_id AND b.frame = a.frame AND b.bin = {at('a.bin + o', '5')} GROUP BY 1, 2, 3),
mk AS (SELECT series_id, frame, bin, mag, CASE WHEN greatest(h, 8 * p) <= 0 THEN 0 ELSE pow(h, 2) / (pow(h, 2) + pow(8 * p, 2)) END * mag AS harmonic, CASE WHEN greatest(p, 8 * h) <= 0 THEN 0 ELSE pow(p, 2) / (pow(p, 2) + pow(8 * h, 2)) END * mag AS percussive FROM sp JOIN hm USING (series_id, frame, bin) JOIN pm USING (series_id, frame, bin))"""


@query("x5_harmonic_percussive", f"WITH {SERIES}, {STFT.replace('AS mag FROM', 'AS mg FROM').replace('sp AS (', 'sq AS (')}, sp AS (SELECT series_id, frame, bin, round(mg, 9) AS mag FROM sq), {masked_sql(31)} SELECT series_id, frame, bin, round(harmonic, 4) AS harmonic, round(percussive, 4) AS percussive FROM mk")
def x5(spark, d):
    rows = X.harmonic_percussive(spectrum(spark, d).withColumn("mag", F.round("mag", 9)))
    return rows.select("series_id", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), F.round("harmonic", 4).alias("harmonic"), F.round("percussive", 4).alias("percussive"))


#: Hop, rate, lowest bin, bins and bins an octave.
CQ = (4, 24.0, 1.5, 12, 6)
CQ_SQL = """kn AS (SELECT b AS bin, 1.5 * pow(2, b / 6.0) AS f, 24 / (1.5 * pow(2, b / 6.0)) / (pow(2, 1 / 6.0) - 1) / 2 AS half FROM range(12) AS r(b)), kw AS (SELECT bin, o, 0.5 + 0.5 * cos(pi() * o / half) AS w, 2 * pi() * f / 24 * o AS turn FROM kn, range(-65, 66) AS r(o) WHERE abs(o) <= half),
fo AS (SELECT series_id, n, frame, o, ((frame * 4 + o) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) AS m FROM (SELECT series_id, n, unnest(range(greatest(n // 4, 1))) AS frame FROM n), range(-65, 66) AS r(o)), fv AS (SELECT fo.series_id, frame, o, v FROM fo JOIN s ON s.series_id = fo.series_id AND s.t = least(m, 2 * n - 2 - m))"""


@query("x6_constant_q", f"WITH {SERIES}, {COUNTS}, {CQ_SQL} SELECT series_id, frame, bin, round(sqrt(pow(sum(v * w * cos(turn)), 2) + pow(sum(v * w * sin(turn)), 2)) / sum(w), 5) AS mag FROM fv JOIN kw USING (o) GROUP BY 1, 2, 3")
def x6(spark, d):
    rows = X.constant_q(S.events_series(spark, d), *CQ, halve=False)
    return rows.select("series_id", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), F.round("mag", 5).alias("mag"))


@query("x6_constant_q_octaves")
def x6b(spark, d):
    return X.constant_q(S.events_series(spark, d), 8, 24.0, 0.75, 18, 6)


CHROMA = f"{VECTORS}, ch AS (SELECT series_id, t AS frame, ch % 12 AS pitch, round(sum(abs(v)), 9) AS v FROM x GROUP BY 1, 2, 3)"
STEPS = "(CASE WHEN u > 0.05 THEN 0.25 ELSE 0 END + CASE WHEN u > 0.1 THEN 0.25 ELSE 0 END + CASE WHEN u > 0.2 THEN 0.25 ELSE 0 END + CASE WHEN u > 0.4 THEN 0.25 ELSE 0 END)"
CENS = f"""un AS (SELECT series_id, frame, pitch, v / sum(v) OVER (PARTITION BY series_id, frame) AS u FROM ch), qu AS (SELECT series_id, frame, pitch, {STEPS} AS q FROM un),
hk AS (SELECT k - 21 AS o, (0.5 - 0.5 * cos(2 * pi() * k / 43)) AS w FROM range(43) AS r(k)), hw AS (SELECT o, w / sum(w) OVER () AS w FROM hk),
sm AS (SELECT a.series_id, a.frame, a.pitch, sum(w * b.q) AS v FROM qu a CROSS JOIN hw JOIN qu b ON b.series_id = a.series_id AND b.pitch = a.pitch AND b.frame = a.frame + o GROUP BY 1, 2, 3),
ce AS (SELECT series_id, frame, pitch, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY series_id, frame)), 0), 0) AS v FROM sm)"""


def chroma(spark, d):
    rows = S.vectors_long(spark, d).select("series_id", F.col("t").alias("frame"), F.col("ch").alias("bin"), F.abs("v").alias("mag"))
    return X.folded(rows).withColumn("v", F.round("v", 9))


@query("x7_cens", f"WITH {CHROMA}, {CENS} SELECT series_id, frame, pitch, round(v, 5) AS v FROM ce")
def x7(spark, d):
    return X.cens(chroma(spark, d)).select("series_id", F.col("frame").cast("long").alias("frame"), F.col("pitch").cast("long").alias("pitch"), F.round("v", 5).alias("v"))


@query("x7_n13_tonal_centroids", f"WITH {CHROMA}, un AS (SELECT series_id, frame, pitch, v / sum(v) OVER (PARTITION BY series_id, frame) AS u FROM ch), ax AS (SELECT * FROM (VALUES (0, 7 / 6.0, 1.0), (1, 7 / 6.0, 1.0), (2, 1.5, 1.0), (3, 1.5, 1.0), (4, 2 / 3.0, 0.5), (5, 2 / 3.0, 0.5)) AS ax(axis, turn, radius)) SELECT series_id, frame, axis, round(sum(u * radius * cos(pi() * (turn * pitch * 12 / 11.0 - CASE WHEN axis % 2 = 0 THEN 0.5 ELSE 0 END))), 5) AS v FROM un, ax GROUP BY 1, 2, 3")
def x7b(spark, d):
    return X.tonal_centroids(chroma(spark, d)).select("series_id", F.col("frame").cast("long").alias("frame"), "axis", F.round("v", 5).alias("v"))


@query("n14_quantised", f"WITH {CHROMA}, un AS (SELECT series_id, frame, pitch, v / sum(v) OVER (PARTITION BY series_id, frame) AS u FROM ch) SELECT series_id, frame, pitch, {STEPS} AS exact FROM un")
def n14(spark, d):
    unit = chroma(spark, d).withColumn("u", N.norm("l1", ["series_id", "frame"]))
    return unit.select("series_id", F.col("frame").cast("long").alias("frame"), F.col("pitch").cast("long").alias("pitch"), X.quantised(F.col("u")).alias("exact"))


@query("n14_quantised_smoothly")
def n14b(spark, d):
    unit = chroma(spark, d).withColumn("u", N.norm("l1", ["series_id", "frame"]))
    return unit.select("series_id", "frame", "pitch", "u", X.quantised_smoothly(F.col("u")).alias("smooth"))


PEAKS = f"{STFT.replace('AS mag FROM', 'AS mg FROM').replace('sp AS (', 'sq AS (')}, sp AS (SELECT series_id, frame, bin, round(mg, 9) AS mag FROM sq), wk AS (SELECT *, lag(mag) OVER o AS a, lead(mag) OVER o AS c, max(mag) OVER (PARTITION BY series_id, frame) AS top FROM sp WINDOW o AS (PARTITION BY series_id, frame ORDER BY bin)), pk AS (SELECT series_id, frame, (bin + 0.5 * (a - c) / (a - 2 * mag + c)) * 3.0 AS hz, mag - 0.25 * (a - c) * (0.5 * (a - c) / (a - 2 * mag + c)) AS mag FROM wk WHERE mag > a AND mag > c AND mag > 0.1 * top)"


def peaks(spark, d):
    return X.pitch_peaks(spectrum(spark, d).withColumn("mag", F.round("mag", 9)), 8, 24.0)


@query("x9_pitch_peaks", f"WITH {SERIES}, {PEAKS} SELECT series_id, frame, round(hz, 5) AS hz, round(mag, 4) AS mag FROM pk")
def x9(spark, d):
    return peaks(spark, d).select("series_id", F.col("frame").cast("long").alias("frame"), F.round("hz", 5).alias("hz"), F.round("mag", 4).alias("mag"))


@query("x9_tuning", f"WITH {SERIES}, {PEAKS}, r AS (SELECT series_id, round(hz, 9) AS hz, round(mag, 9) AS mag FROM pk), md AS (SELECT series_id, quantile_disc(mag, 0.5) AS m FROM r GROUP BY 1), fo AS (SELECT series_id, 12 * log2(hz / 27.5) AS p FROM r JOIN md USING (series_id) WHERE mag >= m AND hz > 0), rs AS (SELECT series_id, CASE WHEN p - floor(p) >= 0.5 THEN p - floor(p) - 1 ELSE p - floor(p) END AS x FROM fo), hb AS (SELECT series_id, floor((x + 0.5) / 0.25) AS b, count(*) AS n FROM rs GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, b) AS k FROM hb) SELECT series_id, round(b * 0.25 - 0.5, 6) AS tuning FROM rk WHERE k = 1")
def x9b(spark, d):
    rows = peaks(spark, d).withColumn("hz", F.round("hz", 9)).withColumn("mag", F.round("mag", 9))
    return X.tuning(rows, 0.25).select("series_id", r6(F.col("tuning")).alias("tuning"))


@query("x10_pitch_class_profile", f"WITH {SERIES}, {PEAKS}, pc AS (SELECT pk.series_id, frame, p AS pitch, mag, 12 * log2(hz / 440) - p + 6 AS z FROM pk, range(12) AS q(p) WHERE hz > 0), dd AS (SELECT *, z - 12 * floor(z / 12) - 6 AS d FROM pc), su AS (SELECT series_id, frame, pitch, sum(pow(cos(d * pi()), 2) * mag * mag) AS v FROM dd WHERE abs(d) <= 0.5 GROUP BY 1, 2, 3) SELECT series_id, frame, pitch::INT AS pitch, round(v / max(v) OVER (PARTITION BY series_id, frame), 5) AS v FROM su")
def x10(spark, d):
    rows = X.pitch_class_profile(peaks(spark, d))
    return rows.select("series_id", F.col("frame").cast("long").alias("frame"), "pitch", F.round("v", 5).alias("v"))


HARMONIC = f"""{COUNTS}, fr AS (SELECT series_id, frame, k, ((frame * 4 + k - 16) % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) AS m, n FROM (SELECT series_id, n, unnest(range(greatest(n // 4, 1))) AS frame FROM n), range(32) AS r(k)),
ff AS (SELECT fr.series_id, frame, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS v FROM fr JOIN s ON s.series_id = fr.series_id AND s.t = least(m, 2 * n - 2 - m)),
sp AS (SELECT series_id, frame, b AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * k * b / 32)), 2) + pow(sum(v * sin(2 * pi() * k * b / 32)), 2)), 9) AS mag FROM ff, range(17) AS q(b) GROUP BY 1, 2, 3),
db AS (SELECT series_id, frame, bin, CASE WHEN mag > 0 THEN 20 * log10(mag) END AS db FROM sp WHERE bin * 250 > 100 AND bin * 250 < 5000),
gl AS (SELECT series_id, frame, bin, greatest(coalesce(db - max(db) OVER (PARTITION BY series_id) + 80, 0), 0) AS x FROM db),
lo AS (SELECT series_id, frame, bin, CASE WHEN x >= max(x) OVER (PARTITION BY series_id, frame) - 30 THEN x ELSE 0 END AS x FROM gl),
nb AS (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS c FROM lo WINDOW o AS (PARTITION BY series_id, frame ORDER BY bin)),
pk AS (SELECT series_id, frame, 69 + 12 * log2((bin + 0.5 * (a - c) / (a - 2 * x + c)) * 250.0 / 440) AS midi, x - 0.125 * pow(a - c, 2) / (a - 2 * x + c) AS h FROM nb WHERE x > a AND x > c),
pp AS (SELECT series_id, frame, trunc(midi)::INT AS p, sum(pow(10, (h - 80) / 20)) AS v FROM pk GROUP BY 1, 2, 3),
wh AS (SELECT series_id, frame, p, floor(max(p) OVER (PARTITION BY series_id) / 12) * 12 AS e, greatest(v - sum(v) OVER (PARTITION BY series_id, frame ORDER BY p RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 0) AS v FROM pp),
hk AS (SELECT o, pow(2, o / 12.0) AS f, round(pow(2, o / 12.0)) AS n FROM range(-48, 49) AS r(o)),
hw AS (SELECT o, pow(cos(abs(f - n) / (ln(2) / 18) * pi() / 2), 2) * pow(0.6, n - 1) AS w FROM hk WHERE n > 0 AND abs(f - n) < ln(2) / 18),
hp AS (SELECT series_id, frame, p + o AS q, e, v * w / (SELECT sum(w) FROM hw) AS v FROM wh, hw),
hc AS (SELECT series_id, frame, c AS pitch, coalesce(sum(CASE WHEN q >= 0 AND q < e AND q % 12 = c THEN v END), 0) AS v FROM hp, range(12) AS r(c) GROUP BY 1, 2, 3)"""


@query("x10_harmonic_profile", f"WITH {SERIES}, {HARMONIC} SELECT series_id, frame, pitch, round(v, 6) + 0.0 AS v FROM hc")
def x10b(spark, d):
    rows = X.stft(X.frames(S.events_series(spark, d), 32, 4), 32).withColumn("mag", F.round("mag", 9))
    return X.harmonic_profile(rows, 32, 8000.0).select("series_id", F.col("frame").cast("long").alias("frame"), F.col("pitch").cast("long").alias("pitch"), r6(F.col("v")).alias("v"))


@query("x11_banded_onsets")
def x11(spark, d):
    return X.banded_onsets(S.events_series(spark, d), 8, 4, 24.0, (2.0, 6.0))


FUSED = f"""{FRAMES}, cx AS (SELECT series_id, frame, b AS bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 8)) * cos(2 * pi() * k * b / 8)) AS re, -sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 8)) * sin(2 * pi() * k * b / 8)) AS im FROM ff, range(5) AS q(b) GROUP BY 1, 2, 3),
m1 AS (SELECT *, sqrt(re * re + im * im) AS m FROM cx), m2 AS (SELECT *, max(m) OVER (PARTITION BY series_id, frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM m1),
m3 AS (SELECT *, lag(m, 1, 0.0) OVER o AS p, lag(wide, 1, 0.0) OVER o AS pw, coalesce(atan2(lag(im) OVER o, lag(re) OVER o), 0) AS f1, coalesce(atan2(lag(im, 2) OVER o, lag(re, 2) OVER o), 0) AS f2, lag(m, 2, 0.0) OVER o AS q FROM m2 WINDOW o AS (PARTITION BY series_id, bin ORDER BY frame)),
ks AS (SELECT series_id, frame AS t, sum(pow(greatest(m - p, 0), 2)) AS a, sum(greatest(m - p, 0)) AS b, sum(greatest(m - pw, 0)) AS c, sum(sqrt(pow(re - CASE WHEN q > 0 THEN p * cos(2 * f1 - f2) ELSE 0 END, 2) + pow(im - CASE WHEN q > 0 THEN p * sin(2 * f1 - f2) ELSE 0 END, 2))) AS d, sum(ln(1 + m / (p + 1e-6))) AS e FROM m3 GROUP BY 1, 2),
tt AS (SELECT series_id, t, {' + '.join(f'({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-8)' for c in 'abcde')} AS v FROM ks WINDOW w AS (PARTITION BY series_id)),
cl AS (SELECT series_id, t, greatest(least(v, q), z) AS v FROM tt JOIN (SELECT series_id, quantile_cont(v, 0.97) AS q, min(v) AS z FROM tt GROUP BY 1) USING (series_id))"""


@query("x12_fused_onsets", f"WITH {SERIES}, {FUSED} SELECT series_id, t, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 4) AS v FROM cl WINDOW w AS (PARTITION BY series_id)")
def x12(spark, d):
    rows = X.fused_onsets(X.stft_complex(X.frames(S.events_series(spark, d), 8, 4), 8))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), F.round("v", 4).alias("v"))


@query("x13_local_pulse")
def x13(spark, d):
    return X.local_pulse(S.events_series(spark, d).select("series_id", "t", "v"), 32, 24.0, 60.0, 180.0)


TEMPO_FRAMES = FRAMES.replace("frame * 4 + k - 4", "frame + k - 8").replace("n // 4", "n").replace("range(8) AS r(k)", "range(16) AS r(k)")


@query("x14_tempogram", f"WITH {SERIES}, {TEMPO_FRAMES}, wv AS (SELECT series_id, frame, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS v FROM ff), ac AS (SELECT a.series_id, a.frame, b.k - a.k AS lag, sum(a.v * b.v) AS r FROM wv a JOIN wv b ON a.series_id = b.series_id AND a.frame = b.frame AND b.k >= a.k GROUP BY 1, 2, 3) SELECT series_id, frame, lag, round(r / max(abs(r)) OVER (PARTITION BY series_id, frame), 5) AS r FROM ac")
def x14b(spark, d):
    rows = X.tempogram(S.events_series(spark, d).select("series_id", "t", "v"), 16)
    return rows.select("series_id", F.col("frame").cast("long").alias("frame"), F.col("lag").cast("long").alias("lag"), F.round("r", 5).alias("r"))


@query("x17_features")
def x17(spark, d):
    return X.wide_features(X.features(S.events_series(spark, d).select("series_id", "t", "v")))


@query("x18_segments")
def x18(spark, d):
    return X.music_information(S.events_series(spark, d).select("series_id", "t", "v"))["segments"]


@query("x19_mean_chroma")
def x19(spark, d):
    rows = chroma(spark, d)
    thinned = rows.where("frame % 2 = 0").withColumn("frame", (F.col("frame") / 2).cast("long"))
    grid = X.mean_chroma({"folded": rows, "cens": X.cens(rows), "thinned": thinned}, 40)
    near = D.nearest(grid.groupBy("series_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "v"))), lambda c: c["v"]).alias("x")), 5).select("series_id", "t", "u")
    return neighbour_median(grid, near)
