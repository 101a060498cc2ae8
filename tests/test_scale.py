"""What larger tables need of plans and tasks, on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import distances as D
from cadenza.operators import measures as M
from cadenza.operators import neighbours as N
from cadenza.operators import recurrences as T
from cadenza.operators import rows as R
from cadenza.operators import segments as C
from cadenza.operators import spectra as X
from cadenza.operators import windows as W
from cadenza.sources.tables import settled


def made_and_broadcast(df):
    """Lines of generated rows below a broadcast: Spark doesn't see that they grew."""
    df = df.select("*")
    lines, found, inside = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if "BroadcastExchange" in line and inside is None:
            inside = depth
        elif inside is not None and "Generate" in line:
            found.append(line)
    return found


def series(spark, lengths):
    return settled(spark.createDataFrame([(s, t, float(t * t % 7)) for s, n in lengths.items() for t in range(n)], "series_id long, t int, v double"))


def plain(n, width, hop):
    """Frame, place and time of each sample of all frames."""
    period = max(2 * (n - 1), 1)
    at = lambda p: min(p % period, period - p % period) if n > 1 else 0
    return sorted((f, k, at(f * hop + k - width // 2)) for f in range(max(n // hop, 1)) for k in range(width))


@pytest.mark.parametrize(("width", "hop"), [(8, 4), (31, 2), (5, 1), (3, 7)])
def test_frames_are_no_broadcast_grid(spark, width, hop):
    rows = series(spark, {1: 1, 2: 2, 3: 3, 4: 9, 5: 40}).withColumn("v", F.col("t").cast("double"))
    found = X.frames(rows, width, hop)
    assert not made_and_broadcast(found)
    got = {}
    for r in found.collect():
        got.setdefault(r["series_id"], []).append((r["frame"], r["k"], int(r["v"])))
    assert {s: sorted(v) for s, v in got.items()} == {s: plain(n, width, hop) for s, n in {1: 1, 2: 2, 3: 3, 4: 9, 5: 40}.items()}


def test_constant_q_broadcasts_no_frames(spark):
    rows = series(spark, {1: 90, 2: 35})
    for halve in (False, True):
        assert not made_and_broadcast(X.constant_q(rows, 8, 24.0, 0.75, 18, 6, halve))


@pytest.mark.parametrize("mode", ["circular", "reflect", "replicate", "zero"])
def test_ends_of_series_are_not_broadcast(spark, mode):
    rows = series(spark, {1: 1, 2: 4, 3: 50})
    found = W.convolve(rows, [(-9, 0.5), (0, 1.0), (6, 0.25)], mode)
    assert not made_and_broadcast(found) and not made_and_broadcast(W.moving_median(rows, 31))
    place = {"circular": lambda t, n: t % n, "replicate": lambda t, n: min(max(t, 0), n - 1), "zero": lambda t, n: t if 0 <= t < n else None}
    place["reflect"] = lambda t, n: min(t % max(2 * n - 2, 1), max(2 * n - 2, 1) - t % max(2 * n - 2, 1))
    value = lambda t, n: 0.0 if t is None else float(t * t % 7)
    for r in found.collect():
        n = {1: 1, 2: 4, 3: 50}[r["series_id"]]
        assert r["v"] == pytest.approx(sum(w * value(place[mode](r["t"] + o, n), n) for o, w in [(-9, 0.5), (0, 1.0), (6, 0.25)]))


def test_ends_of_series_with_frames_that_come_twice(spark):
    """A frame that comes twice is there twice beyond the end too."""
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 8.0), (None, 0, 1.0)], "series_id long, t int, v double")
    got = sorted((r["series_id"] or 0, r["t"], r["v"]) for r in W.extended(rows, 2, 1, lambda t, n: F.pmod(t, F.lit(3))).where("NOT _own").collect())
    assert got == [(0, -2, 0.0), (0, -1, 0.0), (0, 1, 0.0), (1, -2, 4.0), (1, -1, 8.0), (1, 4, 4.0)]


def test_spectra_of_medians_join_nothing_generated(spark):
    rows = X.stft(X.frames(series(spark, {1: 60, 2: 33}), 8, 4), 8)
    assert not made_and_broadcast(X.harmonic_percussive(rows))
    segments = settled(spark.createDataFrame([(1, 2, t, t % 2) for t in range(5)], "series_id long, k int, t long, label int"))
    spread = C.stretched(segments, settled(spark.createDataFrame([(1, 12), (2, 3)], "series_id long, n long")))
    assert not made_and_broadcast(spread) and [(r["t"], r["label"]) for r in spread.orderBy("t").collect()] == [(f, f * 5 // 12 % 2) for f in range(12)]


@pytest.mark.parametrize("direct", [0, 40, 256])
def test_neighbours_by_cells_and_at_once(spark, monkeypatch, direct):
    """Ties, copies, small numbers far from zero; series with and without cells; blocks of few points."""
    monkeypatch.setattr(N, "PART", 16)
    monkeypatch.setattr(N, "DIRECT", direct)
    draw = np.random.default_rng(4)
    points = [(s, u, np.round(1000 + draw.normal(size=2), 1 + s % 3)) for s, n in {1: 90, 2: 30, 3: 1, 4: 70}.items() for u in range(n)] + [(5, u, np.zeros(2)) for u in range(50)]
    queries = [(s, u, y, 1 + u % 9) for s, u, y in points if u % 2 == 0]
    rows = spark.createDataFrame([(s, t, x.tolist(), k) for s, t, x, k in queries], "series_id long, t long, x array<double>, k int")
    held = spark.createDataFrame([(s, u, y.tolist()) for s, u, y in points], "series_id long, u long, y array<double>")
    key = F.struct("series_id", F.lit("a").alias("name")).alias("series_id")
    got = {}
    for r in N.k_nearest(rows.select(key, "t", "x", "k"), held.select(key, "u", "y"), most=8).collect():
        got.setdefault((r["series_id"]["series_id"], r["t"]), []).append((r["rank"], r["u"], r["d"]))
    for s, t, x, k in queries:
        far = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 9), u) for p, u, y in points if p == s)[:k]
        assert [(u, d) for _, u, d in sorted(got[s, t])] == [(u, d) for d, u in far]


def test_queries_go_to_blocks_not_to_cells(spark, monkeypatch):
    """Without structure a query meets all cells: its vector is sent once a block, not once a cell."""
    monkeypatch.setattr(N, "DIRECT", 0)
    draw = np.random.default_rng(5)
    points = [(1, u, draw.normal(size=24).tolist()) for u in range(600)]
    rows = spark.createDataFrame([(s, t, x, 3) for s, t, x in points], "series_id long, t long, x array<double>, k int")
    cells = N.Cells(spark.createDataFrame(points, "series_id long, u long, y array<double>"))
    assert cells.pivots.count() > 40
    wanted = cells.within(rows.withColumn("reach", F.lit(100.0))).union(cells.first(rows))
    assert wanted.count() <= 2 * len(points) and {r["n"] for r in wanted.groupBy("t").agg(F.sum("n").alias("n")).collect()} == {600}


def test_diagonals_are_not_laid_out(spark, monkeypatch):
    """Medians along diagonals come from the links near a cell: no cell without one is made."""
    monkeypatch.setattr(C, "TOGETHER", 50)
    draw = np.random.default_rng(6)
    sizes, rows, want = {1: 1, 2: 3, 3: 12, 4: 40}, [], {}
    for s, n in sizes.items():
        full = np.where(draw.random((n, n)) < 0.7, draw.random((n, n)), 0.0)
        rows += [(s, i, j, float(full[i, j])) for i, j in zip(*np.nonzero(full))]
        for lag in range(1 - n, n):
            at = lambda j: float(full[j + lag, j]) if 0 <= j + lag < n else 0.0  # noqa: B023, E731
            for j in range(n):
                period = max(2 * n - 2, 1)
                mid = sorted(at(min((j + o) % period, period - (j + o) % period)) for o in range(-3, 4))[3]
                if mid > 0 and 0 <= j + lag < n:
                    want[s, j + lag, j] = mid
    found = C.timelag_median(spark.createDataFrame([(int(s), int(i), int(j), w) for s, i, j, w in rows], "series_id long, i long, j long, w double"), spark.createDataFrame(list(sizes.items()), "series_id long, n long"))
    assert {(r["series_id"], r["i"], r["j"]): r["w"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_in_blocks(spark, monkeypatch):
    """Every operator over all pairs of a series, cut into blocks of few rows, against plain loops; no plan pairs rows by a join."""
    monkeypatch.setattr(N, "SIDE", 7)
    draw = np.random.default_rng(8)
    x = {s: np.round(draw.normal(size=(n, 3)), 1) for s, n in {1: 30, 2: 12}.items()}
    rows = spark.createDataFrame([(s, t, t % 2, v.tolist()) for s, vs in x.items() for t, v in enumerate(vs)], "series_id long, t long, side int, x array<double>")
    gap = {s: np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) for s, v in x.items()}
    plain = lambda df: df._jdf.queryExecution().executedPlan().toString()

    found = C.distances(rows)
    got = {(r["series_id"], r["i"], r["j"]): r["d"] for r in found.collect()}
    assert "FlatMapCoGroupsInPandas" in plain(found) and len(got) == 30 * 29 + 12 * 11
    assert all(d == pytest.approx(np.sqrt(gap[s][i, j] ** 2 + 1e-8), abs=2e-9) for (s, i, j), d in got.items())

    pairs = N.nearest_pairs(rows.select("series_id", "t", "x"), rows.select("series_id", F.col("t").alias("u"), F.col("x").alias("y")), ("t", "u"), 3).where("t < 12").collect()
    for t in range(12):
        near = sorted((round(float(gap[s][t, u]), 9), u) for s in x for u in range(len(x[s])) if u != t)[:3]
        assert sorted((r["d"], r["u"]) for r in pairs if r["t"] == t)[:3] == near

    found = D.info_nce(rows.select("series_id", "t", "x", F.reverse("x").alias("y")), 0.5)
    for r in found.collect():
        s = x[r["series_id"]] @ x[r["series_id"]][:, ::-1].T / 0.5
        assert r["loss"] == pytest.approx(float((np.log(np.exp(s).sum(axis=1)) - np.diag(s)).mean()))

    for r in D.sample_quality(rows, "side", 2).collect():
        d, side = np.round(gap[r["series_id"]], 9), np.arange(len(x[r["series_id"]])) % 2
        radius = np.array([sorted(d[i, j] for j in range(len(d)) if j != i and side[j] == side[i])[1] for i in range(len(d))])
        held = (d <= radius[:, None]) & (side[:, None] != side)  # the ball of the row holds the column
        want = [held[side == 0][:, side == 1].any(axis=0).mean(), held[side == 1][:, side == 0].any(axis=0).mean(), held[side == 0][:, side == 1].sum(axis=0).mean() / 2, held[side == 0].any(axis=1).mean()]
        assert [r[c] for c in ("precision", "recall", "density", "coverage")] == pytest.approx(want)

    long = rows.select("series_id", "t", F.posexplode("x").alias("ch", "v"))
    scaled, weight = M.scaled_autocorrelation(long), {r["series_id"]: r["weight"] for r in M.autocorrelation_weight(long).collect()}
    got = {(r["series_id"], r["i"], r["j"]): r["a"] for r in scaled.collect()}
    assert "FlatMapCoGroupsInPandas" in plain(scaled) and len(got) == 900 + 144
    for s, v in x.items():
        unit = (v - v.min(axis=0)) / (v.max(axis=0) - v.min(axis=0))
        a = unit @ unit.T
        a = (a - a.min()) / (a.max() - a.min())
        assert all(got[s, i, j] == pytest.approx(a[i, j], abs=1e-9) for i in range(len(a)) for j in range(len(a)))
        z = (v - v.mean(axis=0)) / v.std(axis=0, ddof=1)
        assert weight[s] == pytest.approx(((z @ z.T).max() - (z @ z.T).min()) / ((z @ z.T).mean() - (z @ z.T).min()))


def test_palettes_are_met_whole(spark):
    """Unknown weights and vectors, weights that come twice; with a full palette and with one that lacks a number, which is joined."""
    weights = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 2.0), (1, 0, 1, 1.0), (1, 1, 1, None), (1, 2, 9, 1.0), (2, 0, 0, None), (2, 0, 1, -1.0)], "series_id long, t int, p long, w double")
    want = {(1, 0, d): 0.5 * (d + 1) + 3.0 * (d + 2) for d in (3, 5)} | {(1, 1, d): None for d in (3, 5)} | {(2, 0, d): -(d + 2.0) for d in (3, 5)}
    numbers = [(p, d, float(d + 1 + p)) for p in (0, 1) for d in (3, 5)]
    whole = R.mix(weights, spark.createDataFrame(numbers, "p long, d long, v double"))
    assert {(r["series_id"], r["t"], r["d"]): r["v"] for r in whole.collect()} == want
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    part = R.mix(weights, spark.createDataFrame(numbers[:-1], "p long, d long, v double"))
    assert {(r["series_id"], r["t"], r["d"]): r["v"] for r in part.collect()} == {(1, 0, 3): want[1, 0, 3], (1, 0, 5): 3.0, (1, 1, 3): None, (2, 0, 3): -5.0, (2, 0, 5): None}


def test_medians_along_diagonals_join_nothing(spark):
    draw, sizes = np.random.default_rng(9), {1: 1, 2: 3, 3: 11}
    full = {s: draw.random((n, n)) for s, n in sizes.items()}
    cells = settled(spark.createDataFrame([(s, i, j, float(m[i, j])) for s, m in full.items() for i in range(len(m)) for j in range(len(m))], "series_id long, i int, j int, v double"))
    found = W.diagonal_median(cells, 7)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        line = np.diag(full[r["series_id"]], r["j"] - r["i"])
        n, at = len(line), min(r["i"], r["j"])
        period = max(2 * n - 2, 1)
        assert r["v"] == sorted(line[min((at + o) % period, period - (at + o) % period)] for o in range(-3, 4))[3]


def test_many_short_series_go_through_a_recurrence_at_once(spark):
    """Series of several chunks, of one and of one frame; no group of its own for each."""
    rows = series(spark, {1: 1, 2: 10, 3: 23})
    a, b = np.array([[0.5, 0.25], [1.0, 0.0]]), np.array([1.0, 0.5])
    found = T.linear_state(rows, a, b, chunk=4)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["series_id"], r["t"]): r["state"] for r in found.collect()}
    for s, n in {1: 1, 2: 10, 3: 23}.items():
        state = np.zeros(2)
        for t in range(n):
            state = a @ state + b * float(t * t % 7)
            assert got[s, t] == pytest.approx(list(state))
