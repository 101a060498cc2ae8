"""Operators without a SQL form against numpy or hand-made values."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from cadenza.operators import distances as D
from cadenza.operators import groups as G
from cadenza.operators import measures as M
from cadenza.operators import pictures as V
from cadenza.operators import recurrences as R
from cadenza.operators import segments as C
from cadenza.operators.eigen import leading
from cadenza.operators import spectra as X


def long_rows(spark, values, extra=""):
    return spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(values)], "series_id long, t int, v double")


def test_linear_state(spark):
    rows = R.linear_state(long_rows(spark, [1, 1, 1]), np.array([[1, 1], [1, 0]]), np.array([1, 1])).orderBy("t").collect()
    assert [list(r["state"]) for r in rows] == [[1, 1], [3, 2], [6, 4]]


def test_low_pass_keeps_a_constant(spark):
    rows = R.biquad(long_rows(spark, [2.0] * 200), "low", 2.0, 24.0).orderBy("t").collect()
    assert abs(rows[-1]["v"] - 2.0) < 1e-6
    rows = R.biquad(long_rows(spark, [2.0] * 200), "high", 2.0, 24.0).orderBy("t").collect()
    assert abs(rows[-1]["v"]) < 1e-6


def test_beats_of_a_pulse_train(spark):
    found = [r["t"] for r in R.beats(long_rows(spark, [1.0 if t % 8 == 3 else 0.0 for t in range(80)]), 8).orderBy("t").collect()]
    assert set(found) <= set(range(3, 80, 8)) and len(found) >= 9


def test_spline_goes_through_its_points():
    w = np.zeros((12, 4))
    for f, p, x in V.spline_weights(4, 12):
        w[f, p] = x
    assert np.allclose(w[::3], np.eye(4)) and np.allclose(w.sum(axis=1), 1)


def channels(spark, x, side=None):
    rows = [(1, t, c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "series_id long, t int, ch int, v double")


def left_vectors(x):
    """Left singular vectors of a centred matrix, signs fixed by the right ones, and singular values."""
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    keep = s > 1e-9 * s[0]
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (u * sign)[:, keep], s[keep], (vt * sign[:, None])[keep]


def test_measures_fall_with_noise(spark):
    draw = np.random.default_rng(0)
    x, noise = draw.normal(size=(80, 4)), draw.normal(size=(80, 4))
    found = []
    for share in (1.0, 0.5, 0.0):
        y = share * x + (1 - share) * noise
        a, b = M.moment_measures(channels(spark, x), channels(spark, y)).collect()[0], M.small_matrix_measures(channels(spark, x), channels(spark, y)).collect()[0]
        xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
        assert a["rv"] == pytest.approx(np.trace(xc @ xc.T @ yc @ yc.T) / np.sqrt(np.trace((xc @ xc.T) @ (xc @ xc.T)) * np.trace((yc @ yc.T) @ (yc @ yc.T))))
        assert b["procrustes"] == pytest.approx(np.linalg.svd(xc.T @ yc, compute_uv=False).sum() / (np.linalg.norm(xc) * np.linalg.norm(yc)))
        found.append((a["rv"], a["rv2_standard"], a["autocorrelation"], a["rv_less_expected"], b["procrustes"], b["smi"], b["smi_full"], b["svcca"], b["pwcca"], b["coxhead_trace"]))
    assert all(found[0][i] >= found[1][i] > found[2][i] for i in range(10)) and found[0][4] == pytest.approx(1)


def test_subspace_measures_by_svd(spark):
    draw = np.random.default_rng(7)
    x, y = draw.normal(size=(90, 5)), draw.normal(size=(90, 5))
    y[:, :3] += 1.5 * x[:, :3]
    r = M.small_matrix_measures(channels(spark, x), channels(spark, y)).collect()[0]
    (ux, sx, vx), (uy, sy, vy) = left_vectors(x), left_vectors(y)
    t = ux.T @ uy
    smi = np.array([[min(1.0, (t[: i + 1, : j + 1] ** 2).sum() / (min(i, j) + 1)) for j in range(5)] for i in range(5)])
    assert r["smi"] == pytest.approx(np.sort(smi.ravel())[12])
    pro = np.array([[np.linalg.svd(t[: i + 1, : j + 1], compute_uv=False).mean() ** 2 for j in range(5)] for i in range(5)])
    assert r["smi_procrustes"] == pytest.approx(np.sort(pro.ravel())[12])
    size = np.linalg.norm(x - x.mean(axis=0)) * np.linalg.norm(y - y.mean(axis=0))
    assert r["r2"] == pytest.approx(np.trace((ux * sx) @ (uy * sy).T) / size)
    assert r["r4"] == pytest.approx(np.trace(ux @ uy.T) / 5)
    assert r["r3"] == pytest.approx(np.trace(ux @ vx @ (uy @ vy).T) / 5)
    assert r["rg"] == pytest.approx((t**2).sum() / 5)
    p, rho, _ = np.linalg.svd(t)
    assert r["smi_full"] == pytest.approx((rho**2).mean()) and r["svcca"] == pytest.approx(rho.mean())
    weight = np.abs((ux @ p).T @ (x - x.mean(axis=0))).sum(axis=1)
    assert r["pwcca"] == pytest.approx((weight * rho).sum() / weight.sum())
    assert r["coxhead"] == pytest.approx(1 - 5 / (1 / (1 - rho)).sum())
    cx, cy, cxy = np.cov(x.T), np.cov(y.T), np.cov(x.T, y.T)[:5, 5:]
    explained = cxy.T @ np.linalg.inv(cx) @ cxy
    rest = np.linalg.inv(cy - explained)
    assert r["coxhead_trace"] == pytest.approx(np.trace(rest @ explained) / np.trace(rest @ cy))


def test_significance(spark):
    draw = np.random.default_rng(3)
    x, other = draw.normal(size=(60, 3)), draw.normal(size=(60, 3))
    near = M.smi_significance(channels(spark, x), channels(spark, x + 0.1 * other), 20).collect()[0]
    assert near["p"] == 0.0 and near["smi"] > 0.9
    assert near["smi"] == pytest.approx(M.small_matrix_measures(channels(spark, x), channels(spark, x + 0.1 * other)).collect()[0]["smi"])
    assert M.smi_significance(channels(spark, x), channels(spark, other), 20).collect()[0]["p"] > 0.0


def test_conditional_dependence(spark):
    """Against the same greedy search in plain loops."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 3))
    y = np.sin(x[:, 1]) + 0.05 * x[:, 2]
    rows = spark.createDataFrame([(1, t, x[t].tolist(), float(y[t])) for t in range(60)], "series_id long, t int, x array<double>, y double")
    n, r, low = 60, np.array([(y <= v).sum() for v in y]), np.array([(y >= v).sum() for v in y])

    def score(use):
        z = x[:, use]
        d = ((z[:, None] - z[None]) ** 2).sum(axis=2) + np.diag([np.inf] * n)
        return (np.minimum(r, r[d.argmin(axis=1)]) - low**2 / n).sum() / (low * (n - low) / n).sum()

    have, want = [], []
    for _ in range(3):
        best = max((k for k in range(3) if k not in have), key=lambda k: score([*have, k]))
        have.append(best)
        want.append((best, pytest.approx(score(have), abs=1e-8)))
    found = [(q["feature"], q["score"]) for q in M.conditional_dependence(rows, 3).orderBy("step").collect()]
    assert found == want and found[0][0] == 1


def test_gaussian_distances(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(60, 3)), draw.normal(size=(70, 3)) * [1.0, 2.0, 0.5] + 1e4
    both = lambda p, q: channels(spark, p).selectExpr("*", "0 as side").unionByName(channels(spark, q).selectExpr("*", "1 as side"))
    r = D.gaussian_distances(both(x, x + 1), "side").collect()[0]
    assert r["frechet"] == pytest.approx(3) and r["bures"] == pytest.approx(0, abs=1e-4) and r["correlation"] == pytest.approx(0, abs=1e-9) and r["riemann"] == pytest.approx(0, abs=1e-6)
    r, a, b = D.gaussian_distances(both(x, y), "side").collect()[0], np.cov(x.T), np.cov(y.T)
    w = np.log(np.linalg.eigvals(np.linalg.inv(a) @ b).real)
    assert r["definite"] and r["riemann"] == pytest.approx(np.sqrt((w**2).sum())) and r["condition"] == pytest.approx(w.max() - w.min())
    assert r["divergence"] == pytest.approx(0.5 * (np.trace(np.linalg.inv(b) @ a) - 3 + np.log(np.linalg.det(b) / np.linalg.det(a))))
    flat = D.gaussian_distances(both(np.hstack([x, x[:, :1]]), np.hstack([x, x[:, :1]])), "side").collect()[0]
    assert not flat["definite"] or flat["kl"] is not None


def test_warping_against_a_full_table():
    draw = np.random.default_rng(2)
    for n, m, band in ((5, 5, 9), (30, 30, 4), (12, 15, 6), (1, 3, 9)):
        x, y = draw.normal(size=n), draw.normal(size=m)
        table = np.full((n + 1, m + 1), np.inf)
        table[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                if abs(i - j) <= band:
                    table[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
        assert D.warped(x, y, band) == pytest.approx(np.sqrt(table[n, m]))


def test_recurrence_in_chunks(spark):
    draw = np.random.default_rng(4)
    v, (a, b) = draw.normal(size=57), R.bilinear(*R.legendre_memory(3), 0.1)
    want, c = [], np.zeros(3)
    for x in v:
        c = a @ c + b * x
        want.append(c)
    found = [r["state"] for r in R.linear_state(long_rows(spark, v), a, b, chunk=10).orderBy("t").collect()]
    assert np.allclose(found, want)


def test_legendre_memory_of_order_three():
    a, b = R.legendre_memory(3)
    assert a.tolist() == [[-1, -1, -1], [3, -3, -3], [-5, 5, -5]] and b.tolist() == [1, -3, 5]
    assert np.linalg.matrix_rank(R.bilinear(a, b, 0.05)[0]) == 3


def vectors(spark, x):
    return spark.createDataFrame([(1, t, row.tolist()) for t, row in enumerate(x)], "series_id long, t long, x array<double>")


def test_clusters(spark):
    draw = np.random.default_rng(6)
    x = np.vstack([draw.normal(size=(12, 4)) * 0.05 + c for c in (np.eye(4)[0], np.eye(4)[1], np.eye(4)[2])])
    rows = vectors(spark, x)
    assert np.allclose([r["x"] for r in C.seeds(rows, 1).collect()], x[:1])
    centres = [x[0]]
    for k in (1, 2):
        d = np.round(((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1), 12)
        share = d.cumsum() / (d.sum() + 1e-8)
        centres.append(x[int(np.argmax(share > np.random.RandomState(42 + k).rand()))])
    assert np.allclose([r["x"] for r in C.seeds(rows, 3).orderBy("c").collect()], centres)
    unit, mu = x / np.linalg.norm(x, axis=1, keepdims=True), None
    mu = np.array([r["x"] for r in C.seeds(vectors(spark, unit), 3).orderBy("c").collect()])
    soft = lambda: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(5 * unit @ mu.T))
    for _ in range(3):
        r = soft()
        mu = (r.T @ unit) / r.sum(axis=0)[:, None]
    assert np.allclose([r["shares"] for r in C.soft_k_means(rows, 3, 3).orderBy("t").collect()], soft())
    labels = [r["cluster"] for r in C.k_means(rows, 3).orderBy("t").collect()]
    assert len(set(labels[:12])) == len(set(labels[12:24])) == len(set(labels[24:])) == 1 and len(set(labels)) == 3
    whole, low = (np.array([r["components"] for r in C.principal(rows, 2, lowest=k).orderBy("t").collect()]).var(axis=0) for k in (False, True))
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0)))
    assert np.allclose(whole, w[::-1][:2]) and np.allclose(low, w[:2])


def test_medoids_and_linkage(spark):
    place = {"a": 0.0, "b": 0.4, "c": 1.0, "d": 8.0, "e": 8.5, "f": 20.0}
    pairs = spark.createDataFrame([(p, q, abs(place[p] - place[q])) for p in place for q in place if p != q], "a string, b string, d double")
    items = spark.createDataFrame([(p,) for p in place], "item string")
    found = {r["item"]: r["medoid"] for r in C.medoids(pairs, items, 3).collect()}
    assert found == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "d", "f": "f"}
    for k, want in ((3, "aaaddf"), (2, "aaaaaf"), (1, "aaaaaa"), (6, "abcdef"), (5, "aacdef")):
        found = {r["item"]: r["cluster"] for r in C.linkage(pairs.where("a < b"), items, k).collect()}
        assert "".join(found[p] for p in place) == want


def test_assignment_against_all_permutations():
    from itertools import permutations

    draw = np.random.default_rng(8)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            gains = draw.integers(0, 30, (n, n)).astype(float)
            best = max(sum(gains[i, p[i]] for i in range(n)) for p in permutations(range(n)))
            assert gains[np.arange(n), C.assigned(gains)].sum() >= best - 1


def test_relabelled(spark):
    rows = spark.createDataFrame([(1, t, t % 3, (t + 1) % 3 if t else 0) for t in range(30)], "series_id long, t int, target int, predicted int")
    found = C.relabelled(rows, 3).orderBy("target").collect()
    assert [r["predicted"] for r in found] == [1, 2, 0] and found[0]["error"] == pytest.approx(2 / 90)


def test_segments_of_blocks(spark):
    links = [(1, i, j, 1.0) for b in range(3) for i in range(6 * b, 6 * b + 6) for j in range(6 * b, 6 * b + 6) if i != j] + [(1, 5, 6, 0.01), (1, 11, 12, 0.01), (1, 6, 5, 0.01), (1, 12, 11, 0.01)]
    rows = C.laplacian_segmentations(spark.createDataFrame(links, "series_id long, i long, j long, w double"), [1, 3]).collect()
    label = [r["label"] for r in sorted((r for r in rows if r["k"] == 3), key=lambda r: r["t"])]
    assert label == [label[0]] * 6 + [label[6]] * 6 + [label[12]] * 6 and len(set(label)) == 3
    assert {r["label"] for r in rows if r["k"] == 1} == {0}


def lower_median(x):
    return np.sort(x, axis=0)[(len(x) - 1) // 2]


def published_links(x, width=3, k=7):
    """The weighted links of a beat-synchronous matrix: recurrence, median along lags, balanced with the path."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2) + 1e-8), 9)
    near = np.zeros((n, n), bool)
    for i in range(n):
        others = [j for j in range(n) if j != i and abs(i - j) >= width]
        for j in sorted(others, key=lambda j: (d[i, j], j))[: 2 * int(np.ceil(np.sqrt(max(n - 2 * width + 1, 1))))]:
            near[i, j] = True
    near &= near.T
    widest = np.sort([d[i][near[i]].max() for i in range(n) if near[i].any()])
    r = np.where(near, np.exp(-d / widest[(len(widest) - 1) // 2]), 0.0)
    out = np.zeros((n, n))
    for lag in range(-n + 1, n):
        line = np.array([r[j + lag, j] if 0 <= j + lag < n else 0.0 for j in range(n)])
        if line.any():
            place = (n - 1) - np.abs((n - 1) - np.abs(np.arange(n)[:, None] + np.arange(-(k // 2), k // 2 + 1)))
            for j, v in enumerate(lower_median(line[place].T)):
                if 0 <= j + lag < n:
                    out[j + lag, j] = v
    q = d[np.arange(n - 1), np.arange(1, n)] ** 2
    path = np.exp(-q / lower_median(q))
    p = np.diag(path, 1) + np.diag(path, -1)
    both = p.sum(axis=1) + out.sum(axis=1)
    m = (p.sum(axis=1) @ both) / (both @ both)
    a = m * out + (1 - m) * p
    return (a + a.T) / 2


def published_labels(x, k, rounds):
    """Soft k-means with its seeds."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mu = x[[0]]
    for c in range(1, k):
        gap = np.round(((x[:, None] - mu[None]) ** 2).sum(axis=2).min(axis=1), 12)
        share = np.cumsum(gap) / (gap.sum() + 1e-8)
        passed = np.flatnonzero(share > np.random.RandomState(42 + c).rand())
        mu = np.vstack([mu, x[passed[0] if len(passed) else len(x) - 1]])
    for _ in range(rounds + 1):
        e = np.exp(5 * x @ mu.T)
        r = e / e.sum(axis=1, keepdims=True)
        mu = (r.T @ x) / r.sum(axis=0)[:, None]
    return r.argmax(axis=1)


def test_segmentation_follows_the_published_steps(spark):
    """Links, eigenvectors and labels of 20 series against dense numpy, at beats."""
    draw, plain, rows, marks, ks = np.random.default_rng(21), {}, [], [], [2, 4, 6]
    for s in range(20):
        at, x = [], []
        for beat in range(int(draw.integers(16, 30))):
            some = draw.normal(size=(int(draw.integers(1, 6)), 5)) + 4 * np.eye(5)[beat // 6 % 4]
            if beat:
                at.append(len(x))
            x += some.tolist()
        x = np.array(x)
        rows += [(s, t, v.tolist()) for t, v in enumerate(x)]
        marks += [(s, t) for t in at]
        plain[s] = np.array([lower_median(x[a:b]) for a, b in zip([0, *at], [*at, len(x)])])
    sync = C.settled(C.beat_synchronous(spark.createDataFrame(rows, "series_id long, t int, x array<double>"), spark.createDataFrame(marks, "series_id long, t int")))
    found = {(r["series_id"], r["t"]): r["x"] for r in sync.collect()}
    assert all(found[s, t] == pytest.approx(v) for s, x in plain.items() for t, v in enumerate(x.tolist())) and len(found) == sum(map(len, plain.values()))
    links = C.settled(C.segment_links(sync))
    dense = {s: np.zeros((len(x), len(x))) for s, x in plain.items()}
    for r in links.collect():
        dense[r["series_id"]][r["i"], r["j"]] = r["w"]
    for s, x in plain.items():
        assert np.allclose(dense[s], published_links(x), atol=1e-12)
    points, same, total = {}, 0, 0
    for r in C.spectral_embedding(links, ks).collect():
        points.setdefault((r["series_id"], r["k"]), {})[r["t"]] = r["x"]
    labels = {}
    for r in C.laplacian_segmentations(links, ks, 5).collect():
        labels.setdefault((r["series_id"], r["k"]), {})[r["t"]] = r["label"]
    for s, a in dense.items():
        n, scale = len(a), 1 / np.sqrt(a.sum(axis=1))
        value, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * a * scale)
        place = (n - 1) - np.abs((n - 1) - np.abs(np.arange(n)[:, None] + np.arange(-4, 5)))
        for k in ks:
            own = np.array([points[s, k][t] for t in range(n)])
            # a median of an odd number of values goes with the sign of its vector
            smooth = np.sort(vectors[place][:, :, :k], axis=1)[:, 4]
            smooth /= np.linalg.norm(smooth, axis=1, keepdims=True)
            assert np.allclose(np.abs(own), np.abs(smooth), atol=1e-5)
            mine, want = np.array([labels[s, k][t] for t in range(n)]), published_labels(smooth, k, 5)
            same, total = same + (mine == want).sum(), total + n
    assert same == total


def test_eigenvectors_of_a_long_series(spark):
    """The distributed products give what a task gives."""
    draw, n = np.random.default_rng(3), 60
    w = np.triu(draw.uniform(size=(n, n)) * (draw.uniform(size=(n, n)) < 0.15), 1) + np.diag(draw.uniform(0.5, 1, n - 1), 1)
    w = w + w.T
    scale = 1 / np.sqrt(w.sum(axis=1))
    m = scale[:, None] * w * scale
    links = spark.createDataFrame([(7, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(8, 0, 1, 1.0), (8, 1, 0, 1.0)], "series_id long, i long, j long, s double")
    rows = leading(links, 3, within=10, tolerance=1e-6).collect()
    mine = np.array([r["x"] for r in sorted((r for r in rows if r["series_id"] == 7), key=lambda r: r["i"])])
    want = np.linalg.eigh(m)[1][:, ::-1][:, :3]
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-4)
    assert all(np.abs(r["x"]) == pytest.approx([0.5**0.5, 0.5**0.5, 0], abs=1e-3) for r in rows if r["series_id"] == 8)


def test_smooth_quantiser(spark):
    x, y, m = X.quantiser()
    assert len(x) == len(y) == len(m) and (np.diff(x) > 0).all() and m[0] == m[-1] == 0
    values = [-0.05, 0.0, 0.03, 0.049, 0.07, 0.15, 0.3, 0.45, 0.7, 1.0]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.quantised_smoothly(F.col("v")).alias("q"), X.quantised(F.col("v")).alias("e")).collect()
    assert all(abs(r["q"] - r["e"]) < 0.02 for r in found if r["v"] in (0.03, 0.07, 0.15, 0.3, 0.45))
    assert all(-0.02 <= r["q"] <= 1.02 for r in found)
    # the spline goes through its knots, and meets itself in between with two continuous derivatives
    h = np.diff(x)
    slope_left = (y[1:] - y[:-1]) / h + h * (m[:-1] + 2 * m[1:]) / 6
    slope_right = (y[1:] - y[:-1]) / h - h * (2 * m[:-1] + m[1:]) / 6
    assert np.allclose(slope_left[:-1], slope_right[1:])


def test_local_pulse(spark):
    rows = long_rows(spark, [1.0 if t % 12 == 5 else 0.0 for t in range(144)])
    found = [r["v"] for r in X.local_pulse(rows, 48, 24.0, 60.0, 180.0).orderBy("t").collect()]
    peaks = [t for t in range(40, 100) if found[t] > found[t - 1] and found[t] > found[t + 1] and found[t] > 0.3]
    assert peaks and all(t % 12 == 5 for t in peaks) and min(found) == 0 and max(found) == pytest.approx(1, abs=1e-6)


def test_banded_onsets(spark):
    t = np.arange(240)
    fast, slow = np.sin(2 * np.pi * t * 9 / 24) * (t > 120), np.sin(2 * np.pi * t * 0.5 / 24) * (t > 60)
    found = {}
    for r in X.banded_onsets(long_rows(spark, fast + slow), 16, 4, 24.0, (2.0, 6.0)).collect():
        found.setdefault(r["band"], {})[r["t"]] = r["v"]
    top = {b: max(v, key=v.get) for b, v in found.items()}
    assert set(found) == {"full", "low", "mid", "high"} and 28 <= top["high"] <= 35 and 13 <= top["low"] <= 22


def test_features(spark):
    draw = np.random.default_rng(9)
    rows = long_rows(spark, np.sin(np.arange(300) / 3) + draw.normal(size=300))
    long = X.features(rows).collect()
    names = {}
    for r in long:
        names.setdefault(r["name"], set()).add(r["ch"])
    assert {n: len(names[n]) for n, _ in X.FEATURES} == dict(X.FEATURES) and sum(w for _, w in X.FEATURES) == 59
    assert len(X.wide_features(X.features(rows)).columns) == 61


def test_music_information(spark):
    """Every frame has a label of each feature and k; features are scaled."""
    found = X.music_information(long_rows(spark, np.sin(np.arange(160) / 2) * (1 + (np.arange(160) % 24 == 0))), (2, 4), names=("chroma", "rms"))
    segments, features = found["segments"].collect(), found["features"].collect()
    frames = {r["t"] for r in features}
    assert {(r["name"], r["k"]) for r in segments} == {(n, k) for n in ("chroma", "rms") for k in (2, 4)}
    for n in ("chroma", "rms"):
        for k in (2, 4):
            own = {r["t"]: r["label"] for r in segments if (r["name"], r["k"]) == (n, k)}
            assert own.keys() == frames and set(own.values()) <= set(range(k))
    assert found["tempo"].collect()[0]["bpm"] > 0 and min(r["v"] for r in features) >= 0 and max(r["v"] for r in features) <= 1


def test_stretched_segments(spark):
    segments = spark.createDataFrame([(1, 2, t, t % 2) for t in range(3)], "series_id long, k int, t long, label int")
    rows = C.stretched(segments, spark.createDataFrame([(1, 7)], "series_id long, n long")).orderBy("t").collect()
    assert [r["label"] for r in rows] == [0, 0, 0, 1, 1, 0, 0]


def test_sample_quality_of_equal_sets(spark):
    draw = np.random.default_rng(10)
    x = draw.normal(size=(40, 3))
    rows = [(1, s, 2 * t + s, (row + (100.0 if far and s else 0.0)).tolist()) for far in (0,) for s in (0, 1) for t, row in enumerate(x)]
    kind = "series_id long, side int, t int, x array<double>"
    r = D.sample_quality(spark.createDataFrame(rows, kind), "side", 3).collect()[0]
    assert r["precision"] == r["recall"] == r["coverage"] == 1
    rows = [(1, s, 2 * t + s, (row + 100.0 * s).tolist()) for s in (0, 1) for t, row in enumerate(x)]
    r = D.sample_quality(spark.createDataFrame(rows, kind), "side", 3).collect()[0]
    assert r["precision"] == r["recall"] == r["coverage"] == r["density"] == 0


def test_subseries(spark):
    rows = spark.createDataFrame([(s, t, 0.0) for s in range(30) for t in range(5 + s)], "series_id long, t int, v double")
    found = {}
    for r in D.subseries(rows, 16, 4).collect():
        found.setdefault(r["series_id"], []).append(r)
    for s, own in found.items():
        (anchor,), (positive,) = ([r for r in own if r["role"] == k] for k in ("anchor", "positive"))
        assert anchor["start"] <= positive["start"] and positive["start"] + positive["length"] <= anchor["start"] + anchor["length"] <= 5 + s
        negatives = [r for r in own if r["role"] == "negative"]
        assert len(negatives) == 4 and all(0 <= r["start"] and r["start"] + r["length"] <= 5 + r["source"] and r["length"] <= positive["length"] for r in negatives)
        assert sum(r["source"] != s for r in negatives) >= 3


def test_comparison_and_sensitivity(spark):
    t = np.arange(40)
    same = [("aligned", s, int(k), float(np.sin(k / 3 + s) / 2 + 0.5), float(np.sin(k / 3 + s) / 2 + 0.5)) for s in range(4) for k in t]
    draw = np.random.default_rng(11)
    other = [("misaligned", s, int(k), float(np.sin(k / 3 + s) / 2 + 0.5), float(draw.random())) for s in range(4) for k in t]
    rows = spark.createDataFrame(same + other, "corpus string, series_id long, t int, x double, y double")
    found = {r["corpus"]: r for r in D.comparison(rows, 3, 8, 32, 2.0).collect()}
    assert found["aligned"]["dtw_high"] == 0 < found["misaligned"]["dtw_low"] and found["aligned"]["information"] > found["misaligned"]["information"] and found["aligned"]["n"] == 4
    x = channels(spark, draw.normal(size=(50, 4)))
    table = {(r["block"], r["kind"]): r for r in D.sensitivity(x, x, {"one": (0, 2)}, ("double", "negate"), 3, 2).collect()}
    assert set(table) == {("one", "double"), ("one", "negate")} and table["one", "double"]["dof"] == 4 and table["one", "double"]["mean"] > 0


def test_bootstrap_interval(spark):
    rows = spark.createDataFrame([(1, i, float(i % 100)) for i in range(2000)], "g int, id long, v double")
    r = G.bootstrap_median(rows, ["g"], "id", "v", 60).collect()[0]
    assert r["low"] <= r["mid"] == 49.5 <= r["high"] and r["high"] - r["low"] < 15


def test_cross_fade(spark):
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    rows = vectors(spark, np.array([a] * 10 + [b] * 5))
    ends = spark.createDataFrame([(1, 10)], "series_id long, start long")
    found = {r["t"]: np.array(r["x"]) for r in V.cross_faded(rows, ends, 5).collect()}
    assert np.allclose(found[4], a) and np.allclose(found[5], a) and np.allclose(found[10], b) and np.allclose(found[9], b)
    p = 0.5
    assert np.allclose(found[7], (1 - p) * a + p * np.array([np.cos(np.pi / 4), np.sin(np.pi / 4)]))


def test_controls(spark):
    rows = long_rows(spark, np.zeros(400))
    rough, smooth = ({(r["d"], r["t"]): r["v"] for r in V.control(rows, 2, s, 3).collect()} for s in (0.2, 8.0))
    step = lambda x: np.mean([abs(x[0, t + 1] - x[0, t]) for t in range(399)])
    assert abs(np.mean(list(rough.values()))) < 0.2 and abs(np.std(list(rough.values())) - 1) < 0.2 and step(smooth) < step(rough) / 10


def test_dtw(spark):
    rows = spark.createDataFrame([(1, t, float(v), float(v)) for t, v in enumerate([1, 3, 2, 5])] + [(2, t, float(v), float(u)) for t, (v, u) in enumerate(zip([0, 1, 1, 2], [0, 0, 1, 2]))], "pair_id long, t int, x double, y double")
    assert {r["pair_id"]: r["dtw"] for r in D.dtw(rows, 3).collect()} == {1: 0.0, 2: 0.0}


def direct_constant_q(v, hop, rate, lowest, bins, per_octave):
    """Whole windows at the full rate."""
    out = np.zeros((max(len(v) // hop, 1), bins))
    for b in range(bins):
        f = lowest * 2 ** (b / per_octave)
        half = rate / f / (2 ** (1 / per_octave) - 1) / 2
        o = np.arange(-int(half), int(half) + 1)
        w = 0.5 + 0.5 * np.cos(np.pi * o / half)
        for frame in range(len(out)):
            m = (frame * hop + o) % (2 * len(v) - 2)
            out[frame, b] = abs((v[np.minimum(m, 2 * len(v) - 2 - m)] * w * np.exp(-2j * np.pi * f / rate * o)).sum()) / w.sum()
    return out


def cells(rows, bins):
    out = {(r["frame"], r["bin"]): r["mag"] for r in rows}
    n = 1 + max(k[0] for k in out)
    return np.array([[out[f, b] for b in range(bins)] for f in range(n)])


def test_constant_q_has_its_whole_q(spark):
    """A sine at each bin peaks there with half its height, in every octave, though the lower ones come at a quarter of the rate; both forms equal the direct sums."""
    rate, lowest, bins = 64.0, 1.0, 18
    t = np.arange(900)
    tones = {b: np.sin(2 * np.pi * lowest * 2 ** (b / 6) / rate * t) for b in range(0, bins, 2)}
    rows = spark.createDataFrame([(b, int(i), float(x)) for b, v in tones.items() for i, x in enumerate(v)], "series_id long, t int, v double")
    found = X.settled(X.constant_q(rows, 16, rate, lowest, bins, 6)).collect()
    for b, v in tones.items():
        mine = cells([r for r in found if r["series_id"] == b], bins)
        want = direct_constant_q(v, 16, rate, lowest, bins, 6)
        assert mine.shape == want.shape and np.abs(mine - want)[17:39].max() < 4e-3  # where no window reaches beyond the ends
        middle = mine[len(mine) // 3 : -len(mine) // 3].mean(axis=0)
        assert middle.argmax() == b and middle[b] == pytest.approx(0.5, abs=5e-3) and np.delete(middle, [x for x in range(b - 2, b + 3) if 0 <= x < bins]).max() < 0.02
    whole = cells([r for r in X.constant_q(rows.where("series_id = 4"), 16, rate, lowest, bins, 6, halve=False).collect()], bins)
    assert np.allclose(whole, direct_constant_q(tones[4], 16, rate, lowest, bins, 6), atol=1e-9)
    with pytest.raises(ValueError):
        X.constant_q_basis(65, rate, lowest, 6, 6)
    with pytest.raises(ValueError):
        X.constant_q(rows, 16, rate, lowest, 40, 6)


def sliced_cost(x, y, projections, seed=1):
    """Both monotone couplings of projected points, by all pairs."""
    lcg = lambda v: (v * 1103515245 + seed * 12345) % 2147483648
    out = []
    for k in range(projections):
        p, q = (sum((lcg(lcg(ch * 1009 + k) + 7919) / 2147483648 - 0.5) * m[:, ch] for ch in range(m.shape[1])) for m in (x, y))
        p, costs = np.sort(p), []
        for q_ in (np.sort(q), np.sort(q)[::-1]):
            costs.append((((p[:, None] - p) ** 2 - (q_[:, None] - q_) ** 2) ** 2).mean())
        out.append(min(costs))
    return np.mean(out)


def test_feature_distances_by_series_and_pooled(spark):
    draw = np.random.default_rng(12)
    sides = [{n: {s: draw.normal(size=(9 + s, w)) for s in (1, 2, 3)} for n, w in names.items()} for names in ({"a": 2, "b": 1}, {"c": 3})]
    tables = [spark.createDataFrame([(s, n, t, ch, float(v)) for n, own in side.items() for s, m in own.items() for t, row in enumerate(m) for ch, v in enumerate(row)], "series_id long, name string, t int, ch int, v double") for side in sides]
    single = {(r["series_id"], r["a"], r["b"]): r["sgw"] for r in D.feature_distances(*tables, 3).collect()}
    pooled = {(r["a"], r["b"]): r["sgw"] for r in D.pooled_distances(*tables, 3).collect()}
    assert len(single) == 6 and len(pooled) == 2
    for n, own in sides[0].items():
        for s in own:
            assert single[s, n, "c"] == pytest.approx(sliced_cost(own[s], sides[1]["c"][s], 3), abs=1e-9)
        both = [np.concatenate([m[s] for s in (1, 2, 3)]) for m in (own, sides[1]["c"])]
        both = [(m - m.min(axis=0)) / (m.max(axis=0) - m.min(axis=0)) for m in both]
        assert pooled[n, "c"] == pytest.approx(sliced_cost(*both, 3), abs=1e-9)


def test_mean_chroma_of_estimates_of_unequal_length(spark):
    """Each estimate is brought to the same frames, whose centres correspond, and averaged channel by channel."""
    draw = np.random.default_rng(14)
    sides = {"long": draw.uniform(size=(20, 3)), "short": draw.uniform(size=(10, 3)), "same": draw.uniform(size=(15, 3))}
    tables = {n: spark.createDataFrame([(5, f, p, float(v)) for f, row in enumerate(m) for p, v in enumerate(row)], "series_id long, frame int, pitch int, v double") for n, m in sides.items()}
    found = {(r["t"], r["ch"]): r["v"] for r in X.mean_chroma(tables, 15).collect()}
    want = np.mean([[np.interp((np.arange(15) + 0.5) * len(m) / 15 - 0.5, np.arange(len(m)), m[:, p]) for p in range(3)] for m in sides.values()], axis=0)
    assert found.keys() == {(t, p) for t in range(15) for p in range(3)} and all(v == pytest.approx(want[p, t]) for (t, p), v in found.items())


def test_pooled_measures_are_those_of_joined_features(spark):
    draw = np.random.default_rng(15)
    x, y = draw.normal(size=(40, 5)), draw.normal(size=(40, 4))
    y[:, 0] += x[:, 1]
    rows = lambda m: spark.createDataFrame([(1, t, c, float(v)) for t, row in enumerate(m) for c, v in enumerate(row)], "series_id long, t int, ch int, v double")
    whole = M.small_matrix_measures(rows(x), rows(y)).collect()[0].asDict()
    pooled = M.pooled_measures({"a": (rows(x[:, :2]), rows(y[:, :3])), "b": (rows(x[:, 2:]), rows(y[:, 3:]))}).collect()[0].asDict()
    assert whole.keys() == pooled.keys()
    for name, value in whole.items():
        assert pooled[name] is None if value is None else pooled[name] == pytest.approx(value, rel=1e-6, abs=1e-9), name
    assert sum(v is not None for v in whole.values()) > 3


def dense_profile(mag, rate, width, norm):
    """The harmonic profile of one series with whole tables of bins, by plain loops."""
    hz = np.arange(mag.shape[1]) * rate / width
    kept = np.flatnonzero((hz > 100) & (hz < 5000))
    db = 20 * np.log10(mag[:, kept])
    x = np.maximum(db - db.max() + 80, 0)
    x = np.where(x >= x.max(axis=1, keepdims=True) - 30, x, 0)
    found = []
    for f, row in enumerate(x):
        for b in range(1, len(row) - 1):
            a, m, c = row[b - 1 : b + 2]
            if m > a and m > c:
                d = (a - c) / 2 / (a - 2 * m + c)
                found.append((f, int(69 + 12 * np.log2((kept[b] + d) * rate / width / 440)), 10 ** ((m - d * (a - c) / 4 - 80) / 20)))
    bins = max(p for _, p, _ in found) + 1
    pitch = np.zeros((len(mag), bins))
    for f, p, v in found:
        pitch[f, p] += v
    white = np.array([[max(row[i] - row[max(i - 2, 0) : i + 2].sum() / 4, 0) for i in range(bins)] for row in pitch])
    weight = {}
    for off in range(-48, 49):
        ratio = 2 ** (off / 12)
        near, limit = round(ratio), np.log(2 ** (1 / 18))
        if near and abs(ratio - near) < limit:
            weight[off] = np.cos(abs(ratio - near) / limit * np.pi / 2) ** 2 * 0.6 ** (near - 1)
    out = np.zeros((len(mag), 12))
    for p in range((bins - 1) // 12 * 12):
        for off, w in weight.items():
            if 0 <= p - off < bins:
                out[:, p % 12] += w / sum(weight.values()) * white[:, p - off]
    out = out[sorted({f for f, _, _ in found})]
    if norm:
        out = out - out.min(axis=1, keepdims=True)
        out = out[out.max(axis=1) > 0]
        out = out / out.max(axis=1, keepdims=True)
        out = np.where(out > 0.1, 0.9 * (out - 0.1), 0)
    return out


@pytest.mark.parametrize("norm", [False, True])
def test_harmonic_profile(spark, norm):
    """Chords of harmonic tones in noise; a silent series has no rows."""
    draw, rate, width = np.random.default_rng(5), 8000.0, 256
    chords = [(262, 330, 392), (220, 262, 330), (294, 370, 440)]
    mags = {}
    for sid, chord in enumerate(chords):
        t = np.arange(6 * width) / rate
        v = sum(0.6**h * np.sin(2 * np.pi * f * (h + 1) * t) for f in chord for h in range(4)) + 0.01 * draw.normal(size=len(t))
        mags[sid] = np.abs(np.fft.rfft(v.reshape(6, width) * np.hanning(width), axis=1))
    rows = [(s, f, b, float(v)) for s, m in mags.items() for f, row in enumerate(m) for b, v in enumerate(row)] + [(9, 0, b, 0.0) for b in range(129)]
    spectrum = spark.createDataFrame(rows, "series_id long, frame int, bin int, mag double")
    got = X.harmonic_profile(spectrum, width, rate, norm=norm, threshold=0.1 if norm else 0.0).collect()
    assert {r["series_id"] for r in got} == set(mags)
    for sid, m in mags.items():
        mine = sorted((r["frame"], r["pitch"], r["v"]) for r in got if r["series_id"] == sid)
        assert np.allclose(np.array([v for _, _, v in mine]).reshape(-1, 12), dense_profile(m, rate, width, norm), atol=1e-9)
