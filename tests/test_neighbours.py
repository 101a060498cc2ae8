"""Exact nearest neighbours by cells against all pairs, and how many points a query meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import distances as D
from cadenza.operators import neighbours as N


def frames(spark, queries, points):
    return (
        spark.createDataFrame([(s, t, x.tolist(), k) for s, t, x, k in queries], "series_id long, t long, x array<double>, k int"),
        spark.createDataFrame([(s, u, y.tolist()) for s, u, y in points], "series_id long, u long, y array<double>"),
    )


def plain(queries, points):
    out = {}
    for s, t, x, k in queries:
        far = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 9), u) for p, u, y in points if p == s)
        out[s, t] = [(u, d) for d, u in far[:k]]
    return {key: v for key, v in out.items() if v}


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["series_id"], r["t"]), []).append((r["u"], r["d"]))
    return out


def test_all_kinds_of_points(spark, monkeypatch):
    """Clusters, noise, copies and ties, series of one point, more neighbours asked for than there are, a series without points; cells and parts of few rows."""
    monkeypatch.setattr(N, "PART", 16)
    draw = np.random.default_rng(1)
    points = [(1, u, draw.normal(size=3) * 0.1 + 5 * draw.integers(0, 4)) for u in range(150)] + [(2, u, draw.normal(size=3)) for u in range(60)]
    points += [(2, 100 + u, points[160][2]) for u in range(20)] + [(3, u, np.array([u % 3, u // 3 % 3, 0.0])) for u in range(27)] + [(4, 0, np.zeros(3))]
    queries = [(s, u, y, 1 + u % 7) for s, u, y in points[::3]] + [(1, 900 + i, 30 * draw.normal(size=3), 5) for i in range(5)] + [(4, 1, np.ones(3), 3), (5, 1, np.ones(3), 3), (3, 99, np.ones(3), 40)]
    got = found(N.k_nearest(*frames(spark, queries, points), most=12))
    want = plain(queries, points)
    assert got.keys() == want.keys()
    for key, rows in want.items():
        assert [u for u, _ in got[key]] == [u for u, _ in rows] and [d for _, d in got[key]] == pytest.approx([d for _, d in rows], abs=2e-9)


def test_what_a_query_meets_follows_its_cluster(spark):
    """Four times the points in four times the clusters: a query meets no more than twice as many."""
    met = []
    for clusters in (12, 48):
        draw = np.random.default_rng(clusters)
        centres = 100 * draw.normal(size=(clusters, 8))
        points = [(1, 40 * c + i, centres[c] + 0.05 * draw.normal(size=8)) for c in range(clusters) for i in range(40)]
        compared = []
        rows = N.k_nearest(*frames(spark, [(s, u, y, 4) for s, u, y in points], points), compared=compared).collect()
        assert len(rows) == 4 * len(points) and all(r["u"] // 40 == r["t"] // 40 for r in rows)
        met.append(compared[0].agg(F.avg("n")).first()[0])
    assert met[1] < 2 * met[0] and met[1] < 0.25 * 48 * 40


def test_kernel_distance_by_moments(spark):
    draw = np.random.default_rng(2)
    sides = [draw.normal(size=(30, 5)), draw.normal(size=(41, 5)) + 0.4]
    rows = [("s", s, t, v.tolist()) for s in (0, 1) for t, v in enumerate(sides[s])] + [("one", 0, 0, [1.0] * 5), ("one", 1, 0, [1.0] * 5)]
    got = {r["series_id"]: r["kid"] for r in D.kernel_distance(spark.createDataFrame(rows, "series_id string, side int, t int, x array<double>").repartition(3), "side", 5).collect()}
    k = lambda a, b: (a @ b.T / 5 + 1) ** 3
    mean = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert got["s"] == pytest.approx(mean(k(sides[0], sides[0])) + mean(k(sides[1], sides[1])) - 2 * k(*sides).mean()) and got["one"] is None
