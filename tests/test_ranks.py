"""Places and shares over sorted ranges against plain sorting."""

import random

from pyspark.sql import functions as F

from cadenza.operators import measures as M
from cadenza.operators import ranks as R


def test_places_and_sums_cross_the_borders_of_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(40), i, draw.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, i long, w int").repartition(5)
    places = {(r["g"], r["i"]): (r["pos"], r["n"]) for r in R.placed(df, ["g"], ["v", "i"]).collect()}
    sums = {r["i"]: (r["run"], r["all"]) for r in R.running(df, ["g"], ["v", "i"], F.col("w"), "run", "all").collect()}
    for g in ("a", "b", None):
        own = sorted((v, i, w) for k, v, i, w in rows if k == g)
        assert [places[g, i] for _, i, _ in own] == [(k, len(own)) for k in range(len(own))]
        total = 0
        for _, i, w in own:
            total += w
            assert sums[i] == (total, sum(w for *_, w in own))
    assert [r["pos"] for r in R.placed(df, [], ["i"]).orderBy("i").collect()] == list(range(700))
    assert R.placed(df.where("false"), ["g"], ["v"]).count() == 0


def test_shares_of_ties(spark):
    df = spark.createDataFrame([("x", v) for v in [3, 1, 3, 3, 2]] + [("y", 7)] * 50, "g string, v int")
    got = {(r["g"], r["v"]): (round(r["r"] * r["n"]), round(r["g_"] * r["n"])) for r in R.shares(df, ["g"], "v").toDF("g", "v", "r", "g_", "n", "c").collect()}
    assert got == {("x", 1): (1, 5), ("x", 2): (2, 4), ("x", 3): (5, 3), ("y", 7): (50, 50)}


def test_xi_columns_over_small_stretches(spark, monkeypatch):
    """Neighbours across the borders of stretches count once."""
    draw = random.Random(2)
    cols = {c: [draw.randrange(12) for _ in range(90)] for c in (2, 5, 9)}
    cols[9] = [v * v for v in cols[2]]
    df = spark.createDataFrame([(t, c, float(v)) for c, vs in cols.items() for t, v in enumerate(vs)], "t long, ch int, v double").repartition(4)
    whole = {(r["i"], r["j"]): r["xi"] for r in M.xi_columns(df).collect()}
    monkeypatch.setattr(M, "STRETCH", 7)
    cut = {(r["i"], r["j"]): r["xi"] for r in M.xi_columns(df).collect()}
    for i in cols:
        for j in set(cols) - {i}:
            order = sorted(range(90), key=lambda t: (cols[i][t], t))
            rank = [sum(v <= x for v in cols[j]) / 90 for x in cols[j]]
            g = [sum(v >= x for v in cols[j]) / 90 for x in cols[j]]
            want = 1 - sum(abs(rank[a] - rank[b]) for a, b in zip(order, order[1:])) / 180 / (sum(x * (1 - x) for x in g) / 90)
            assert abs(whole[i, j] - want) < 1e-9 and abs(cut[i, j] - want) < 1e-9
