"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from cadenza.llm import vector_dup

SCHEMA = "vec_id long, embedding array<double>, label int"


def at(cosine, x, draw):
    """Vectors at that cosine to the rows of x."""
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine * cosine) * z


def plain(rows, threshold=0.9):
    """vec_id: (n_links, component_id), by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            a, b = own[a], own[b]
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted((repr(rows[i][0]), links[i], least.get(find(i))) for i in range(len(rows)))


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "node").selectExpr("*", "'x' AS leader", "1 AS size")
    out = vector_dup.link(df.repartition(3), **more).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out)


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_recall_at_the_threshold(depth):
    x = unit(1500, 64, depth)
    y = at(0.9, x, np.random.default_rng(9))
    many = 2 ** (depth + 1)
    met = np.zeros(len(x), bool)
    for number in range(vector_dup.TABLES):
        a, b = vector_dup.keys(x, number, depth, many), vector_dup.keys(y, number, depth, many)
        assert all(len(set(row)) == len(row) for row in a.tolist())
        met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.all()


def test_rotations_keep_angles():
    x = unit(50, 48, 3)
    y = vector_dup.turned(x, 5)
    assert y.shape == (50, 64) and np.allclose(x @ x.T, y @ y.T)


def test_links_of_all_kinds(spark):
    """Pairs on both sides of the threshold, copies, a clique, a chain, scaled and unlike vectors."""
    draw = np.random.default_rng(4)
    base = unit(120, 64, 1)
    parts = [base, at(0.902, base[:40], draw), at(0.897, base[40:80], draw), at(0.95, base[:20], draw), 7.5 * base[100:110], base[110:120]]
    clique = unit(1, 64, 2) + 0.02 * draw.normal(size=(150, 64))
    chain = [unit(1, 64, 8)]
    for _ in range(12):
        chain.append(at(0.92, chain[-1], draw))
    x = np.concatenate([*parts, clique, *chain])
    rows = [(int(i), v.tolist()) for i, v in zip(draw.permutation(len(x)), x)]
    assert found(spark, rows) == plain(rows)


def test_small_blocks_and_parts_give_the_same(spark, monkeypatch):
    """All ways of comparison, with every bound met."""
    draw = np.random.default_rng(6)
    crowd = at(0.93, np.repeat(unit(1, 64, 5), 120, axis=0), draw)
    tight = unit(1, 64, 6) + 0.01 * draw.normal(size=(90, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([crowd, tight, crowd[:10]]))]
    for name, value in {"PART": 16, "BLOCK": 4, "FEW": 2}.items():
        monkeypatch.setattr(vector_dup, name, value)
    assert found(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [-0.0] * 8]
    one = unit(1, 8, 1)[0].tolist()
    rows = [(i, v) for i, v in enumerate(odd)] + [(20, one), (21, [1e-300 * v for v in one]), (22, [1e300 * v for v in one]), (22, [-v for v in one]), (23, one[:7]), (None, one), (None, [-v for v in one]), (None, None), (24, [1.0]), (25, [3.0]), (26, [-1.0])]
    scaled = [(i, None if v is None else [c / 1e300 if c and abs(c) > 1e200 and np.isfinite(c) else c * 1e300 if c and abs(c) < 1e-200 else c for c in (x if x is not None else None for x in v)] if None not in v else v) for i, v in rows]
    assert found(spark, rows) == plain(scaled)


def test_exact_threshold(spark):
    """Cosines of exactly 0.9."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [8.0, 0.0, 6.0, 0.0])]
    assert found(spark, rows) == [("1", 1, 1), ("2", 2, 1), ("3", 1, 1)]
