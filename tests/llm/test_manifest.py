"""The Merkle manifest against a plain version, in groups of many sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = [None if f is None else str(f) for f in (row[0], row[3], row[2], row[4], row[1])]
    return h(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def tree(nodes):
    """The root, and the steps (siblings before, after) of each node."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            joined.append(sum(groups[at : at + 3], []))
        nodes, groups = above, joined
    return nodes[0], paths


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[3] == s), key=lambda x: x[:3]) for s in sources}
    trees = {s: tree([x[2] for x in leaves[s]]) for s in sources}
    root, over = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, over):
        for (_, _, own, r), path in zip(leaves[s], trees[s][1]):
            steps, node = path + up, own
            if r[0] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf((r[0], r[1].replace("\n", ""), *r[2:]))
            for before, after in steps:
                node = h(before, node, after)
            out.append((r[0], own, trees[s][0], root, h(*[x for step in steps for x in step]), node, node == root))
    return sorted(out, key=repr)


def table(sizes, seed):
    draw, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "a\nb", "née\n\nß", "plain words", "x" * 40])
            rows.append((draw.choice([None, *range(5)]) if n < 9 else draw.randrange(10 * n), text, draw.choice([None, "en", "日本"]), source, draw.choice([None, 3, -12])))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 3}, {"a": 1, None: 2, "": 4, "z": 27, "é": 28, "b": 9}, {"big": 1500, "full": 729, "more": 730, "two": 2}, {f"s{i}": i % 3 + 1 for i in range(800)}])
def test_manifest(spark, tmp_path, sizes):
    rows = table(sizes, len(sizes))
    spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit(7)).withColumn("path", F.lit("x")).withColumn("n", F.lit(None).cast("int")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_equal_rows_have_places_of_their_own(spark, tmp_path):
    rows = [(1, "same", "en", "a", 4)] * 5
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(found) == 5 and len({r["leaf"] for r in found}) == 1 and all(r["verified"] for r in found)
    assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_any_change_is_found(spark):
    """A path proves its own leaf only."""
    rows = spark.createDataFrame(table({"a": 40, "b": 3}, 5), DOCS)
    out = merkle.manifest(rows, ["doc_id", "text"], "source", "doc_id", {"other": merkle.leaf([F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))])})
    told = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle.fold(F.col("other"), F.col("path")) == F.col("root")).alias("changed")).collect()
    assert len(told) == 43 and all(r["own"] and not r["changed"] for r in told)


def test_very_long_text(spark, tmp_path):
    rows = [(1, "é\n" * 2_000_000, "en", "a", 4_000_000), (2, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == plain(rows)
