"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its word shingles. Its signature has PERMUTATIONS values; each of the TREES
trees orders the documents by the signature turned to another starting value. Documents that share
the first DEPTH values in a tree are a region of it. In regions of up to NEXT + 1 documents all are candidate pairs. Larger
ones are put in the order of the turned signatures, so that neighbours share the longest prefixes that the region
has, however deep; each document is a candidate with the NEXT ones after it and with the region's first, which is
a number of pairs linear in the documents. The order is cut into ranges of rows, so that a region of any size is spread.

Candidates are compared by signature, then confirmed on the full shingle sets of the whole texts; links make
components. Documents of large regions that this leaves in different components are joined in a second round by the rarest
shingles of their whole sets: two sets that are similar enough share one among the first of both, whatever the size of
the region, so that no candidate of a large region is lost.

Equal sets are one node before anything is paired, so that exact copies cost one row each. Nothing is
dropped for being frequent.

Defined results: a null or word-free text has an empty set and is linked with nothing; with fewer words than
a shingle, the whole sequence is the one shingle; rows that share an id are one document with all their texts, which
are linked with each other; a row with a null id is a component of its own (component_id null, kept); an empty
table gives no rows. Only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _shingles
from cadenza.llm._common import discard, small_batches, stage, table
from cadenza.llm._graph import components

TREES = 16
PERMUTATIONS = 128
#: Values shared by the documents of a region. A pair at a similarity of 0.85 shares so many in some tree with all but
#: 2 in 10 million chance, one at 0.8 with all but 1 in 100,000.
DEPTH = 3
#: Later neighbours in a tree's order that each document meets in regions of more than NEXT + 1 documents.
NEXT = 3
#: Values of the turned signature by which a region is put in order.
SORTED = 32
#: Leading bits of a shingle by which its frequency is counted.
COUNTED = 18
#: Pairs whose signatures agree in fewer of the values than threshold - SLACK are not compared in full:
#: five standard deviations below the threshold.
SLACK = 0.16
_A = np.random.default_rng(6).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(7).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima of each (non-empty) set, as big-endian 32-bit values."""
    out = np.zeros((len(sets), PERMUTATIONS), ">u4")
    at = 0
    while at < len(sets):  # about 32,000 values at a time stay in the cache
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 32_000):
            n += len(sets[to])
            to += 1
        values = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        for k in range(PERMUTATIONS):
            out[at:to, k] = np.minimum.reduceat((values * _A[k] + _B[k]) >> np.uint64(32), starts)
        at = to
    return out


def signature(text: Column, words: int, lower: bool) -> Column:
    """n_shingles, digest (of the set; null if empty) and values (the signature) of each text."""

    @F.pandas_udf("n_shingles long, digest binary, values binary")
    def run(column: pd.Series) -> pd.DataFrame:
        counts, digests, values = [0] * len(column), [None] * len(column), [None] * len(column)
        for first, hashes, bounds in _shingles.documents(list(column), lower):
            sets = [_shingles.shingle_set(hashes[a:b], words) for a, b in zip(bounds, bounds[1:])]
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            rows = min_hashes([sets[i] for i in full])
            for i, row in zip(full, rows):
                counts[first + i] = len(sets[i])
                digests[first + i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                values[first + i] = row.tobytes()
        return pd.DataFrame({"n_shingles": counts, "digest": pd.Series(digests, dtype=object), "values": pd.Series(values, dtype=object)})

    return run(text)


def turned(tree: Column, depth: int) -> Column:
    """The first `depth` values of the signature in a tree's order."""
    step = 4 * PERMUTATIONS // TREES
    return F.expr(f"substring(concat(values, values), {step} * tree + 1, {4 * depth})")


def alike(threshold: float) -> Column:
    """Whether sets of na and nb shingles can be that similar at all."""
    return F.least("na", "nb") >= threshold * F.greatest("na", "nb")


def beside(rows: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of each row (key, node, n), in the order the rows are in, with the NEXT ones after it that have the same key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            new = 0 if held is None else len(held)
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key, node, n = (rows[c].to_numpy() for c in ("key", "node", "n"))
            for step in range(1, NEXT + 1):
                late = np.arange(max(new, step), len(rows))
                late = late[key[late] == key[late - step]]
                if len(late):
                    yield pd.DataFrame({"a": node[late - step], "na": n[late - step], "b": node[late], "nb": n[late]})
            held = rows.iloc[-NEXT:]

    kind = rows.schema["node"].dataType.simpleString()
    return rows.select("key", "node", "n").mapInPandas(run, f"a {kind}, na long, b {kind}, nb long")


def candidates(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs (a, b) with a < b that share a prefix in some tree, and the members (key, node) of the
    regions whose pairs are not all among them; last, what these read. nodes: node, n, values."""
    trees = nodes.select("node", "n", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "values")
    rows = trees.select("node", "n", "tree", F.xxhash64("tree", turned(F.col("tree"), DEPTH)).alias("key"))
    groups = stage(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "regions")
    members = stage(rows.join(groups.hint("merge"), "key"), "members")
    few, many = members.where(F.col("size") <= NEXT + 1), members.where(F.col("size") > NEXT + 1)
    sides = [few.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"]
    pairs = sides[0].join(sides[1], "key").where("a < b").where(alike(threshold)).select("a", "b")
    crowds = many.select("key", "node")
    written = [groups, members]
    if not many.isEmpty():
        firsts = stage(many.groupBy("key").agg(F.min("node").alias("a")), "firsts")
        named = firsts.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")).hint("merge"), "a")
        star = many.select("key", F.col("node").alias("b"), F.col("n").alias("nb")).join(named.hint("merge"), "key").where("a < b")
        deep = many.select("key", "tree", "node").join(nodes.hint("merge"), "node").select("key", "node", "n", turned(F.col("tree"), SORTED).alias("order"))
        lined = beside(deep.repartitionByRange("key", "order", "node").sortWithinPartitions("key", "order", "node"))
        lined = lined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb")
        for more in (star, lined):
            pairs = pairs.union(more.where(alike(threshold)).select("a", "b"))
        written.append(firsts)
    return pairs.distinct(), crowds, written


def _sets(batch: pd.DataFrame, words: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    for first, hashes, bounds in _shingles.documents(list(batch["text"]), lower):
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield first + i, _shingles.shingle_set(hashes[a:b], words)


def shingle_counts(texts: DataFrame, words: int, lower: bool) -> np.ndarray:
    """How many sets hold shingles of the same COUNTED leading bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            for _, own in _sets(batch, words, lower):
                np.add.at(counts, (own >> np.uint64(64 - COUNTED)).astype(np.int64), 1)
        slots = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": slots, "n": counts[slots]})

    out = np.zeros(1 << COUNTED, np.int64)
    found = texts.select("text").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def rarest(texts: DataFrame, counts: np.ndarray, words: int, lower: bool, percent: int) -> DataFrame:
    """The first shingles of each set of texts (node, c, text), rarest first: shingle, node, c, n and place. A set with a similarity of
    `percent` to one of at most its size has a shingle in common with it among these."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, own in _sets(batch, words, lower):
                n = len(own)
                rank = np.lexsort((own, sent.value[(own >> np.uint64(64 - COUNTED)).astype(np.int64)]))[: n + percent * -n // 100 + 1 if n else 0]
                parts.append((i, n, own[rank]))
            many = [len(p[2]) for p in parts]
            rows = np.repeat([p[0] for p in parts], many).astype(np.int64)
            place = np.concatenate([np.arange(k) for k in many]) if many else np.zeros(0, np.int64)
            shingle = np.concatenate([p[2] for p in parts]) if many else np.zeros(0, np.uint64)
            yield pd.DataFrame({"shingle": shingle.view(np.int64), "node": batch["node"].to_numpy()[rows], "c": batch["c"].to_numpy()[rows], "n": np.repeat([p[1] for p in parts], many), "place": place})

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "c", "text").mapInPandas(run, f"shingle long, node {kind}, c {kind}, n long, place long")


def apart(crowds: DataFrame, labels: DataFrame, bodies: Callable[[DataFrame], DataFrame], words: int, lower: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of the crowded regions (key, node) that are not in one component yet and can be
    similar: a prefix join. The first common shingle of such a pair, rarest first, has after it enough of
    either set for the rest of what they must share. bodies: gives node and text of the nodes in a table."""
    named = stage(crowds.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "crowds")
    mixed = stage(named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "mixed")
    members = stage(named.join(mixed.hint("merge"), "key", "left_semi").select("node", "c").distinct(), "apart-members")
    held = stage(bodies(members.select("node")).join(members.hint("merge"), "node").select("node", "c", "text"), "apart-texts")
    rows = stage(rarest(held, shingle_counts(held, words, lower), words, lower, percent), "rarest")
    split = stage(rows.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle"), "split")
    shared = stage(rows.join(split.hint("merge"), "shingle"), "rarest-shared")
    discard(named, mixed, members, held, rows, split)
    names = ("node", "c", "n", "place")
    x, y = (shared.select("shingle", *(F.col(k).alias(f"{k}_{side}") for k in names)) for side in "xy")
    least = f"ceil({percent} * (n_x + n_y) / {100 + percent}.0)"  # what a similar pair shares
    x = x.where(f"(n_x - place_x) * {100 + percent} >= {2 * percent} * n_x")
    pairs = x.join(y, "shingle").where(f"(n_x < n_y or n_x = n_y and node_x < node_y) and c_x <> c_y and 100 * n_x >= {percent} * n_y and n_x - place_x >= {least} and n_y - place_y >= {least}")
    out = stage(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "apart")
    discard(shared)
    return out


def agree(left: Column, right: Column) -> Column:
    """Share of equal values of two signatures."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(v), ">u4").reshape(-1, PERMUTATIONS) for v in (x, y))
        return pd.Series((a == b).mean(axis=1))

    return run(left, right)


def confirm(left: Column, right: Column, words: int, lower: bool, percent: int) -> Column:
    """Whether the shingle sets of two texts have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def sets(column: pd.Series) -> list[np.ndarray]:
            new = list(dict.fromkeys(t for t in column if t not in known))
            for first, hashes, bounds in _shingles.documents(new, lower):
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    known[new[first + i]] = _shingles.shingle_set(hashes[a:b], words)
            return [known[t] for t in column]

        out = []
        for a, b in zip(sets(x), sets(y)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return run(left, right)


def _same_id(own: DataFrame) -> DataFrame | None:
    """Links between the sets of the rows (doc_id, digest) that share an id; None if no id has several."""
    kinds = own.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("last")).where("a < last")
    kinds = stage(kinds.select("doc_id", "a"), "several")
    return None if kinds.isEmpty() else own.join(kinds.hint("merge"), "doc_id").where("digest <> a").select("a", F.col("digest").alias("b")).distinct()


def link(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("body", F.unhex(F.md5("text")))
    signed = stage(texts.select("doc_id", "body", signature(F.col("text"), words, lower).alias("s")).select("doc_id", "body", "s.*"), "signatures")
    own = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = own.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "body")).alias("at"), F.first("n_shingles").alias("n"), F.first("values").alias("values"))
    nodes = stage(nodes.select("node", "n", "values", "at.doc_id", "at.body"), "nodes")

    def bodies(wanted: DataFrame) -> DataFrame:
        """node and the text of its first document, once."""
        places = nodes.join(wanted.distinct().hint("merge"), "node", "left_semi").select("node", "doc_id", "body")
        return texts.join(places.hint("merge"), ["doc_id", "body"]).groupBy("node").agg(F.first("text").alias("text"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sides = [nodes.select(F.col("node").alias(x), F.col("values").alias(f"v{x}")).hint("merge") for x in "ab"]
        close = pairs.join(sides[0], "a").join(sides[1], "b").where(agree(F.col("va"), F.col("vb")) >= percent / 100 - SLACK).select("a", "b")
        close = stage(close, f"close-{name}")
        full = stage(bodies(close.select(F.col("a").alias("node")).union(close.select("b"))), f"texts-{name}")
        sides = [full.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")).hint("merge") for x in "ab"]
        links = stage(close.join(sides[0], "a").join(sides[1], "b").where(confirm(F.col("ta"), F.col("tb"), words, lower, percent)).select("a", "b"), f"links-{name}")
        discard(close, full)
        return links

    pairs, crowds, written = candidates(nodes.select("node", "n", "values"), percent / 100)
    pairs = stage(pairs, "pairs")
    links = confirmed(pairs, "1")
    together = _same_id(own.select("doc_id", "digest"))
    labels = components(links if together is None else links.union(together), "near")
    if not crowds.isEmpty():
        left = apart(crowds, labels, bodies, words, lower, percent)
        rest = stage(left.join(pairs, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = confirmed(rest, "2").union(labels.select("node", "component"))
            labels = components(links, "near-2")
        discard(left, rest)
    discard(*written, pairs)
    ids = nodes.select("node", "doc_id")
    firsts = labels.join(ids, "node").groupBy("component").agg(F.min("doc_id").alias("first"))
    named = stage(labels.join(firsts, "component").select("node", "first"), "classes")
    classes = ids.join(named, "node", "left").select("node", F.coalesce("first", "doc_id").alias("class"))
    out = signed.join(classes, F.col("digest") == F.col("node"), "left")
    own_class = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", own_class.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 percent of 3-word shingles."""
    return link(table(spark, sf_dir, "documents"), words=3, percent=85)


SQL_op6_near_dup = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS ss FROM w
), g AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (
  SELECT a AS doc_id, a AS c FROM both_ways
  UNION
  SELECT b.b, r.c FROM reach r JOIN both_ways b ON b.a = r.doc_id
), m AS (
  SELECT doc_id, min(c) AS c FROM reach GROUP BY 1
)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""
