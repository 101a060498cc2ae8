"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled documents. Every path from a root to an
inner or outer node is a rule: a conjunction of bounds on the statistics. A logistic regression with
an L1 penalty keeps the few rules that matter and gives them weights. The model is then one Spark column
expression, a sum of weights of the rules that hold, and scoring needs no Python.

Defined results: a null or empty text has the statistics of an empty text and gets a score like any
other; repeated rows get equal scores; without labels, or with one class only, the score is the share of
label 1 (0.5 without labels) for every text; repeated label rows count as often as they stand; labels
of unknown documents, null ids and null labels are left out of the training; an empty table gives no rows. Other
columns pass through score(), whatever their names; one of the output's name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import broadcast_if_small, free, id_crc, table
from cadenza.llm.quality_rules import ECHO, count_chars, lines_of, words_of

#: Bound of the training sample: about this many labelled documents, taken by a hash of the id.
TRAIN_ROWS = 5_000
TREES, DEPTH, LASSO = 24, 3, 0.002
SEED = 5
THRESHOLD = 0.7

#: Statistics of a text, each a number from its counts.
STATISTICS = (
    "n_words", "word_length", "symbol_share", "duplicate_line_share", "distinct_share", "echo_share", "letter_share", "capital_share", "digit_share", "shout_share", "bar_share", "comma_share", "stop_share", "line_words",
)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def statistics(docs: DataFrame, text: str = "text", to: str = "_x") -> DataFrame:
    """docs with a column `to`, the array of STATISTICS of the whole text."""
    body = F.col(text)
    name = {k: free(f"_{k}", docs) for k in ("words", "lines", "n", "chars", "distinct", "line", "line_kinds", "letters")}
    words, rows = name["words"], name["lines"]
    counted = docs.withColumns({words: words_of(body), rows: lines_of(body)}).withColumns(
        {
            name["n"]: F.size(words).cast("double"),
            name["chars"]: F.length(F.array_join(words, "")).cast("double"),
            name["distinct"]: F.size(F.array_distinct(words)),
            name["line"]: F.size(rows).cast("double"),
            name["line_kinds"]: F.size(F.array_distinct(rows)),
            name["letters"]: count_chars(body, r"\p{L}").cast("double"),
        }
    )
    n, chars, lines, letters = (F.col(name[c]) for c in ("n", "chars", "line", "letters"))
    values = [
        n,
        _share(chars, n),
        _share(count_chars(body, "[#*$%&|<>]"), n),
        _share(lines - F.col(name["line_kinds"]), lines),
        _share(F.col(name["distinct"]), F.sqrt(n)),
        _share(count_chars(body, ECHO), n),
        _share(letters, chars),
        _share(count_chars(body, r"\p{Lu}"), letters),
        _share(count_chars(body, r"\p{Nd}"), chars),
        _share(count_chars(body, "!"), n),
        _share(count_chars(body, r"[|\t]"), n),
        _share(count_chars(body, "[,;]"), n),
        _share(count_chars(body, "[.?…。]"), n),
        _share(n, lines),
    ]
    kept = [c for c in docs.columns if c.lower() != to.lower()]
    return counted.select(*kept, F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]).alias(to))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, '<=' or '>', value), all of which must hold."""

    bounds: tuple[tuple[int, str, float], ...]

    def column(self, x: str = "_x") -> Column:
        out = F.lit(True)
        for i, side, value in self.bounds:
            out = out & ((F.get(x, F.lit(i)) <= value) if side == "<=" else (F.get(x, F.lit(i)) > value))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[i]} {side} {value:.6g}" for i, side, value in self.bounds)


@dataclass
class Ensemble:
    """Weighted rules; the score is the logistic function of base plus the weights of the rules that hold."""

    base: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, x: str = "_x") -> Column:
        total = F.lit(self.base)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(x), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(node, above: tuple = ()) -> set[Rule]:
    """The rules of a tree below a node of the JVM model."""
    found = {Rule(_tight(above))} if above else set()
    if node.getClass().getSimpleName() == "InternalNode":
        i, value = node.split().featureIndex(), node.split().threshold()
        found |= _paths(node.leftChild(), (*above, (i, "<=", value)))
        found |= _paths(node.rightChild(), (*above, (i, ">", value)))
    return found


def _tight(bounds: tuple) -> tuple:
    """One bound for each statistic and side, in a fixed order."""
    kept: dict[tuple[int, str], float] = {}
    for i, side, value in bounds:
        old = kept.get((i, side))
        kept[i, side] = value if old is None else (min if side == "<=" else max)(old, value)
    return tuple(sorted((i, side, value) for (i, side), value in kept.items()))


def sample_of(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About that many rows of labels (doc_id, label) at most, by a hash of the id."""
    n = labels.count()
    return labels if n <= rows else labels.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ensemble:
    """Ensemble for docs (doc_id, text) and labels (doc_id, label 0 or 1). The texts of the labelled sample are read by
    as many tasks as the table has; only their statistics are gathered."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("label").cast("double").alias("label"))
    taken = broadcast_if_small(sample_of(known.withColumnRenamed("_id", "doc_id"), rows).withColumnRenamed("doc_id", "_id"), 2 * rows)
    joined = docs.select("doc_id", "text").join(taken, F.col("doc_id") == F.col("_id")).select("text", "label")
    assemble = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    spread = statistics(joined).select("label", *[F.get("_x", F.lit(i)).alias(name) for i, name in enumerate(STATISTICS)], "_x")
    data = assemble.transform(spread).select("label", "features", "_x").repartition(8).persist()
    try:
        shares = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
        n, good = sum(shares.values()), shares.get(1.0, 0)
        if len(shares) < 2:
            share = min(max(good / n, 1e-3), 1 - 1e-3) if n else 0.5
            return Ensemble(math.log(share / (1 - share)))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64).fit(data)
        rules = sorted(set().union(*(_paths(t._call_java("rootNode")) for t in forest.trees)), key=lambda r: r.bounds)
        if not rules:
            return Ensemble(math.log(good / (n - good)))
        flags = data.select("label", F.transform(F.array(*[r.column() for r in rules]), lambda b: b.cast("double")).alias("r"))
        flags = flags.select("label", array_to_vector("r").alias("features")).persist()
        try:
            model = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(flags)
        finally:
            flags.unpersist()
        return Ensemble(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6})
    finally:
        data.unpersist()


def score(docs: DataFrame, model: Ensemble, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the score of each text."""
    x = free("_x", docs)
    return statistics(docs, text, x).withColumn(to, model.score(x)).drop(x)


def held_out() -> Column:
    """Documents whose labels no model learns from."""
    return F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
