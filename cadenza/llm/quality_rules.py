"""Quality rules as a short-circuit cascade of Column expressions.

Each rule is a predicate that a good text meets. The cost of a rule is the time that it takes on a
bounded sample, less what a job without a rule takes; its selectivity is the share of the sample that it rejects. Rules run in the
order of rejection per cost, and CASE WHEN stops at the first that rejects. The order changes the time and
never the verdict, which is that all rules hold. The sample comes from a few of the files, so that the texts are read once.

Defined results: a null text has no words, all its counts are 0, and it fails the base rule like an
empty text; repeated rows get equal results; an empty table gives no rows (the rules then keep
their given order); rows with null ids are treated like all others. Texts are read whole. Windows of
five words are compared by their 64-bit hashes within one text. All columns of docs are carried, whatever their
names; those named like an output are replaced.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping
from statistics import median
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import WORD, free, table

#: At most about this many rows are measured to order the rules.
SAMPLE_ROWS = 1500
SAMPLE_SEED = 7
#: Files that the sample comes from, where the table has more.
SAMPLE_FILES = 8
#: Runs whose median counts, after one that compiles the code; and how often each row of the sample is tried in a run.
RUNS, REPEATS = 3, 8
WINDOW = 5
#: A word that the next word equals.
ECHO = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))"


def words_of(text: Column) -> Column:
    """All words of a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def lines_of(text: Column) -> Column:
    r"""The \n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeat_words(words: Column) -> Column:
    """Number of words in windows of WINDOW words that occur twice or more in the text."""
    last = F.size(words) - WINDOW
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def shared(x: Column, k: Column, rows: Column) -> Column:
        return (x["h"] == F.get(rows, k - 1)["h"]) | (x["h"] == F.get(rows, k + 1)["h"])

    def covered(rows: Column) -> Column:
        places = F.array_sort(F.transform(F.filter(rows, lambda x, k: F.coalesce(shared(x, k, rows), F.lit(False))), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        )

    found = F.aggregate(F.array(placed), F.lit(0), lambda _, rows: covered(rows))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """Number of characters of a class in a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(chars)).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    body = F.col(text)
    words, lines = free("_words", docs), free("_lines", docs)
    with_words = docs.withColumns({words: words_of(body), lines: lines_of(body)})
    counted = with_words.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": count_chars(body, "[#*$%&|<>]"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(F.col(words)),
        }
    ).drop(words, lines)
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def default_rules(text: Column) -> dict[str, Column]:
    """Rules by name, over a text and its statistics; each is true for a good text."""
    letters = count_chars(text, r"\p{L}")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return {
        "word_length": F.col("word_chars").between(2 * F.col("n_words"), 14 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") <= F.col("n_words"),
        "duplicate_lines": (F.col("n_dup_lines") < 3) | (10 * F.col("n_dup_lines") <= 3 * F.col("n_lines")),
        "ellipsis_lines": 10 * F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))) <= 3 * F.col("n_lines"),
        "bullet_lines": 10 * F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•▪]"))) <= 9 * F.col("n_lines"),
        "letters": 10 * letters >= 4 * F.col("word_chars"),
        "capitals": 2 * count_chars(text, r"\p{Lu}") <= letters,
        "shouting": 10 * count_chars(text, "!") <= F.col("n_words"),
        "echoes": 5 * count_chars(text, ECHO) <= F.col("n_words"),
    }


def measure(rows: DataFrame, rules: Mapping[str, Column], clock: Callable[[], float] = time.perf_counter) -> dict[str, tuple[float, float]]:
    """Seconds and rejected share of each rule on the rows: the median of RUNS runs, less that of a job without a rule."""
    again = rows.withColumn(free("_again", rows), F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(bad: Column) -> tuple[float, float]:
        job, took = again.agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad")), []
        for _ in range(RUNS + 1):
            began = clock()
            n, found = job.collect()[0]
            took.append(clock() - began)
        return median(took[1:]), found / n if n else 0.0

    nothing, _ = run(F.lit(False))
    timed = {name: run(~F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}
    return {name: (max(seconds - nothing, 1e-3), share) for name, (seconds, share) in timed.items()}


def ordered(measured: Mapping[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, highest first; costs count to the nearest power of two, since times vary; ties in the given order."""
    cost = lambda name: 2.0 ** round(math.log2(max(measured[name][0], 1e-9)))
    return sorted(measured, key=lambda name: -measured[name][1] / cost(name))


def verdict(rules: Mapping[str, Column], order: list[str]) -> Column:
    """Null if all rules hold, else the name of the first one that fails, later ones not evaluated."""
    out = None
    for name in order:
        fails = ~F.coalesce(rules[name], F.lit(False))
        out = F.when(fails, F.lit(name)) if out is None else out.when(fails, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About that many rows at most, the same on each run over the same files; from SAMPLE_FILES of them, evenly spaced, if there are more."""
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        names = [unquote(f.rsplit("/", 1)[-1]) for f in files[:: len(files) // SAMPLE_FILES][:SAMPLE_FILES]]
        try:
            some = docs.where(F.col("_metadata.file_name").isin(names))
            n = some.count()
        except AnalysisException:  # docs is no plain scan
            n = 0
        if n >= rows:
            return some.sample(fraction=rows / n, seed=SAMPLE_SEED)
    n = docs.count()
    return docs if n <= rows else docs.sample(fraction=rows / n, seed=SAMPLE_SEED)


def cascade(docs: DataFrame, text: str = "text", rules: Callable[[Column], dict[str, Column]] = default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with their statistics, kept, and failed_rule (the base rule's name is 'base').

    Which of several failing rules failed_rule names depends on the order found; kept does not.
    """
    own = rules(F.col(text))
    sample = statistics(sample_of(docs, sample_rows), text).cache()
    try:
        order = ordered(measure(sample, own))
    finally:
        sample.unpersist()
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(own, order))
    return statistics(docs, text).withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL_op2_quality_rules = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         string_split(text, chr(10)) AS al
  FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS t(k) GROUP BY r
), s AS (
  SELECT w.r, doc_id, text, al, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS caps,
         length(regexp_replace(text, '[^!]', '', 'g')) AS shouts
  FROM w LEFT JOIN cov ON cov.r = w.r
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= n_words
         AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * n_lines)
         AND 10 * len(list_filter(al, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= 3 * n_lines
         AND 10 * len(list_filter(al, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•▪]'))) <= 9 * n_lines
         AND 10 * letters >= 4 * word_chars AND 2 * caps <= letters AND 10 * shouts <= n_words
         AND 5 * len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) <= n_words AS kept
FROM b
"""
