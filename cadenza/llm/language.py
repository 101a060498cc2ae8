"""Language identification by interpolated Kneser-Ney character language models.

Training: letters are lower-cased, every run of other characters becomes one space, and the
character n-grams up to ORDER are counted per language by a grouped sum over a bounded sample of
whole labelled texts. The counts become interpolated Kneser-Ney probabilities. The model is one
sorted array of n-gram hashes for each order, with a row of log probabilities (one column for each
language) beside each hash; an n-gram that is in no array backs off to the next shorter one.

Prediction: the language of the lowest length-normalised cross-entropy, summed over the whole text.
A text is rejected if that cross-entropy is above what the language's own texts reach, or if it holds no letter. The bound
is calibrated on a fifth of the sample that the model doesn't learn from: a quantile of its texts, and a slack that falls with the length.

Defined results: a null text, an empty one and one without letters have the language `und`, score 0
and are rejected; without any labelled text every language is `und`. Rows are scored one by one, so
repeated rows get equal results; null ids, sources and other columns don't matter, and rows with a
null language are left out of the training. predict() carries all columns, and replaces one of the output's name.

The sample is bounded for each language, and so is the model, whose size is checked before it is built: one that would not
fit raises an error, and no language is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import broadcast_if_small, id_crc, small_batches, table
from cadenza.llm._shingles import mix

ORDER = 4
DISCOUNT = 0.75
#: Bound of the training sample: about this many labelled documents of each language.
TRAIN_DOCS = 800
#: Texts of the sample for calibration: one in so many.
CALIBRATION = 5
#: Languages with fewer texts are learned and calibrated on all of them.
FEW = 50
#: Megabytes that the model may have in a worker; the driver needs a multiple of it.
MODEL_MB = 256
#: Of the calibration texts of a language, this share has a lower cross-entropy than the bound before the slack.
QUANTILE = 0.99
SLACK, SLACK_SHORT = 1.0, 6.0
#: Nats of cross-entropy by which the score's odds grow, for a text of one character and at most so many.
SHARPNESS, SHARP_CHARS = 1.0, 60

_SPACE, _STEP = np.uint64(32), np.uint64(0x100000001B3)


@functools.cache
def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower-case letter (else space), and whether it is a letter."""
    code = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            code[c] = ord(low[0])
    return code, code != 32


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after one space, without repeated spaces; where each begins
    (one more bound at the end); and the number of letters of each."""
    code, is_letter = _letter_table()
    parts = [t or "" for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in parts), np.int64, len(parts))
    raw = np.frombuffer((" " + " ".join(parts)).encode("utf-32-le", "surrogatepass"), "<u4") if parts else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letter = is_letter[raw]
    first = np.zeros(len(raw), bool)
    first[starts[:-1]] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    count = np.concatenate([[0], np.cumsum(letter)])
    return code[raw[keep]], place[starts], np.diff(count[starts])


def grams(codes: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each place, and whether it lies within one text."""
    out = np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64)
    for back in range(order - 1, -1, -1):
        out[order - 1 :] = out[order - 1 :] * _STEP + wide[order - 1 - back : len(wide) - back] + np.uint64(1)
    whole = np.ones(len(codes), bool)
    for k in range(order - 1):
        at = bounds[:-1] + k
        whole[at[at < len(codes)]] = False
    return mix(out), whole


@dataclass
class Model:
    """Sorted hashes and log probabilities (a row for each language) for the orders from 1 to ORDER."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    back: list[np.ndarray]  # what a context adds when the longer n-gram is unseen, in the order of hashes
    unseen: np.ndarray
    bound: np.ndarray | None = None

    def __post_init__(self):
        self.shift = [np.uint64(64 - max(1, len(x).bit_length() + 1)) for x in self.hashes]
        self.starts = [np.searchsorted(x, np.arange(1 << int(64 - b), dtype=np.uint64) << b).astype(np.int32) for x, b in zip(self.hashes, self.shift)]
        self.ended = [np.append(x, np.uint64(0xFFFFFFFFFFFFFFFF)) for x in self.hashes]

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the sorted hashes of n-grams, and whether it is there. The key's first
        bits say where in the array to begin."""
        known = self.ended[n - 1]
        place = self.starts[n - 1][keys >> self.shift[n - 1]]
        low = np.flatnonzero(known[place] < keys)
        while len(low):
            place[low] += 1
            low = low[known[place[low]] < keys[low]]
        return place, known[place] == keys

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character for each text and language, and the number of letters."""
        nats, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # runs of texts of about 200,000 characters, or one long text
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to] or "") <= 200_000):
                n += len(texts[to] or "")
                to += 1
            codes, bounds, letters[at:to] = normal(texts[at:to])
            for k, logs in enumerate(self.score(codes, bounds)):
                nats[at:to, k] = -np.add.reduceat(logs, bounds[:-1], dtype=np.float64) / np.diff(bounds)
            at = to
        return nats, letters

    def score(self, codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """For each language, the log probability of each character after those before it."""
        kinds = range(len(self.languages))
        out = [np.zeros(len(codes), np.float32) for _ in kinds]
        open_at = np.arange(len(codes))
        for n in range(len(self.hashes), 0, -1):
            found, whole = grams(codes, bounds, n)
            place, hit = self.find(n, found[open_at])
            hit &= whole[open_at]
            done, place = open_at[hit], place[hit]
            for k in kinds:
                out[k][done] += self.logs[n - 1][k][place]
            open_at = open_at[~hit]
            if n > 1 and len(open_at):  # what the unseen n-gram's context gives to shorter ones
                context, inside = grams(codes, bounds, n - 1)
                after = open_at[whole[open_at]]
                place, hit = self.find(n - 1, context[after - 1])
                hit &= inside[after - 1]
                for k in kinds:
                    out[k][after[hit]] += self.back[n - 2][k][place[hit]]
        for k in kinds:
            out[k][open_at] += self.unseen[k]
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and rejected for each text."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        nats, letters = self.cross_entropy(texts)
        best = nats.argmin(axis=1)
        low = nats[np.arange(len(texts)), best]
        n = np.maximum(letters, 1)
        score = 1 / np.exp(-np.minimum(SHARPNESS * np.minimum(n, SHARP_CHARS)[:, None] * (nats - low[:, None]), 700)).sum(axis=1)
        rejected = (letters == 0) | (low > self.bound[best] + SLACK + SLACK_SHORT / np.sqrt(n))
        return pd.DataFrame(
            {
                "lang_pred": np.where(letters == 0, "und", np.array(self.languages, object)[best]),
                "score": np.where(letters == 0, 0.0, score),
                "cross_entropy": np.where(letters == 0, np.nan, low),
                "rejected": rejected,
            }
        )


def build(counts: pd.DataFrame, languages: list[str], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts of the longest n-grams. counts: lang, gram (text), n."""
    index = {lang: i for i, lang in enumerate(languages)}
    level: dict[str, np.ndarray] = {}
    for lang, gram, n in counts[["lang", "gram", "n"]].itertuples(index=False):
        level.setdefault(gram, np.zeros(len(languages)))[index[lang]] += n
    tables = {order: level}
    for n in range(order - 1, 0, -1):  # lower orders count in how many contexts a string was seen
        lower: dict[str, np.ndarray] = {}
        for gram, row in tables[n + 1].items():
            lower.setdefault(gram[1:], np.zeros(len(languages)))
            lower[gram[1:]] += row > 0
        tables[n] = lower
    base = np.full(len(languages), 1.0 / (len(tables[1]) + 1))
    below: dict[str, np.ndarray] = {"": base}
    hashes, logs, back, backs = [], [], [], {}
    for n in range(1, order + 1):
        total: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        for gram, row in tables[n].items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + row
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + (row > 0)
        spare = {c: np.where(total[c] > 0, DISCOUNT * kinds[c] / np.maximum(total[c], 1), 1.0) for c in total}
        here = {}
        for gram, row in tables[n].items():
            c = gram[:-1]
            own = np.where(total[c] > 0, np.maximum(row - DISCOUNT, 0) / np.maximum(total[c], 1), 0.0)
            shorter = below.get(gram[1:])
            here[gram] = own + spare[c] * (base if shorter is None else shorter)
        backs[n] = spare
        keys = sorted(here)
        code = _hash_strings(keys, n)
        rank = np.argsort(code, kind="stable")
        hashes.append(code[rank])
        logs.append(np.ascontiguousarray(np.log(np.array([here[keys[i]] for i in rank])).astype(np.float32).T))
        below = here
    for n in range(1, order):  # a context of n characters, in the order of its hash
        keys = sorted(tables[n])
        rank = np.argsort(_hash_strings(keys, n), kind="stable")
        one = np.ones(len(languages))
        back.append(np.ascontiguousarray(np.log(np.array([backs[n + 1].get(keys[i], one) for i in rank])).astype(np.float32).T))
    return Model(languages, hashes, logs, back, np.log(backs[1][""] * base).astype(np.float32))


def _hash_strings(keys: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(keys).encode("utf-32-le"), "<u4").reshape(len(keys), n).astype(np.uint64)
    out = np.zeros(len(keys), np.uint64)
    for k in range(n):
        out = out * _STEP + codes[:, k] + np.uint64(1)
    return mix(out)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the longest n-grams of each batch and language; texts are padded with spaces, so
    that the starts of texts are counted too."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            codes, bounds, _ = normal(list(texts))
            if len(codes) < ORDER:
                continue
            wide = codes.astype(np.uint64)
            key = np.zeros(len(codes) - ORDER + 1, np.dtype(("u4", ORDER)))
            for k in range(ORDER):
                key[:, k] = wide[k : len(wide) - ORDER + 1 + k]
            whole = np.ones(len(codes), bool)
            for k in range(1, ORDER):
                at = bounds[1:-1] - k
                whole[at[at >= 0]] = False
            kinds, n = np.unique(key[whole[: len(key)]], axis=0, return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": [bytes(r.tobytes()).decode("utf-32-le", "replace") for r in kinds.astype("<u4")], "n": n})


def training_sample(labelled: DataFrame, docs: int = TRAIN_DOCS) -> DataFrame:
    """About `docs` whole texts of each language, by a hash of the text; all of a rarer language. n is how many it has."""
    full = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = broadcast_if_small(full.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")))
    draw = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30))
    return full.join(sizes, F.col("lang") == F.col("_lang")).where(draw * F.col("_n") < docs * (1 << 30)).select("text", "lang", F.col("_n").alias("n"))


def train(labelled: DataFrame, docs: int = TRAIN_DOCS) -> Model:
    """Model of the languages in labelled (text, lang), fitted on training_sample()."""
    small_batches(labelled.sparkSession)
    sample = training_sample(labelled.select("text", "lang"), docs).repartition(12).persist()
    checked = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(CALIBRATION)) == 0
    learned = ~checked | (F.col("n") < FEW)  # the texts of a rare language serve for both
    try:
        counted = sample.where(learned).mapInPandas(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
        size = counted.agg(F.count_distinct("gram").alias("grams"), F.count_distinct("lang").alias("languages")).collect()[0]
        megabytes = 2 * size["grams"] * (8 + 4 * size["languages"]) / 1e6  # shorter n-grams and contexts take less than the longest
        if megabytes > MODEL_MB:
            raise ValueError(f"a model of {size['languages']} languages and {size['grams']} n-grams takes up to {megabytes:.0f} MB; MODEL_MB is {MODEL_MB}: take fewer documents of each, or train in blocks of languages")
        counts = counted.toPandas()
        counted.unpersist()
        languages = sorted(counts["lang"].unique())
        if not languages:
            return Model([], [], [], [], np.zeros(0), np.zeros(0))
        model = build(counts, languages)
        sent = labelled.sparkSession.sparkContext.broadcast(model)

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                nats, letters = sent.value.cross_entropy(list(b["text"]))
                place = [sent.value.languages.index(x) for x in b["lang"]]
                yield pd.DataFrame({"lang": b["lang"], "nats": nats[np.arange(len(b)), place], "letters": letters})

        known = sample.where(checked & F.col("lang").isin(languages))
        reach = known.mapInPandas(own, "lang string, nats double, letters long").where("letters >= 200")
        bounds = {r["lang"]: r["q"] for r in reach.groupBy("lang").agg(F.percentile("nats", F.lit(QUANTILE)).alias("q")).collect()}
        sent.destroy()
    finally:
        sample.unpersist()
    most = max(bounds.values(), default=3.0)
    model.bound = np.array([bounds.get(x, most) for x in languages])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred, score, cross_entropy, rejected."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def run(column: pd.Series) -> pd.DataFrame:
        return sent.value.predict(list(column))

    return docs.withColumn(to, run(F.col(text)))


def held_out() -> Column:
    """Documents that no model learns from."""
    return F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
