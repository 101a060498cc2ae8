"""Phrases whose words stand together more often than their parts would have it, counted in counting quotient filters.

A task reads texts into shards of bounded size and writes, for each shard and language, its words with their counts and the texts as numbers of words. Words
that are frequent in all shards together get ids, which go back to the shards that hold them. A shard packs each n-gram of ids, permutes it invertibly
(a Feistel network over the 32-bit ids) and writes a counting quotient filter: sorted by the permuted bits, the leading bits are a quotient of which only run lengths
are kept, the others are the remainder, kept in full, and a counter of a byte, larger ones apart. No two n-grams share an entry, so that counts are exact. Filters are cut into ranges of the
quotient; those of one range meet in one task, which merges their sorted entries and adds the counters. The permutation spreads n-grams evenly, and a shard
gives each at most one entry, so that no word or phrase is hot and each range is of bounded size.

Pairs are counted first. Each shard gets back which of its pairs are frequent, and counts phrases of three and four words all of whose pairs are:
others can't be frequent enough. What goes through the driver are numbers of entries.

Defined results: a null language is `und`, a null text is empty; piece ends and runs of blanks make no words; equal texts count as often as they occur; an
empty table gives no rows. Only the text and language columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm._common import discard, small_batches, stage, table
from cadenza.llm._order import numbered

LONGEST = 4
#: Bytes of text in a shard, of text cut into words at once, and entries of a range of filters.
SHARD = 1 << 24
CHUNK = 1 << 22
RANGE = 1 << 19
#: n-grams permuted or looked up at once, and leading bits by which those of a shard are sorted apart (at most those that name a range).
BLOCK = 1 << 17
SLICE = 4
_ENDS = b".,;:!?\n\v\f\r"
#: Lower case, and one mark for all ends of pieces.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b"\n" * len(_ENDS))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8 in parts, with "." (which is in no word) for the end of a piece."""
    text = text.translate(_PLAIN).replace(b"\n", b" . ")
    at = 0
    while at < len(text):
        to = text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


class _Numbers(dict):
    """Numbers of words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def shards(docs: DataFrame, text: str, lang: str, limit: int = SHARD) -> DataFrame:
    """shard, lang, words and counts of the words (number i + 1 at place i), and seen: the texts as 32-bit numbers, 0 between pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = TaskContext.get().partitionId() << 24, 0
        names, seen = defaultdict(lambda: _Numbers({b".": 0})), defaultdict(list)

        def full() -> pd.DataFrame:
            rows = []
            for language, known in names.items():
                ids = np.concatenate(seen[language])
                rows.append((shard, language, list(known)[1:], np.bincount(ids, minlength=len(known))[1:].tolist(), ids.tobytes()))
            return pd.DataFrame(rows, columns=["shard", "lang", "words", "counts", "seen"])

        for batch in batches:
            for language, body in zip(batch["lang"], batch["text"]):
                number = names[language].__getitem__
                for part in words(body):
                    seen[language].append(np.fromiter(map(number, part), np.uint32, len(part)))
                seen[language].append(np.zeros(1, np.uint32))
                held += len(body)
                if held >= limit:
                    yield full()
                    names.clear(), seen.clear()
                    shard, held = shard + 1, 0
        if names:
            yield full()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(run, "shard long, lang string, words array<binary>, counts array<long>, seen binary")


def permuted(grams: list[np.ndarray], back: bool = False) -> list[np.ndarray]:
    """Columns of 32-bit ids, permuted as whole n-grams; or what gave these."""
    columns, k = [g.astype(np.uint32) for g in grams], len(grams)
    steps = range(2 * k)
    for step in reversed(steps) if back else steps:
        mixed = np.full(len(columns[0]), (step + 1) * 0x9E3779B9 & 0xFFFFFFFF, np.uint32)
        for other in range(1, k):
            mixed = (mixed ^ columns[(step + other) % k]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0xC2B2AE35)
            mixed ^= mixed >> np.uint32(13)
        columns[step % k] = columns[step % k] ^ mixed
    return columns


def ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sort keys of 64 bits, the first one leading, for columns of 32-bit values."""
    wide = [c.astype(np.uint64) for c in columns]
    return [wide[i] << np.uint64(32) | wide[i + 1] if i + 1 < len(wide) else wide[i] << np.uint64(32) for i in range(0, len(wide), 2)]


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in sorted order, once each, with the sums of their counts. Sorted runs are merged (a stable sort)."""
    if not len(counts):
        return columns, counts
    order_by = ordered(columns)
    order = np.argsort(order_by[0], kind="stable") if len(order_by) == 1 else np.lexsort(order_by[::-1])
    same = np.ones(len(order) - 1, bool)
    for key in order_by:
        same &= key[order[1:]] == key[order[:-1]]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    return [c[order[starts]] for c in columns], np.add.reduceat(counts[order], starts)


def encoded(columns: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Filters (range, number of entries, bytes) of sorted, permuted entries: one for each value of the leading `bits` bits."""
    lead = columns[0].astype(np.uint64)
    ranges = (lead >> np.uint64(32 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(ranges)]):
        slot_bits = min(max(int(b - a).bit_length() - 3, 0), 32 - bits)
        left = 32 - bits - slot_bits
        slots = (lead[a:b] >> np.uint64(left)) & np.uint64((1 << slot_bits) - 1)
        runs = np.bincount(slots.astype(np.int64), minlength=1 << slot_bits).astype("<u2" if b - a < 1 << 16 else "<u4")
        size = (left + 7) // 8
        rest = (lead[a:b] & np.uint64((1 << left) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        more = [c[a:b].astype("<u4").tobytes() for c in columns[1:]]
        n = counts[a:b]
        yield int(ranges[a]), int(b - a), b"".join([bytes([slot_bits]), runs.tobytes(), np.ascontiguousarray(rest).tobytes(), *more, np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes()])


def decoded(data: bytes, k: int, n: int, number: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries and counts of a filter of n n-grams of k words in range `number`."""
    slot_bits, at = data[0], 1
    kind = "<u2" if n < 1 << 16 else "<u4"
    runs = np.frombuffer(data, kind, 1 << slot_bits, at)
    at, left = at + runs.nbytes, 32 - bits - slot_bits
    size = (left + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    lead = rest.view("<u8").ravel() | np.repeat(np.arange(1 << slot_bits, dtype=np.uint64), runs) << np.uint64(left) | np.uint64(number << (32 - bits))
    columns = [lead.astype(np.uint32)]
    for _ in range(k - 1):
        columns.append(np.frombuffer(data, "<u4", n, at))
        at += 4 * n
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + n)
    return columns, counts


FILTER = "shard long, lang string, k int, number long, n long, data binary"


def filters(shard: int, lang: str, seen: np.ndarray, starts: np.ndarray, k: int, bits: int) -> pd.DataFrame:
    """Rows of FILTER for the n-grams of a shard: the k ids of `seen` from each of `starts` on. n-grams are permuted in blocks, and sorted and
    encoded for one value of their leading SLICE bits at a time, so that a task holds their ids once and little else."""
    held, rows = [[] for _ in range(1 << SLICE)], []
    for at in range(0, len(starts), BLOCK):
        columns = np.stack(permuted([seen[starts[at : at + BLOCK] + np.int64(i)] for i in range(k)]))
        of = columns[0] >> np.uint32(32 - SLICE)
        order = np.argsort(of, kind="stable")
        for part, own in zip(held, np.split(columns[:, order], np.searchsorted(of[order], np.arange(1, 1 << SLICE)), axis=1)):
            part.append(own)
    for i, part in enumerate(held):
        held[i] = None
        if part:
            columns, counts = summed(list(np.concatenate(part, axis=1)), np.ones(sum(own.shape[1] for own in part), np.int64))
            rows += [(shard, lang, k, number, n, data) for number, n, data in encoded(columns, counts, bits)]
    return pd.DataFrame(rows, columns=["shard", "lang", "k", "number", "n", "data"])


def merged(parts: DataFrame, bits: int, least: int, back: bool) -> DataFrame:
    """The n-grams of all shards found `least` times: ids (4 bytes each, in order) and f; with back, also each shard's own of them as
    a filter (then ids is null)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, number = int(key[0]), int(key[1])
        each = [decoded(data, k, n, number, bits) for data, n in zip(rows["data"], rows["n"])]
        columns, counts = summed([np.concatenate([e[0][i] for e in each]) for i in range(k)], np.concatenate([e[1] for e in each]))
        often = counts >= least
        columns, counts = [c[often] for c in columns], counts[often]
        plain = np.stack(permuted(columns, back=True), axis=1).astype(">u4") if len(counts) else np.zeros((0, k), ">u4")
        out = [(0, None, k, number, 0, None, ids.tobytes(), f) for ids, f in zip(plain, counts.tolist())]
        if back and len(counts):
            whole = ordered(columns)[0]
            for shard, lang, (own, n) in zip(rows["shard"], rows["lang"], each):
                on = np.isin(ordered(own)[0], whole, assume_unique=True)
                out += [(shard, lang, k, number, m, data, None, 0) for _, m, data in encoded([c[on] for c in own], n[on], bits)]
        return pd.DataFrame(out, columns=["shard", "lang", "k", "number", "n", "data", "ids", "f"])

    return parts.groupBy("k", "number").applyInPandas(run, f"{FILTER}, ids binary, f long")


def _bits(entries: int) -> int:
    """Leading bits that name a range of filters."""
    return min(max((max(entries, 1) // RANGE).bit_length(), SLICE), 24)


def counted(docs: DataFrame, text: str, lang: str, least: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the words: lang, word, f, and id of those found `least` times in a language (written); n by lang; and ids and f of all phrases of one to LONGEST words found so often."""
    small_batches(docs.sparkSession)
    read = stage(shards(docs, text, lang, limit), "shards")
    each = read.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("shard", "lang", (F.col("place") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    total = stage(each.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    sizes = total.groupBy("lang").agg(F.sum("f").alias("n"))
    often = numbered(total.where(F.col("f") >= least).withColumn("grp", F.lit("")), "grp", ["lang", "word"], "frequent-words")
    known = stage(often.select("lang", "word", "f", (F.col("pos") + 1).alias("id")), "words-with-ids")
    last = known.agg(F.max("id"), F.sum("f")).first()
    if (last[0] or 0) >= 1 << 32:
        raise ValueError(f"{last[0]} frequent words; ids have 32 bits")
    bits = _bits(last[1] or 0)
    named = each.select("shard", "lang", "local", "word").join(known.select("lang", "word", "id").hint("merge"), ["lang", "word"]).select("shard", "lang", "local", "id").toDF("of", "in", "local", "id")

    def pairs(texts: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(ids):
            return pd.DataFrame(columns=["shard", "lang", "k", "number", "n", "data"])
        local = np.frombuffer(texts["seen"][0], np.uint32)
        to = np.zeros(local.max() + 1, np.uint32)
        to[ids["local"].to_numpy()] = ids["id"].to_numpy()
        seen = to[local]
        shard, language = texts["shard"][0], texts["lang"][0]
        starts = np.flatnonzero((seen[:-1] > 0) & (seen[1:] > 0)).astype(np.uint32)
        whole = pd.DataFrame([(shard, language, 0, 0, len(seen), seen.tobytes())], columns=["shard", "lang", "k", "number", "n", "data"])
        return pd.concat([whole, filters(shard, language, seen, starts, 2, bits)])

    by = ["shard", "lang"]
    first = stage(read.select(*by, "seen").groupBy(*by).cogroup(named.groupBy("of", "in")).applyInPandas(pairs, FILTER), "pairs")
    two = stage(merged(first.where("k = 2"), bits, least, back=True), "frequent-pairs")

    def longer(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(own):
            return pd.DataFrame(columns=["shard", "lang", "k", "number", "n", "data"])
        seen = np.frombuffer(texts["data"][0], np.uint32)
        known = np.sort(np.concatenate([ordered(decoded(data, 2, n, number, bits)[0])[0] for data, n, number in zip(own["data"], own["n"], own["number"])]))
        at = np.flatnonzero((seen[:-1] > 0) & (seen[1:] > 0))
        frequent = np.zeros(len(seen) + LONGEST, bool)
        for i in range(0, len(at), BLOCK):
            some = at[i : i + BLOCK]
            keys = ordered(permuted([seen[some], seen[some + 1]]))[0]
            frequent[some] = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        run, out = frequent.copy(), []
        for k in range(3, LONGEST + 1):
            run = run[:-1] & frequent[k - 2 : k - 2 + len(run) - 1]
            out.append(filters(texts["shard"][0], texts["lang"][0], seen, np.flatnonzero(run).astype(np.uint32), k, bits))
        return pd.concat(out)

    own = two.where("ids is null").select(*by, "number", "n", "data")
    more = stage(first.where("k = 0").select(*by, "data").groupBy(*by).cogroup(own.groupBy(*by)).applyInPandas(longer, FILTER), "longer")
    found = merged(more, bits, least, back=False).union(two.where("ids is not null")).select("ids", "f")
    single = known.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("ids"), "f")
    phrases = stage(found.union(single), "phrases")
    discard(read, first, two, more)
    return known, sizes, phrases


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000, text: str = "text", lang: str = "lang", limit: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases; limit: bytes of text in a shard."""
    known, sizes, phrases = counted(docs, text, lang, least, limit)
    size = F.expr("octet_length(ids) div 4")
    sought = phrases.select("ids", F.col("f").alias("a"), size.alias("k")).where("k > 1")
    parts = [(start, k) for k in range(2, LONGEST) for start in range(LONGEST - k + 1)]
    within = F.explode(F.array_compact(F.array(*[F.when(F.lit(start + k) <= F.col("k"), F.struct(F.substring("ids", 4 * start + 1, 4 * k).alias("ids"), F.lit(k).alias("k"))) for start, k in parts])))
    covers = sought.where("k > 2").select(F.col("k").alias("long"), F.col("a").alias("over"), within.alias("p")).where("p.k < long").groupBy(F.col("p.ids").alias("ids")).agg(F.max("over").alias("over"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = sought.join(covers, "ids", "left").where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * inside)).select("ids", "a", "k")
    cut = kept.withColumn("cut", F.explode(F.expr("sequence(1, int(k) - 1)")))
    cut = cut.withColumn("left", F.expr("substring(ids, 1, 4 * cut)")).withColumn("right", F.expr("substring(ids, 4 * cut + 1)"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(phrases.select(F.col("ids").alias(side), F.col("f").alias(name)), side)
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cut.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("ids", "a", "b.score", "b.l", "b.r")
    place = best.select("ids", F.posexplode(F.expr(f"transform(sequence(0, {LONGEST - 1}), i -> substring(ids, 4 * i + 1, 4))")).alias("at", "one")).where("octet_length(one) = 4")
    names = known.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("one"), "lang", F.col("word").cast("string").alias("word"))
    spelt = place.join(names, "one").groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(spelt, "ids")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.expr("pmod(xxhash64(ids), 64)")).orderBy(*order)
    rows = rows.withColumn("first", F.row_number().over(salted)).where(F.col("first") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL_op13_collocations = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(ws) >= k)
), c AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY 1
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 30
), longer AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS over FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 4) t(m) WHERE m < k) GROUP BY 1, 2
), kept AS (
  SELECT cand.* FROM cand LEFT JOIN longer USING (lang, phrase) WHERE over IS NULL OR 100 * over::HUGEINT < 80 * a::HUGEINT
), cuts AS (
  SELECT kept.lang, kept.phrase, a, m, x.f AS l, y.f AS r, ((2000000 * a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM kept, range(1, 4) t(m), c x, c y
  WHERE m < kept.k AND x.lang = kept.lang AND x.phrase = array_to_string(ws[1:m], ' ') AND y.lang = kept.lang AND y.phrase = array_to_string(ws[m + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""
