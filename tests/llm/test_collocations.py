"""Collocations against plain counting, and filters that lose nothing."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pytest

from cadenza.llm import collocations as C

DOCS = "doc_id long, text string, lang string, ids string, f int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, ws[i : i + k]] += 1
    sought = {g: a for g, a in counts.items() if a >= least and len(g[1]) > 1}
    over = collections.Counter()
    for (lang, ws), a in sought.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                over[lang, ws[i : i + k]] = max(over[lang, ws[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, ws), a in sought.items():
        if 100 * over[lang, ws] >= 80 * a:
            continue
        cuts = [(2000000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["Hello", "world", "été", "日本", "x y", "a", "b", "c", "A-B", "(n)", "New", "York", "city"]
    fixed = ["new york city hall", "a b c", "world x y", "a a a a a"]
    out = []
    for _ in range(n):
        words = [draw.choice(fixed) if draw.random() < 0.2 else draw.choice(vocabulary) + draw.choice([""] * 8 + [",", ".", "!", "\n", "\t", "\x0b", " \r\n"]) for _ in range(draw.randint(0, 60))]
        out.append((draw.choice(["en", "de", None, "und"]), " ".join(words)))
    return out + [("en", None), (None, ""), ("en", " .,;\n\t"), ("fr", "one two three")]


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    return sorted(map(tuple, C.collocations(df, **more).collect()))


@pytest.mark.parametrize("limit", [C.SHARD, 3000])
def test_collocations(spark, limit):
    rows = texts(1, 300)
    want = plain(rows, 12, 40)
    assert found(spark, rows, least=12, top=40, limit=limit) == want
    assert len(want) > 60 and any(len(w[2].split()) > 2 for w in want)


def test_ties_and_one_word_over_and_over(spark):
    rows = [("en", "b a. " * 30 + "d c! " * 30 + "z " * 40), ("en", "é e, " * 30)]
    assert found(spark, rows) == plain(rows, 30, 2000)


def test_nothing_frequent(spark):
    assert found(spark, [("en", "one two three")]) == []


def test_very_long_text(spark):
    draw = random.Random(2)
    rows = [("en", " ".join(draw.choice("abcdefgh") for _ in range(700_000)) + " tail of it" * 40)]
    assert found(spark, rows, top=50) == plain(rows, 30, 50)


def test_words_of_a_chunked_text():
    text = ("Ab, c\td " * 900_000).encode()
    parts = list(C.words(text))
    assert len(parts) > 1 and [w for p in parts for w in p] == text.lower().replace(b",", b" . ").split()


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("bits", [4, 9, 24])
def test_filters_lose_nothing(k, bits):
    draw = np.random.default_rng(k)
    grams = [draw.integers(1, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32) for _ in range(k)]
    grams = [np.concatenate([g, g[:700], [5, 5]]).astype(np.uint32) for g in grams]
    weight = draw.integers(1, 400, len(grams[0]))
    weight[3] = 1 << 40
    mixed = C.permuted(grams)
    assert all((a == b).all() for a, b in zip(C.permuted(mixed, back=True), grams))
    columns, counts = C.summed(mixed, weight)
    want = collections.Counter()
    for row, w in zip(zip(*[g.tolist() for g in grams]), weight.tolist()):
        want[row] += w
    got, last = collections.Counter(), -1
    for number, n, data in C.encoded(columns, counts, bits):
        assert number > last
        last = number
        back, c = C.decoded(data, k, n, number, bits)
        for row, w in zip(zip(*[g.tolist() for g in C.permuted(back, back=True)]), c.tolist()):
            got[row] += w
    assert got == want


def test_a_filter_is_smaller_than_its_entries():
    grams = C.permuted([np.arange(1, 60_001, dtype=np.uint32), np.arange(1, 60_001, dtype=np.uint32)])
    columns, counts = C.summed(grams, np.ones(60_000, np.int64))
    assert sum(len(data) for _, _, data in C.encoded(columns, counts, 4)) < 60_000 * 8.5  # 9 and more as pairs of ids with a count


def test_memory_of_a_shards_filters():
    """A shard's phrases take their ids (16 bytes each) and the filters' bytes, and not several sorted copies of all."""
    seen = np.random.default_rng(3).integers(1, 3000, 600_000).astype(np.uint32)
    starts = np.arange(len(seen) - 4, dtype=np.uint32)
    tracemalloc.start()
    rows = C.filters(0, "en", seen, starts, 4, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows["n"].sum() == len(starts) and peak < 45 * len(starts), peak / len(starts)
