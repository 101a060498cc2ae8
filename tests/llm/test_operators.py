"""The operators against brute-force versions on small fixtures, with their defined edge cases."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cadenza.llm import _graph, bpe, html_text, language, media, mixing, near_dup, quality_rules, queries, quotes, rule_ensemble, substring_dup

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ",", "."]) for _ in range(n))


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


EDGES = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b"),
    (None, "no id at all", "en", None), (6, prose(1, 3000), "de", "a"), (7, prose(2, 80), "en", "b"), (8, "x " * 400, "en", "a"), (9, "日本語 テキスト é", "fr", "b"),
]


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    docs = documents(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>a &amp; b"), (3, "u", "<p>a &amp; b")], "page_id long, url string, html string")
    talks = spark.createDataFrame([(1, 0, "user", None), (None, 0, None, "> a"), (1, 1, "user", "")], "conv_id long, turn int, role string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.5], 0), (2, None, 0), (3, [], None), (3, [0.0, 0.0, 0.0], 1), (None, [1.0, None, 0.5], 1), (4, [2.0, 0.0, 1.0], 1), (5, [1.0, float("nan"), 0.0], 1)], EMBEDDINGS)
    return folder(spark, path, documents=docs, labels=none, pages=pages, conversations=talks, embeddings=vectors)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    return folder(
        spark, path, documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        pages=spark.createDataFrame([], "page_id long, url string, html string"), conversations=spark.createDataFrame([], "conv_id long, turn int, role string, text string"),
        embeddings=spark.createDataFrame([], EMBEDDINGS),
    )


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_edge_rows(spark, edge_dir, name):
    n = queries.queries()[name](spark, edge_dir).count()
    if name == "op10_html_extraction":
        assert n == 4
    elif name == "op4_quote_links":
        assert n == 3
    elif name == "op12_embedding_near_dup":
        assert n == 7
    elif name not in ("op9_substring_dup", "op13_collocations", "pipeline"):
        assert n == len(EDGES)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).count() == 0


def test_bpe_equals_tiktoken():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.vocabulary(path, public_tokenizers.PATTERN)
    draw = random.Random(3)
    texts = ["", "a" * 900, " " * 300, "<|endoftext|>", "it's\r\n\x85\x1c ok"]
    texts += ["".join(draw.choice("ab eéñ\n\tsredth12日!?🙂　") for _ in range(draw.randint(1, 80))) for _ in range(800)]
    texts += ["".join(draw.choice(["th", "er", "ing", "in", "an", "on"]) for _ in range(draw.randint(1, 50))) for _ in range(400)]
    for text in texts:
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        own.decode((60_000).to_bytes(4, "little"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name, tmp_path):
    """Queries with a SQL form, on the edge rows and on text with repeats."""
    rows = [r for r in EDGES if r[0] is not None and r[0] != 5] + [(20 + i, " ".join([prose(i, 12)] * (i + 1)) + "\nline of it\nline of it\n- x...", "en", "a") for i in range(6)]
    rows += [(40 + i, prose(77, 60) + f" tail{i}", "en", "a") for i in range(5)]
    talks = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\nFine.\n> How are you?\nOK"), (1, 2, "user", "On Monday X wrote:\n>> Hello there.\n> Fine.\nGreat"), (1, 3, "user", "> Great\n> ?\n\nYes"), (2, 0, "user", "> alone"), (2, 1, "user", None)]
    draw = np.random.default_rng(8)
    vectors = [(i, (draw.normal(size=16) * 0.1 + np.eye(16)[i % 9]).tolist(), 0) for i in range(60)] + [(90, [0.0] * 16, 1), (91, None, 1)]
    d = folder(spark, tmp_path, documents=documents(spark, rows), conversations=spark.createDataFrame(talks, "conv_id long, turn int, role string, text string"), embeddings=spark.createDataFrame(vectors, EMBEDDINGS))
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, d)
    found = con.execute(queries.oracle_sql()[name])
    order = [[x[0] for x in found.description].index(c) for c in sorted(df.columns)]
    assert sorted(repr([r[i] for i in order]) for r in found.fetchall()) == sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())


def test_rules_keep_their_verdict_in_any_order(spark):
    docs = documents(spark, EDGES)
    counted = quality_rules.statistics(docs)
    rules = quality_rules.default_rules(counted["text"])
    some = [tuple(r) for r in counted.select(quality_rules.verdict(rules, list(rules)).isNull()).collect()]
    assert some == [tuple(r) for r in counted.select(quality_rules.verdict(rules, list(rules)[::-1]).isNull()).collect()]
    assert quality_rules.ordered({"a": (2.0, 0.5), "b": (1.0, 0.5), "c": (1.0, 0.0)}) == ["b", "a", "c"]


def test_language(spark):
    kinds = {"aa": "abcde", "bb": "vwxyz", "cc": "aeiou"}
    draw = random.Random(1)
    rows = [(i, " ".join("".join(draw.choice(kinds[k]) for _ in range(4)) for _ in range(60)), k, "s") for i, k in enumerate(list(kinds) * 40)]
    model = language.train(documents(spark, rows).select("text", "lang"))
    assert model.languages == sorted(kinds)
    found = model.predict([t for _, t, _, _ in rows] + [None, "", "12 !", "жщюф " * 60])
    assert list(found["lang_pred"][: len(rows)]) == [k for _, _, k, _ in rows]
    assert list(found["lang_pred"][len(rows) : len(rows) + 3]) == ["und"] * 3
    assert not found["rejected"][: len(rows)].any() and found["rejected"][len(rows) :].all()
    assert found["score"].between(0, 1).all()


def test_kneser_ney_sums_to_one():
    import numpy as np
    import pandas as pd

    codes = [a + b for a in "ab " for b in "ab "]
    model = language.build(pd.DataFrame({"lang": "x", "gram": codes[:7], "n": range(1, 8)}), ["x"], order=2)
    for context in "ab":
        total = sum(float(np.exp(model.score(np.array([ord(context), ord(c)], np.uint32), np.array([0, 2]))[0][1])) for c in "ab ")
        unseen = float(np.exp(model.score(np.array([ord(context), ord("q")], np.uint32), np.array([0, 2]))[0][1]))
        assert abs(total + unseen - 1) < 1e-5


def test_media_round_trip(spark, edge_dir):
    rows = {(r["doc_id"], r["media_sha256"]): r for r in media.op5_media_columns(spark, edge_dir).collect()}
    for i, text, _, _ in EDGES:
        raw = (text or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = b"P5\n64 %d\n255\n" % (len(pay) // 64) + pay
        r = rows[i, hashlib.sha256(stored).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(stored))


def test_interleaved_items():
    page = '<p>a &amp; b<b>c</b></p><figure><img src="sha256:AB" alt="z"><video src=q.mp4></video><figcaption>cap <i>x</i></figcaption></figure>tail<script>x<img src=n></script><img alt="k" src="d">'
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.items(page)] == [
        (0, "text", "a & bc", None, None), (1, "media", None, "ab", "cap x"), (2, "media", None, "q.mp4", "cap x"), (3, "text", "tail", None, None), (4, "media", None, "d", "k"),
    ]
    assert media.items(None) == media.items("") == []


def sets_of(rows, n):
    out = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def test_near_dup_crowds(spark):
    """A crowd of near copies and one of exact copies, against all pairs."""
    base, draw, rows = prose(9, 200).split(), random.Random(2), []
    for i in range(70):
        own = list(base)
        for _ in range(3):
            own[draw.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(own), "en", "a"))
    rows += [(100 + i, prose(5, 90), "en", "a") for i in range(60)] + [(200 + i, prose(300 + i, 90), "en", "a") for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in near_dup.link(documents(spark, rows), words=5, percent=80).collect()}
    sets, root = sets_of(rows, 5), {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert found == {i: top(i) for i in sets}


def test_components_of_long_paths(spark):
    """Paths of several hundred nodes: in random order, and with the smallest at the far end."""
    draw = random.Random(1)
    paths = [draw.sample(range(1000, 1400), 400), [*range(2001, 2200), 2000], draw.sample(range(5000, 5200), 200)]
    links = spark.createDataFrame([(a, b) for p in paths for a, b in zip(p, p[1:])], "a long, b long")
    found = {r["node"]: r["component"] for r in _graph.components(links).collect()}
    assert found == {i: min(p) for p in paths for i in p}


def test_near_dup_in_a_large_region(spark):
    """Pairs at the threshold among 1200 documents of one template that are nearly similar to each other."""
    form, draw, rows = prose(77, 260).split(), random.Random(6), []
    for i in range(1100):
        own = list(form)
        for k in draw.sample(range(260), 6):
            own[k] = f"fill{i}x{k}"
        rows.append((i, " ".join(own), "en", "a"))
    for i in range(100):
        own = rows[i][1].split()
        for k in draw.sample(range(260), 5):
            own[k] = f"other{i}x{k}"
        rows.append((5000 + i, " ".join(own), "en", "a"))
    sets, root = sets_of(rows, 5), {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, own in sets.items():
        for g in own:
            held.setdefault(g, []).append(i)
    place = {i: k for k, i in enumerate(sets)}
    sizes, both = np.array([len(x) for x in sets.values()]), np.zeros((len(sets), len(sets)), int)
    for docs in held.values():
        at = [place[i] for i in docs]
        both[np.ix_(at, at)] += 1
    links = [(a, b) for a, b in zip(*np.nonzero(100 * both >= 82 * (sizes[:, None] + sizes - both))) if a < b]
    assert len(links) >= 100
    ids = list(sets)
    for a, b in links:
        x, y = sorted((top(ids[a]), top(ids[b])))
        root[y] = x
    found = {r["doc_id"]: r["component_id"] for r in near_dup.link(documents(spark, rows), words=5, percent=82).collect()}
    assert found == {i: top(i) for i in sets}


def test_quality_classifier(spark):
    good = [(i, prose(i, 120), "en", "a") for i in range(150)]
    bad = [(1000 + i, " ".join(f"{w}###" for w in prose(i, 60).split()), "en", "a") for i in range(80)]
    docs = documents(spark, good + bad + EDGES)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good[:100] + bad[:50]] + [(None, 1), (3, None), (99999, 0)], "doc_id long, label int")
    model = rule_ensemble.fit(docs, labels)
    assert model.weights and all(str(r) for r in model.weights)
    scores = {r["doc_id"]: r["score"] for r in rule_ensemble.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert all(scores[r[0]] >= 0.7 for r in good) and all(scores[r[0]] < 0.7 for r in bad)
    assert rule_ensemble.fit(docs, labels.where("label = 1")).weights == {}


def test_compact_windows_hold_every_passage():
    import numpy as np

    hashes = np.random.default_rng(4).integers(0, 50, 120).astype(np.uint64)
    windows = substring_dup.compact_windows(hashes, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            centre = i + int(hashes[i : j + 1].argmin())
            assert sum(a <= i and j <= b and c == centre for a, c, b in windows) == 1


def test_repeated_passages(spark):
    shared, rows = prose(50, 90), []
    for i in range(12):
        rows.append((i, f"{prose(100 + i, 70)} {shared if i % 3 == 0 else ''} {prose(200 + i, 60)}", "en", "a"))
    rows += [(50, prose(1, 100), "en", "a"), (51, prose(1, 100), "en", "a"), (52, prose(60, 49), "en", "a"), (53, prose(61, 49), "en", "a"), (None, shared, "en", "a"), (54, None, "en", "a"), (55, "", "en", "a")]
    found = {(r["doc_id"], r["first_doc_id"]): (r["start_word"], r["end_word"]) for r in substring_dup.repeats(documents(spark, rows)).collect()}
    assert set(found) == {(3, 0), (6, 0), (9, 0), (51, 50)}
    for i in (3, 6, 9):
        start, end = found[i, 0]
        assert start <= 70 and end >= 160 and end - start < 95
    left = {r["doc_id"]: r["text"] for r in substring_dup.remove(documents(spark, rows)).collect()}
    assert 51 not in left and shared in left[0] and shared not in left[3] and left[1] == rows[1][1] and left[54] is None
    assert len(left[3].split()) >= 125


def five_words(words):
    (_, hashes, _), *_ = substring_dup._shingles.documents([" ".join(words)], lower=True)
    return substring_dup._shingles.shingle(hashes, 5)


def test_passages_with_changed_words():
    """One changed word at every place, and two at many, against the similarity of the planted passages."""
    tried = 0
    for n in (50, 55, 60, 75, 85, 100):
        core = prose(n, n).split()
        before, after = prose(1000 + n, 37).split(), prose(2000 + n, 41).split()
        for changed in [(i,) for i in range(n)] + [(i, j) for i in range(0, n, 4) for j in range(i + 1, n, 5)]:
            other = [f"new{i}" if i in changed else w for i, w in enumerate(core)]
            sets = sets_of([(0, " ".join(core)), (1, " ".join(other))], 5)
            if len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]):
                continue
            same = [i for i in range(n - 4) if not any(i <= c < i + 5 for c in changed)]
            anchor = random.Random(n).choice(same)
            spans = substring_dup.passages(five_words(before + core + after), five_words(after + other + before), np.array([37 + anchor]), np.array([41 + anchor]))
            assert any(p <= 37 + same[0] and q >= 37 + same[-1] + 5 and r <= 41 + same[0] and s >= 41 + same[-1] + 5 and min(q - p, s - r) >= 50 for p, q, r, s in spans), (n, changed)
            tried += 1
    assert tried > 800


def test_changed_word_in_repeated_passages(spark):
    """A word changed in the middle of passages of 60 and 85 words, through the query."""
    rows = []
    for k, n in enumerate((60, 85, 60, 85, 100)):
        core = prose(700 + k, n).split()
        other = [*core[: n // 2], "changed", *core[n // 2 + 1 :]]
        rows += [(2 * k, f"{prose(800 + k, 30)} {' '.join(core)} {prose(810 + k, 30)}", "en", "a"), (2 * k + 1, f"{prose(820 + k, 30)} {' '.join(other)} {prose(830 + k, 30)}", "en", "a")]
    found = {(r["doc_id"], r["first_doc_id"]): (r["start_word"], r["end_word"]) for r in substring_dup.repeats(documents(spark, rows)).collect()}
    assert set(found) == {(2 * k + 1, 2 * k) for k in range(5)}
    assert all(start <= 30 and end >= 30 + n for (start, end), n in zip([found[2 * k + 1, 2 * k] for k in range(5)], (60, 85, 60, 85, 100)))


def test_equal_passages_of_one_template(spark):
    """Two copies of each filled-in passage of a template: every second one repeats its own first one."""
    form, rows = prose(40, 60).split(), []
    for i in range(300):
        own = [f"{w}{i}" if k % 20 == 7 else w for k, w in enumerate(form)]
        for j in (i, 1000 + (i * 7) % 300):
            rows.append((j, f"{prose(5000 + j, 20)} {' '.join(own)} {prose(7000 + j, 20)}", "en", "a"))
    found = substring_dup.repeats(documents(spark, rows)).collect()
    whole = {(r["doc_id"], r["first_doc_id"]) for r in found if r["start_word"] <= 20 and r["end_word"] >= 80}
    assert {(1000 + (i * 7) % 300, i) for i in range(300)} <= whole


def test_windows_of_many_texts_at_once():
    """Windows between places that hold 0 are those of each stretch by itself."""
    import numpy as np

    draw = np.random.default_rng(12)
    hashes = draw.integers(1, 60, 2000).astype(np.uint64)
    ends = np.sort(draw.choice(2000, 25, replace=False))
    hashes[ends] = 0
    found = set(zip(*(x.tolist() for x in substring_dup.windows_between(hashes, 10))))
    own = set()
    for lo, hi in zip([0, *(ends + 1)], [*ends, 2000]):
        for i in range(lo, hi):
            for j in range(i + 9, hi):
                centre = i + int(hashes[i : j + 1].argmin())
                own.add((i, centre, j))
    assert all(sum(a <= i and j <= b and c == centre for a, c, b in found) == 1 for i, centre, j in draw.permutation(sorted(own))[:1500].tolist())
    assert found <= own


def test_pairs_of_repeated_words_without_a_passage_are_told_apart():
    """Texts of words that are each repeated 30 times, with an order of their own, share runs of 20 words and no passage: told by their outlines. No pair with a passage is left out."""
    import numpy as np

    draw, texts = random.Random(3), []
    words = [f"w{k}" for k in range(12)]
    for _ in range(40):
        own = [w for w in draw.sample(words, 8) for _ in range(30)]
        texts.append(five_words(own if draw.random() < 0.7 else [*own, *["long"] * draw.choice([45, 60])]))
    texts += [five_words(prose(90, 120).split()), five_words([*prose(91, 20).split(), *prose(90, 120).split()[:70]])]
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    may = substring_dup.plausible([substring_dup.outline(a) for a, _ in pairs], [substring_dup.outline(b) for _, b in pairs])
    held = []
    for a, b in pairs:
        xs, ys = np.nonzero(a[:, None] == b[None, :])
        held.append(bool(len(xs)) and bool(substring_dup.passages(a, b, xs[::7], ys[::7])))
    assert 10 < sum(held) <= sum(may) < len(pairs) / 2
    assert all(m for m, h in zip(may.tolist(), held) if h)


def test_similar_passages_in_large_groups(spark):
    """Two passages with one word changed in the middle, all of whose shingles stand in a crowd of earlier, unlike passages too."""
    form, rows, draw = prose(41, 60).split(), [], random.Random(5)
    text = lambda j, words: (j, f"{prose(5000 + j, 20)} {' '.join(words)} {prose(7000 + j, 20)}", "en", "a")
    for i in range(60):
        changed = {draw.randint(5, 12), draw.randint(18, 26), draw.randint(30, 38), draw.randint(44, 52)}
        rows.append(text(i, [f"{w}{i}" if k in changed else w for k, w in enumerate(form)]))
    rows += [text(100, form), text(101, [*form[:30], "changed", *form[31:]]), text(102, [*form[:26], "other", *form[27:]])]
    found = {(r["doc_id"], r["first_doc_id"]): (r["start_word"], r["end_word"]) for r in substring_dup.repeats(documents(spark, rows)).collect()}
    assert {(101, 100), (102, 100)} <= set(found)
    assert all(found[d, 100][0] <= 20 and found[d, 100][1] >= 80 for d in (101, 102))


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice">We use cookies, friend.</div><article><h1>Head&eacute;r  one</h1><p>First paragraph, with <b>bold</b> text<br>and a break.<p>Second&nbsp;one &lt;x&gt;.</p>
    <aside class="related">More, more.</aside><form><input><button>Go</button></form><ul><li>item one<li>item two</ul><section id="comments"><p>Nice read, thanks!</p></section></article>
    <div class="sidebar">Links here.</div><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Headér one\nFirst paragraph, with bold text and a break.\nSecond one <x>.\nitem one\nitem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."
    body = "".join(f"<p>Sentence number {i}, which says something of use.</p>" for i in range(6))
    assert html_text.main_text(f"<div class=menu><a>x</a></div><div id=content>{body}</div><div class=footer>(c)</div>").count("\n") == 5


def test_html_wrappers_and_several_articles():
    one, two = "<p>A first paragraph, with a comma, and a second one.</p>" * 6, "<p>Another part of the page, with its own text, here.</p>" * 4
    for name in ("site no-sidebar", "content has-sidebar", "elementor-widget widget"):
        text = html_text.main_text(f"<body><div class='{name}'><nav>x</nav><div class=post>{one}</div><div class=sidebar>Links here.</div></div></body>")
        assert text.count("first paragraph") == 6 and "Links" not in text
    text = html_text.main_text(f"<body><main><article>{one}</article><article>{two}</article></main><div class=sidebar>Links here.</div></body>")
    assert text.count("first paragraph") == 6 and text.count("Another part") == 4 and "Links" not in text


def test_mix(spark):
    draw = random.Random(6)
    rows = [(i, prose(i, draw.randint(1, 300)), "en", "abcde"[i % 5] if i % 11 else None) for i in range(900)] + [(5000, "w " * 9000, "en", "c"), (5001, None, "en", "z")]
    docs = documents(spark, rows)
    first = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], (3, 1, 2) * 3))
    goal, full = {}, set()
    while True:  # the excess goes round until no source is above its limit
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        goal = {s: 2 * sizes[s] if s in full else rest * weights[s] / sum(weights[t] for t in sizes if t not in full) for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = {}
    for doc_id, source, size, number, source_size, target, copies, words in first:
        assert source_size == sizes[source] and abs(target - goal[source]) < 1e-6 * max(1, target) and words == copies * size <= 2 * size
        taken[source] = taken.get(source, 0) + words
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(3, 0.002 * goal[s])
    assert mixing.take(docs).count() == sum(r[6] for r in first)


def test_quotes_of_a_long_thread(spark):
    rows = [(1, 0, "u", "start of it")] + [(1, i, "u", f"> {'start of it' if i == 1 else f'answer {i - 1}'}\nanswer {i}") for i in range(1, 40)]
    found = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert all(found[i]["parent_turn"] == i - 1 and found[i]["depth"] == i and found[i]["thread_turn"] == 0 for i in range(1, 40))
    assert found[7]["text"] == "answer 7"


def test_no_query_names_a_sample():
    import inspect

    for module in (bpe, html_text, media, mixing, near_dup, quotes, substring_dup):
        assert not re.search(r"\.sample\(|\.limit\((?!rows \+ 1)", inspect.getsource(module))
