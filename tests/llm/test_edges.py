"""Repeated ids, clashing names, large ids and long texts, and brute-force versions of what SQL cannot say."""

import base64
import collections
import hashlib
import html.parser
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cadenza.llm import bpe, html_text, language, media, mixing, near_dup, quality_rules, quotes, rule_ensemble, substring_dup

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")]
CLASHES = ["_id", "_words", "_lines", "_n", "_x", "_digest", "_item", "_language", "_size", "_copies", "_part", "_spans", "number", "part", "unit", "body", "node", "several", "key", "kind", "position", "digest", "score_", "_again", "_before"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like the helpers of every operator."""
    shared = prose(5, 70)
    docs = documents(spark, [(i, f"{prose(i, 90)} {shared if i < 3 else ''}") for i in range(12)] + [(20, prose(1, 90) + " "), (21, None)])
    for name in CLASHES:
        docs = docs.withColumn(name, docs["doc_id"] * 10)
    return docs


@pytest.mark.parametrize("step", [
    lambda d: quality_rules.cascade(d), lambda d: language.predict(d, language.train(d.select("text", "lang"))), lambda d: media.interleave(d.withColumnRenamed("text", "html")),
    lambda d: near_dup.link(d), lambda d: rule_ensemble.score(d, rule_ensemble.fit(d, d.selectExpr("doc_id", "doc_id % 2 AS label"))), lambda d: bpe.encode_table(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    lambda d: substring_dup.remove(d), lambda d: html_text.extract(d, "text", "main"), lambda d: mixing.take(d),
])
def test_clashing_columns(clashing, step):
    out = step(clashing)
    carried = [c for c in CLASHES if c in out.columns]
    rows = out.collect()
    assert rows
    if len(out.columns) > 6:
        own = {"position", "kind", "digest"} if "caption" in out.columns else set()
        assert set(CLASHES) - own <= set(carried)
        assert all(r[c] == r["doc_id"] * 10 for r in rows for c in carried if c not in own)


def test_clashing_columns_of_messages(spark):
    talks = spark.createDataFrame([(1, 0, "u", "hello you", 5, 6), (1, 1, "u", "> hello you\nfine", 5, 6)], "conv_id long, turn int, role string, text string, _turn int, hash int")
    assert {r["turn"]: r["parent_turn"] for r in quotes.link(talks).collect()} == {0: -1, 1: 0}


def test_clashing_columns_in_the_pipeline(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == clashing.columns, name
        path = f"{tmp_path}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("round_trip").count() == docs.count()


def test_near_dup_of_repeated_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a), (5, a), (5, b), (9, b), (None, a), (11, prose(3, 60))]
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.link(documents(spark, rows)).collect()), key=str)
    assert found == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (None, None, True), (11, 11, True)], key=str)


def test_near_dup_in_a_crowd_below_the_threshold(spark):
    """Documents of one template that are not similar enough to each other, with planted links, against all pairs."""
    form, draw, rows = prose(7, 150).split(), random.Random(4), []
    for i in range(700):
        own = list(form)
        for k in draw.sample(range(150), 6):
            own[k] = f"fill{i}x{k}"
        rows.append((i, " ".join(own)))
    for i in range(0, 300, 2):
        own = rows[i][1].split()
        own[draw.randrange(150)] = f"planted{i}"
        rows.append((1000 + i, " ".join(own)))
    shingles = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in shingles}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(shingles)
    links = 0
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            both = len(shingles[x] & shingles[y])
            if 100 * both >= 85 * (len(shingles[x]) + len(shingles[y]) - both):
                links += 1
                p, q = sorted((top(x), top(y)))
                root[q] = p
    assert links >= 150
    assert {r["doc_id"]: r["component_id"] for r in near_dup.link(documents(spark, rows), words=3, percent=85).collect()} == {i: top(i) for i in ids}


def test_passages_of_repeated_ids(spark):
    shared, long = prose(50, 90), prose(51, 300)
    rows = [(5, f"{long} {shared}"), (5, "tiny text"), (7, f"{prose(8, 20)} {shared}"), (7, ""), (7, None)]
    found = {(r["doc_id"], r["first_doc_id"]) for r in substring_dup.repeats(documents(spark, rows)).collect()}
    assert found == {(7, 5)}
    one, two = prose(60, 100), prose(61, 40)
    rows = [(1, one), (8, one), (8, f"{two} {shared}"), (2, f"{prose(62, 45)} {shared}")]
    found = sorted((r["doc_id"], r["start_word"] <= 45, r["end_word"], r["first_doc_id"]) for r in substring_dup.repeats(documents(spark, rows)).collect())
    assert found == [(8, True, 100, 1), (8, True, 130, 2)]
    left = sorted(r["text"] for r in substring_dup.remove(documents(spark, rows)).collect())
    assert len(left) == 3 and one in left and any(t.strip() == two or t.split() == two.split() for t in left)


def test_passages_against_all_windows(spark):
    """Each run of 50 words that an earlier document has is within a span, and nothing is reported without one similar enough."""
    draw, rows = random.Random(9), []
    pool = [prose(900 + k, draw.randint(50, 90)) for k in range(25)]
    for i in range(200):
        rows.append((i, " ".join([prose(i, draw.randint(5, 60)), draw.choice(pool), prose(3000 + i, draw.randint(5, 60)), *([draw.choice(pool)] if i % 3 else []), prose(4000 + i, 5)])))
    spans = collections.defaultdict(list)
    for r in substring_dup.repeats(documents(spark, rows)).collect():
        spans[r["doc_id"]].append((r["start_word"], r["end_word"]))
    first = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k : k + 50]), i)
    missed = wanted = 0
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < i:
                wanted += 1
                covered = [any(a <= w < b for a, b in spans[i]) for w in range(k, k + 50)]
                missed += not all(covered)
    assert wanted > 1000 and missed == 0


def test_large_ids_beside_null(spark):
    base = 1 << 60
    rows = [(base + i, prose(i, 20 + i)) for i in range(1, 51)] + [(None, prose(99, 30))]
    found = [r["doc_id"] for r in mixing.mix(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted((i for i, _ in rows), key=str)
    assert {r["doc_id"] for r in near_dup.link(documents(spark, rows)).collect()} == {i for i, _ in rows}


def test_mix_of_equal_rows(spark):
    rows = [(1, "a b c d")] * 500 + [(i, prose(i, 4)) for i in range(2, 200)]
    docs = documents(spark, rows).repartition(5)
    made = mixing.mix(docs).where("doc_id = 1").collect()
    assert sorted(r["number"] for r in made) == list(range(500)) and {r["copies"] for r in made} <= {1, 2}
    assert mixing.take(docs).where("doc_id = 1").count() == sum(r["copies"] for r in made)


def test_long_texts(spark):
    """40,000 words: counts, tokens and shingles of the whole text."""
    text = prose(3, 40_000)
    rows = [(1, text), (2, text + " end"), (3, text.replace(text.split()[20_000], "other", 3))]
    docs = documents(spark, rows)
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.statistics(docs).collect()} == {1: 40_000, 2: 40_001, 3: len(rows[2][1].split())}
    words = text.split()
    sets = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.link(docs).collect()}
    assert sets[1] == (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 1) and sets[2][1] == sets[3][1] == 1


def test_hashes_do_not_depend_on_blocks():
    from cadenza.llm import _shingles

    words = prose(1, 3000).split() + ["x" * 300_000, "y", "z" * 300_000] + prose(2, 100_000).split()
    whole, _ = _shingles.hash_words(" ".join(words).encode())
    alone = {w: _shingles.hash_words(f"  {w}".encode())[0][0] for w in set(words)}
    assert whole.tolist() == [alone[w] for w in words]


def test_bpe_query(spark, tmp_path):
    rows = [(i, prose(i, 40)) for i in range(20)] + [(30, None), (31, ""), (32, "é日本\n\n  x🙂"), (33, prose(1, 9_500))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op8_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = other.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert found[i] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def kneser_ney(texts, order, discount):
    """Interpolated Kneser-Ney by plain dictionaries: probability of a character after a context."""
    counts = collections.Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    letters = len(tables[1])

    def p(gram):
        if not gram:
            return 1 / (letters + 1)
        table, context = tables[len(gram)], gram[:-1]
        total = sum(v for g, v in table.items() if g[:-1] == context)
        if not total:
            return p(gram[1:])
        kinds = sum(1 for g in table if g[:-1] == context)
        return max(table.get(gram, 0) - discount, 0) / total + discount * kinds / total * p(gram[1:])

    return p, counts


def test_kneser_ney_by_dictionaries():
    import pandas as pd

    texts = [" " + prose(k, 30) for k in range(3)]
    p, counts = kneser_ney(texts, 4, language.DISCOUNT)
    model = language.build(pd.DataFrame([("x", g, n) for g, n in counts.items()], columns=["lang", "gram", "n"]), ["x"])
    for text in (texts[0][:60], " bano dulk zzz qan"):
        want = [math.log(p(text[max(0, i - 3) : i + 1])) for i in range(len(text))]
        got = model.score(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))[0]
        assert np.allclose(got[3:], want[3:], atol=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(f"{'abc' * 30} {i}", "aa") for i in range(80)] + [("xyz " * 40, "bb")]
    assert language.train(spark.createDataFrame(rows, "text string, lang string")).languages == ["aa", "bb"]


def test_rules_evaluated_by_hand(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(prose(i, 5) + draw.choice(["", "!!", " ###", ","]) for _ in range(draw.randint(1, 9)))) for i in range(300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int("###" not in t)) for i, t in rows], "doc_id long, label int")
    model = rule_ensemble.fit(docs, labels)
    x = {r["doc_id"]: r["_x"] for r in rule_ensemble.statistics(docs).collect()}
    for r in rule_ensemble.score(docs, model).collect():
        total = model.base
        for rule, weight in model.weights.items():
            if all(x[r["doc_id"]][i] <= v if side == "<=" else x[r["doc_id"]][i] > v for i, side, v in rule.bounds):
                total += weight
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


PARAGRAPHS = "<p>A first paragraph, with a comma, and a second one.</p>" * 6


@pytest.mark.parametrize("page", [
    f"<div class='{name}'>{PARAGRAPHS}</div>" for name in ("content has-sidebar", "page no-sidebar", "post with-comments", "social-science", "share-price-report")
] + [f"<div class='layout sidebar-left'><main>{PARAGRAPHS}</main></div>", f"<div class='widget-area'><article>{PARAGRAPHS}</article></div>"])
def test_named_wrappers_keep_their_text(page):
    assert html_text.main_text(f"<body>{page}</body>").count("first paragraph") == 6


LINKS = "<div><a href=1>Home</a><a href=2>News of today</a><a href=3>Weather</a></div>" * 4
PLAIN = f"<body>{LINKS}<div>Login here</div><h1>Title of it</h1>{PARAGRAPHS}<ul><li>one item<li>two</ul>{PARAGRAPHS}{LINKS}<div>Copyright us</div></body>"


def test_ratios_choose_the_content():
    text = html_text.main_text(PLAIN)
    assert text.startswith("Title of it\n") and text.count("first paragraph") == 12 and "one item\ntwo" in text
    assert not any(x in text for x in ("Home", "Weather", "Login", "Copyright"))


def test_ratios_cannot_be_left_out(monkeypatch):
    monkeypatch.setattr(html_text, "content_paths", lambda found, wrappers: {(x.path, not wrappers.issuperset(x.around)): 1.0 for x in found if x.text.strip()})
    assert "Home" in html_text.main_text(PLAIN)


def test_ratios_by_hand():
    """Length and punctuation of each path by the standard library's parser, smoothed and fused."""

    class Reader(html.parser.HTMLParser):
        path, held = [], {}

        def handle_starttag(self, tag, attrs):
            self.path.append(tag)

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, data):
            if data.strip():
                row = self.held.setdefault(tuple(self.path), [0, 0, 0])
                for i, v in enumerate((len(data.strip()), 1 + sum(c in ".,;:!?" for c in data), 1)):
                    row[i] += v

    page = f"<body><div><a>Home</a><a>News</a></div><section><h2>Head</h2>{PARAGRAPHS}<p>More, <b>bold</b> text.</p></section><div>End.</div></body>"
    Reader().feed(page)
    paths = list(Reader.held)
    smooth = lambda v: [0.25 * v[max(i - 1, 0)] + 0.5 * v[i] + 0.25 * v[min(i + 1, len(v) - 1)] for i in range(len(v))]
    fused = [a * b for a, b in zip(smooth([Reader.held[p][0] / Reader.held[p][2] for p in paths]), smooth([Reader.held[p][1] / Reader.held[p][2] for p in paths]))]
    bound = min(float(np.std(fused)), max(fused) / 2)
    found, _ = html_text.leaves(page)
    got = html_text.content_paths(found, set())
    assert {p: round(v, 6) for (p, _), v in got.items()} == {p: round(v, 6) for p, v in zip(paths, fused) if v >= bound}


LONG = "<p>A long paragraph of the article, with commas, clauses, and a full stop; it goes on for a while, as they do, to tell the reader what there is to be told.</p>" * 4


@pytest.mark.parametrize("name", ["discussion", "reactions", "c-42"])
def test_reader_comments_without_a_known_name(name):
    said = "".join(f"<div class=x><p>{who}</p><p>{text}</p></div>" for who, text in (("Ann", "Great article, thanks!"), ("Bob", "I agree."), ("Eve", "Me too, well put.")))
    page = f"<body><article><h1>Title</h1>{LONG}<ul><li>one item<li>two</ul><p>The end.</p><section class={name}><h2>Comments</h2>{said}</section></article></body>"
    text = html_text.main_text(page)
    assert text.split("\n")[-3:] == ["one item", "two", "The end."] and text.count("long paragraph") == 4
    short = f"<body><article><h1>Title</h1>{LONG}<section class={name}><h2>Comments</h2><p>Great article, thanks!</p></section></article></body>"
    assert html_text.main_text(short).count("\n") == 4


def test_links_inside_the_article():
    links = "".join(f"<li><a href={i}>Another story number {i}</a></li>" for i in range(4))
    text = html_text.main_text(f"<body><article><h1>Title</h1>{LONG}<ul class=more>{links}</ul>{LONG}</article></body>")
    assert text.count("long paragraph") == 8 and "Another story" not in text


def test_named_paragraphs_of_the_article():
    page = f"<body><article>{LONG}<p class='share-of-voice'>Their share of voice grew.</p><p class='share'>Tell your friends</p><p class='cookie-notice'>We use cookies.</p>{LONG}</article></body>"
    text = html_text.main_text(page)
    assert "Their share of voice grew." in text and "friends" not in text and "cookies" not in text


def test_plain_paragraphs_after_emphasised_ones():
    long = LONG.replace("<p>", "<p><b>").replace("</p>", "</b></p>")
    for tag in ("div", "article"):
        text = html_text.main_text(f"<body><nav>Home</nav><{tag}><h1>Title of it</h1>{long}<p>Of, edti oner.</p></{tag}><footer>(c)</footer></body>")
        assert text.split("\n")[-1] == "Of, edti oner." and text.count("long paragraph") == 4


@pytest.mark.parametrize("runs", [[80, 87, 94, 101, 108, 115], [400, 80, 60, 700, 55], [50, 1000, 50, 120, 51, 999]])
def test_runs_of_one_repeated_word(spark, runs):
    """Each word that stands in 50 equal words of an earlier document is covered, and no other."""
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + ["word"] * n + [f"z{i}x{k}" for k in range(30)])) for i, n in enumerate(runs)]
    found = substring_dup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {i: set() for i in range(len(runs))}
    for r in found:
        assert r["first_doc_id"] < r["doc_id"]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    for i, n in enumerate(runs):
        assert covered[i] == (set(range(30, 30 + n)) if i else set()), (i, n, min(covered[i], default=None), max(covered[i], default=None))
