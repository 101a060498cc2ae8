"""Main text of web pages by tag-path ratios.

Each page is parsed into leaves: runs of text with their root-to-leaf tag path and the block that
they stand in. For each path of a page, text length, punctuation and the number of leaves are summed.
A path's ratio is its length per leaf; its punctuation ratio is its punctuation marks per leaf; both are
smoothed over the paths in page order and multiplied (fused), a path below an element whose name says that it stands
around the article gets a tenth of it, and paths above a threshold derived from their own spread are content.

Content paths decide what is taken: they vote for the element that holds most of their text (an article, if one holds
half). In an article all but the named parts around it and the parts beside it is the result; elsewhere, the leaves of content paths with what is
inside of them, the headings before, and what stands between them, lists of links excepted. A path is also content where that of its emphasised text is. A part
named as standing around the article stays only if its own path is content. A part beside the article is one of several blocks that is nothing but links, or, with no content path
(headings apart), mostly links or a section after the last content: reader comments are such, as long as they are shorter than the article's paragraphs.
Elements that are never content (navigation, scripts, forms, ...) are left out from the start. A name tells nothing about an element that holds most of
what the page has, nor about a paragraph, a heading or a cell unless half of the name's words are such.

Defined results: null, empty and text-free html give an empty text; unclosed, repeated and unknown tags
are taken as browsers do in simple cases; deep nesting and long pages are parsed whole, without
recursion; character references are decoded. Pages are independent, so repeated rows, null ids and
null urls don't matter; extract() keeps all columns of pages, and replaces one of the output's name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import small_batches, table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("p b i em strong span a font u h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head script style noscript template iframe textarea title nav footer aside form button select option menu dialog object embed svg canvas audio video input label search noembed noframes datalist".split())
#: Opening one of these ends an open paragraph; a list item, cell or row ends an earlier one of its kind.
ENDS_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "title"}
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words in a class, id or role that mark parts around the article.
WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|cookies?|consent|disqus|footer|gdpr|login|masthead|menu|modal|nav\w*|newsletter|notices?|"
    r"pagination|pager|popup|promo\w*|recommend\w*|related|replies|reply|responses|search|share|sharing|sidebar|signup|site-header|page-header|social|sponsor\w*|subscribe|"
    r"toolbar|widget|alert|complementary|contentinfo|navigation)"
)
AROUND = re.compile(rf"(?:^|\s)(?!(?:has|no|with|without)[_-])(?:[\w-]*[_-])?{WORDS}(?:[_-][\w-]*)?(?=\s|$)", re.IGNORECASE)
WORD = re.compile(WORDS, re.IGNORECASE)
#: What the fused ratio of paths below elements with such names is multiplied with.
NAMED_WEIGHT = 0.1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one piece of text, those that only emphasise, and those that hold parts.
TEXT_LEVEL = INLINE | frozenset("blockquote dd dt figcaption li pre q td th".split())
EMPHASIS = frozenset("b i em strong span font u".split())
PARTS = frozenset("div dl ol section ul".split())
KIND = re.compile(r"""\s(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?=[\s=/>]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.DOTALL)
PUNCTUATION = re.compile(r"""[.,;:!?…。，、；：！？¿¡]""")
SPACE = re.compile(r"\s+")


@dataclass
class Leaf:
    """A run of text: its path, the elements above it (innermost last), its block and its raw text."""

    path: tuple[str, ...]
    above: tuple[int, ...]
    block: int
    text: str
    never: bool
    around: tuple[int, ...]


def marked(names: str, mostly: bool) -> bool:
    """Whether one of the names marks a part around the article; mostly: only one half of whose words do."""
    if not AROUND.search(names):
        return False
    parts = [[bool(WORD.fullmatch(w)) for w in re.split(r"[_-]+", name)] for name in names.split() if AROUND.fullmatch(name)]
    return not mostly or any(2 * sum(p) >= len(p) for p in parts)


def leaves(page: str) -> tuple[list[Leaf], dict[int, str]]:
    """Leaves in page order, and the tag of each element. around: the elements above a leaf that are named so."""
    found: list[Leaf] = []
    tags: dict[int, str] = {}
    stack: list[tuple[str, int, bool, str, tuple[int, ...]]] = []  # tag, element, never content, name in paths, elements named so
    block, made, at = 0, 0, 0
    within: tuple[tuple[str, ...], tuple[int, ...]] | None = None

    def add(text: str, decode: bool = True) -> None:
        nonlocal within
        if not text:
            return
        if within is None:
            within = tuple(x[3] for x in stack), tuple(x[1] for x in stack)
        found.append(Leaf(*within, block, html.unescape(text) if decode and "&" in text else text, bool(stack and stack[-1][2]), stack[-1][4] if stack else ()))

    def close(n: int) -> None:
        nonlocal block, within
        if any(x[0] in BLOCK for x in stack[n:]):
            block += 1
        del stack[n:]
        within = None

    while at < len(page):
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        if cut > at:
            add(page[at:cut])
        m = TAG.match(page, cut)
        if not m:
            if re.match(r"</?[A-Za-z]", page[cut : cut + 3]):  # a tag that the page's end cuts off
                break
            add("<")
            at = cut + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"], decode=False)
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0 and (name in BLOCK or not any(x[0] in ("table", "article", "body", "td") for x in stack[depth + 1 :])):
                close(depth)
            elif name in ("p", "br"):
                block += name == "p"
                add(" ")
            continue
        rest = m["rest"]
        if name in ENDS_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "td", "button", "table", "article", "div", "section")), -1)
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        if name in SAME:
            kin = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in kin or stack[i][0] in SAME[name]), -1)
            if depth >= 0 and stack[depth][0] in kin:
                close(depth)
        if name in BLOCK:
            block += 1
        if name in VOID:
            if name in ("br", "hr"):
                add(" ")
            continue
        made += 1
        tags[made] = name
        kinds = [(k.lower(), a or b or c) for k, a, b, c in KIND.findall(rest)] if rest else []
        names = " ".join(v for _, v in kinds)
        around = bool(names and name not in ("body", "html", "main", "article") and marked(names, name in TEXT_LEVEL))
        inside = any(x[0] in ("article", "main") for x in stack)
        never = bool(stack and stack[-1][2]) or name in NEVER or (name == "header" and not inside) or bool(rest and HIDDEN.search(rest))
        style = next((v.split() for k, v in kinds if k == "class" and v.split()), [])
        if name in RAW and name != "noscript":
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            block += name in BLOCK
            continue
        if rest.rstrip().endswith("/") and name in ("svg", "path", "g", "use"):
            continue
        named = stack[-1][4] if stack else ()
        stack.append((name, made, never, f"{name}.{style[0]}" if style else name, (*named, made) if around else named))
        within = None
    return found, tags


def smooth(values: np.ndarray, weights: tuple[float, ...] = (0.25, 0.5, 0.25)) -> np.ndarray:
    """Weighted mean of each value with its neighbours in page order."""
    if len(values) < 3:
        return values
    padded = np.concatenate([values[:1], values, values[-1:]])
    return weights[0] * padded[:-2] + weights[1] * padded[1:-1] + weights[2] * padded[2:]


def outer(found: list[Leaf], tags: dict[int, str]) -> set[int]:
    """The elements named as parts around the article that hold at least half of the text that can be content (of that in
    article and main elements, where there are such), in two blocks or more: their names tell nothing, so that they are wrappers."""
    full = [(x, len(x.text.strip())) for x in found]
    inside = [(x, n) for x, n in full if n and any(tags[e] in ("article", "main") for e in x.above)]
    held: dict[int, int] = defaultdict(int)
    blocks: dict[int, set[int]] = defaultdict(set)
    total = 0
    for leaf, n in inside or full:
        total += n
        for element in leaf.around:
            held[element] += n
            if n:
                blocks[element].add(leaf.block)
    return {e for e, n in held.items() if 2 * n >= total and len(blocks[e]) > 1}


def content_paths(found: list[Leaf], wrappers: set[int]) -> dict[tuple[tuple[str, ...], bool], float]:
    """Fused ratio of the paths that pass the threshold. A path below an element named as standing around the article,
    wrappers excepted, is one of its own, marked True."""
    length: dict[tuple, float] = defaultdict(float)
    marks: dict[tuple, float] = defaultdict(float)
    nodes: dict[tuple, int] = defaultdict(int)
    for leaf in found:
        n = len(leaf.text.strip())
        if n:
            key = leaf.path, not wrappers.issuperset(leaf.around)
            length[key] += n
            marks[key] += len(PUNCTUATION.findall(leaf.text)) + 1
            nodes[key] += 1
    if not length:
        return {}
    paths = list(length)  # in page order
    ratio = smooth(np.array([length[p] / nodes[p] for p in paths]))
    pointed = smooth(np.array([marks[p] / nodes[p] for p in paths]))
    fused = ratio * pointed * np.array([NAMED_WEIGHT if named else 1.0 for _, named in paths])
    bound = min(fused.std(), fused.max() / 2)
    return {p: float(v) for p, v in zip(paths, fused, strict=True) if v >= bound}


def region(own: list[tuple[Leaf, bool]], tags: dict[int, str]) -> int | None:
    """The element that the content leaves (leaf, whether it is content) vote for; None for the whole page."""
    mass: dict[int, float] = defaultdict(float)
    parts: dict[int, float] = defaultdict(float)  # of the text in articles
    total = 0.0
    for leaf, good in own:
        if good:
            n = len(leaf.text.strip())
            total += n
            inside = any(tags[e] == "article" for e in leaf.above)
            for element in leaf.above:
                mass[element] += n
                parts[element] += n * inside
    # an article or main element with half of the content is taken as such
    chosen = max((e for e in mass if tags[e] in ("article", "main") and mass[e] >= 0.5 * total), key=lambda e: (tags[e] == "article", mass[e]), default=None)
    if chosen is not None and tags[chosen] == "article" and parts[chosen] < 0.8 * max(parts.values()):
        return max(e for e in parts if parts[e] >= 0.8 * max(parts.values()))  # one article of several: the innermost element that holds nearly all
    if chosen is None:
        return max((e for e in mass if mass[e] >= 0.8 * total and tags[e] not in INLINE), default=None)
    return chosen


def emphasised(good: dict[tuple[tuple[str, ...], bool], float]) -> dict[tuple[tuple[str, ...], bool], float]:
    """The content paths with those that only elements of emphasis set apart from one of them."""
    out = dict(good)
    for (path, is_named), value in good.items():
        while path and path[-1].partition(".")[0] in EMPHASIS:
            path = path[:-1]
            out.setdefault((path, is_named), value)
    return out


def beside(own: list[tuple[Leaf, bool]], tags: dict[int, str], chosen: int) -> set[int]:
    """Elements of the chosen one that hold several blocks and less than half of its text, and either nothing but links, or, with no content (headings apart),
    mostly links or a place after all content."""
    full = [(i, x, is_good, any(s.partition(".")[0] in HEADINGS for s in x.path)) for i, (x, is_good) in enumerate(own) if x.text.strip() and chosen in x.above]
    last = max((i for i, _, is_good, heads in full if is_good and not heads), default=len(own))
    blocks: dict[int, set[int]] = defaultdict(set)
    first: dict[int, int] = {}
    size: dict[int, int] = defaultdict(int)
    linked: dict[int, int] = defaultdict(int)
    content: set[int] = set()
    for i, leaf, is_good, heads in full:
        n = len(leaf.text.strip())
        in_link = any(s.partition(".")[0] == "a" for s in leaf.path)
        for element in leaf.above[leaf.above.index(chosen) + 1 :]:
            if tags[element] in PARTS:
                blocks[element].add(leaf.block)
                first.setdefault(element, i)
                size[element] += n
                linked[element] += n * in_link
                if is_good and not heads:
                    content.add(element)
    total = sum(len(x.text.strip()) for _, x, _, _ in full)
    several = {e for e, held in blocks.items() if len(held) > 1 and 2 * size[e] < total}
    menus = {e for e in several if linked[e] == size[e]}
    return menus | {e for e in several - content if 2 * linked[e] > size[e] or (first[e] > last and tags[e] in ("div", "section"))}


def main_text(page: str | None) -> str:
    """Blocks of the article, one a line."""
    if not page:
        return ""
    found, tags = leaves(page)
    found = [x for x in found if not x.never]
    wrappers = outer(found, tags)
    good = emphasised(content_paths(found, wrappers))
    if not good:
        return ""
    named = [not wrappers.issuperset(x.around) for x in found]
    own = [(x, (x.path, is_named) in good) for x, is_named in zip(found, named, strict=True)]
    chosen = region(own, tags)
    whole = chosen is not None and any(tags[e] == "article" for e in (chosen, *next(x.above for x in found if chosen in x.above)) if e <= chosen)
    taken = [i for i, (x, is_good) in enumerate(own) if is_good and x.text.strip() and (chosen is None or chosen in x.above)]
    first, last = (taken[0], taken[-1]) if taken else (0, len(own))
    others = beside(own, tags, chosen) if whole and chosen is not None else set()
    blocks: dict[int, list[str]] = defaultdict(list)
    for i, (leaf, is_good) in enumerate(own):
        if chosen is not None and chosen not in leaf.above:
            continue
        if not others.isdisjoint(leaf.above):
            continue
        if not is_good:
            if named[i]:
                continue
            steps = [x.partition(".")[0] for x in leaf.path]
            within = any((leaf.path[:n], False) in good for n in range(len(leaf.path)))
            if not (whole or within or (first <= i <= last and "a" not in steps) or (i < first and not HEADINGS.isdisjoint(steps))):
                continue
        blocks[leaf.block].append(leaf.text)
    lines = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of each row."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(main_text)

    return pages.withColumn(to, run(F.coalesce(F.col(column), F.lit(""))))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
