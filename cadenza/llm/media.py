"""Interleaved document sequences of texts and media.

A page becomes an ordered list of items: runs of text, and references to media by the digest of their
stored form, with caption and position. Payloads are stored once for each digest; a join by digest resolves
the references, and positions and captions stay as the page has them. Payloads are stored as PGM
images (8-bit grey samples, WIDTH to a row), a lossless form that is read back for its features.

Defined results: null and empty html have no items; a reference whose digest is unknown stays, with null
payload columns; a null payload counts as empty; repeated rows give repeated items; payloads of any
length are stored whole. Sequences are cut at no length: each item is a row. Columns of pages named position, kind,
text, digest or caption are replaced by the items'; all others are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import free, small_batches, stage, table

WIDTH = 64
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_NAMED = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SKIPPED = re.compile(r"(script|style|template|noscript)$", re.IGNORECASE)
_MEDIA = frozenset({"img", "video", "audio", "source", "embed"})
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())


def items(page: str | None) -> list[dict]:
    """The items of a page in order. A figure's caption goes to the media in it, else a medium's alt
    text is its caption."""
    out: list[dict] = []
    text: list[str] = []
    figure: int | None = None  # where the open figure's items begin
    caption: list[str] | None = None
    skip = ""

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append({"kind": "text", "text": joined, "digest": None, "caption": None})

    at = 0
    for m in _TAG.finditer(page or ""):
        if not skip:
            (text if caption is None else caption).append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if skip:
            skip = "" if m[1] and name == skip else skip
            continue
        if not name:
            continue
        if _SKIPPED.match(name):
            skip = "" if m[1] else name
        elif name == "figure":
            flush()
            figure = None if m[1] else len(out)
        elif name == "figcaption":
            if m[1] and caption is not None:
                words = " ".join("".join(caption).split())
                for x in out[len(out) if figure is None else figure :]:
                    if x["kind"] == "media":
                        x["caption"] = words
            caption = None if m[1] else []
        elif name in _MEDIA and not m[1]:
            own = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _NAMED.findall(m[3])}
            where = own.get("src", "")
            if where:
                flush()
                out.append({"kind": "media", "text": None, "digest": where.removeprefix("sha256:").lower(), "caption": own.get("alt")})
        elif name not in _INLINE:
            if caption is None:
                flush()
            else:
                caption.append(" ")
    if page and not skip:
        text.append(html.unescape(page[at:]))
    flush()
    return [x | {"position": i} for i, x in enumerate(out)]


def interleave(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row for each item: the columns of pages without the html, and position, kind, text, digest,
    caption."""
    small_batches(pages.sparkSession)
    item = free("_item", pages)

    @F.pandas_udf(ITEMS)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([items(x) for x in rows], dtype=object)

    kept = [c for c in pages.columns if c != column and c not in ("position", "kind", "text", "digest", "caption")]
    return pages.select(*kept, F.explode(run(F.col(column))).alias(item)).select(*kept, f"{item}.*")


def payload_of(text: Column) -> Column:
    """A text's bytes, with bytes 0 up to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def store_grey(payload: Column) -> Column:
    """The payload as a PGM image: the header, then one sample a byte."""
    rows = (F.octet_length(payload) / WIDTH).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")).cast("binary"), payload)


def read_grey(stored: bytes) -> np.ndarray:
    """The samples of a PGM image with one byte a sample."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored)
    if not m:
        raise ValueError("not an 8-bit PGM image")
    width, height = int(m[1]), int(m[2])
    return np.frombuffer(stored, np.uint8, width * height, m.end()).reshape(height, width)


def describe(image: np.ndarray) -> str:
    """Mean and spread of the samples in hundredths, and a 64-bit pattern: which cells of an 8 by 8
    grid are brighter than the cell to their right."""
    n, total = image.size, int(image.sum(dtype=np.int64))
    square = int((image.astype(np.int64) ** 2).sum())
    rows = np.linspace(0, image.shape[0], 9).astype(int)
    heights = np.maximum(np.diff(rows), 1)
    sums = np.concatenate([np.zeros((1, 8), np.int64), image.reshape(image.shape[0], 8, -1).sum(axis=2, dtype=np.int64).cumsum(axis=0)])
    cells = (sums[np.minimum(rows[:-1] + heights, image.shape[0])] - sums[rows[:-1]]) // heights[:, None]
    bits = (cells > np.roll(cells, -1, axis=1)).ravel()
    pattern = int("".join("01"[int(b)] for b in bits), 2)
    return f"{100 * total // n}:{(n * square - total * total) * 10000 // (n * n)}:{pattern:016x}"


def features(stored: Column) -> Column:
    """What is read back from stored media."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for x in rows:
            image = read_grey(x)
            back = image.tobytes()
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(x), describe(image)))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return run(stored)


def media_table(stored: DataFrame, column: str = "stored") -> DataFrame:
    """One row for each digest: digest and what is read back from its bytes. It is written, so that Spark can split a digest
    that very many references share when it is joined."""
    small_batches(stored.sparkSession)
    rows = stored.select(F.sha2(column, 256).alias("digest"), features(F.col(column)).alias("f")).select("digest", "f.*")
    return stage(rows.dropDuplicates(["digest"]), "media")


def resolve(sequence: DataFrame, media: DataFrame) -> DataFrame:
    """sequence with the media's columns beside each reference, null for texts and unknown digests."""
    texts, key = sequence.where(F.col("digest").isNull()), free("_digest", sequence)
    own = media.withColumnRenamed("digest", key)
    found = sequence.where(F.col("digest").isNotNull()).join(own, F.col("digest") == F.col(key), "left").drop(key)
    return found.unionByName(texts, allowMissingColumns=True)


def figure_of(doc_id: Column, digest: Column) -> Column:
    """A page with a paragraph, a figure that refers to a payload, and another paragraph."""
    name = F.coalesce(doc_id.cast("string"), F.lit("none"))
    return F.concat(
        F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>Payload of document '), name, F.lit("</figcaption></figure><p>End of document "), name, F.lit("</p></article>")
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored payload, referred to by a page of its own and resolved by digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), store_grey(payload_of(F.col("text"))).alias("stored"))
    pages = stored.select("doc_id", "n_bytes", figure_of(F.col("doc_id"), F.sha2("stored", 256)).alias("html"))
    sequence = interleave(pages).where("kind = 'media'")
    found = resolve(sequence, media_table(stored))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")
