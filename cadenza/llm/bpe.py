"""Byte-level BPE encoding and decoding.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds
all tokens in a piece of text. The encoder walks the piece with the longest match at each place and
steps back to a shorter one whenever two neighbouring tokens could not stand side by side in the
result of the merges. Whether two tokens are compatible depends on these two alone and is memoised,
so each place is visited a bounded number of times and the ids equal those of the merges.

Defined results: a null text encodes as an empty one (no ids); a text of any length is encoded
whole; null ids decode to empty bytes; an id outside the vocabulary raises ValueError. Repeated rows
are encoded alike and extra columns pass through; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._common import small_batches, table

#: Encoded pieces kept by a worker; when the memory is full it starts anew.
KEPT_PIECES = 150_000
#: Remembered answers about neighbouring tokens.
KEPT_PAIRS = 200_000
#: Longer pieces are encoded each time.
KEPT_LENGTH = 32


def split_pattern(pattern: str):
    r"""The splitting pattern; \s means the characters with the property White_Space."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Vocabulary:
    """Ranks of byte strings with the tables that encoding needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.pattern = split_pattern(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens of a token's last merge
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.lengths = list(map(len, self.bytes))
        self.shorter: dict[int, int | None] = {}  # the longest token that is a proper prefix
        for rank, token in enumerate(self.bytes):
            if len(token) > 1:
                self._learn(rank, token)
        self.pieces: dict[str, bytes] = {}

    def _learn(self, rank: int, token: bytes) -> None:
        """Find the merge that makes this token from tokens of lower rank."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._fits(left, right):
                self.parts[rank], self.merged[left, right] = (left, right), rank
                return

    def _fits(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when the merges run over their joined bytes: undo the
        merges on both sides of the seam, latest first, and look for one across it that comes earlier."""
        bound = len(self.bytes)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a and (not b or left > right):
                bound, left = left, a[1]
            elif b:
                bound, right = right + 1, b[0]
            else:
                return True

    def prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self.shorter:
            token = self.bytes[rank]
            self.shorter[rank] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[rank]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, lengths, fits, find = len(piece), self.lengths, self.fits, self.automaton.iter_long
        letters = piece.decode("latin-1")
        closed = bytearray(size + 1)  # 1: no encoding goes through here
        out: list[int] = []
        at, token, last = 0, next(find(letters, 0))[1], -1
        while at < size:
            while token is not None:
                end = at + lengths[token]
                if not closed[end]:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok is None:
                        if len(fits) >= KEPT_PAIRS:
                            fits.clear()
                        ok = fits[last, token] = self._fits(last, token)
                    if ok:
                        break
                token = self.prefix(token)
            if token is None:
                closed[at] = 1
                token = out.pop()
                at -= lengths[token]
                token, last = self.prefix(token), out[-1] if out else -1
            else:
                out.append(token)
                at, last = end, token
                if at < size:
                    token = next(find(letters, at))[1]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        got, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = got.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(piece) <= KEPT_LENGTH:
                    if len(got) >= KEPT_PIECES:
                        got.clear()
                    got[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        got = np.frombuffer(ids, "<u4")
        if len(got) and got.max() >= len(self.bytes):
            raise ValueError(f"id {got.max()} is not in the vocabulary")
        return b"".join(map(self.bytes.__getitem__, got.tolist()))


@functools.cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}, pattern)


def encode(texts: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of each text as packed little-endian unsigned 32-bit integers. path: a rank file that is
    installed at the same place on every machine, or the bare name of one sent by addFile()."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        own = vocabulary(path if "/" in path else SparkFiles.get(path), pattern)
        return pd.Series([own.encode(t) if t else b"" for t in column], dtype=object)

    return run(texts)


def decode(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        own = vocabulary(path if "/" in path else SparkFiles.get(path), pattern)
        return pd.Series([own.decode(x) if x else b"" for x in column], dtype=object)

    return run(ids)


def encode_table(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with the packed ids of its texts."""
    small_batches(docs.sparkSession)
    return docs.withColumn(to, encode(F.col(text), path))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and return digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "token_ids")
    return coded.withColumn("decoded", decode(F.col("token_ids"), path)).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
