"""Word and shingle hashes of whole texts, in numpy over batches of documents."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time; longer words are hashed whole.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(inverse: bool) -> np.ndarray:
    row = np.full(BLOCK, _BASE_INV if inverse else _BASE, np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


def _power(inverse: bool, n: int) -> np.ndarray:
    if n <= BLOCK:
        return _powers(inverse)[:n]
    row = np.full(n, _BASE_INV if inverse else _BASE, np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and the first and past-last byte of each word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_block(raw: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(False, len(raw)), out=sums[1:])
    return mix((sums[past] - sums[first]) * _power(True, len(raw))[first] + (past - first).astype(np.uint64))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of data, and the place of its first byte. Equal words have equal hashes."""
    raw, first, past = word_spans(data)
    out, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):  # the words that end within BLOCK bytes from here, or one longer word
        start = first[at]
        to = max(at + 1, int(np.searchsorted(past, start + BLOCK, "right")))
        out[at:to] = _hash_block(raw[start : past[to - 1]], first[at:to] - start, past[at:to] - start)
        at = to
    return out, first


def documents(texts: list[str | None], lower: bool = False, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes for runs of documents of about `most` bytes: (first document, word hashes, bounds),
    where document first + i has the words bounds[i] to bounds[i + 1]. A null text has no words."""
    at = 0
    while at < len(texts):
        parts, total = [], 0
        while at + len(parts) < len(texts) and (not parts or total < most):
            text = texts[at + len(parts)]
            part = b"" if text is None else text.encode("utf-8", "surrogatepass")
            parts.append(part.lower() if lower else part)
            total += len(part) + 1
        hashes, first = hash_words(b"\n".join(parts))
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        yield at, hashes, np.searchsorted(first, starts)
        at += len(parts)


def shingle(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : len(words) - n + 1 + i]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingles; with fewer than n words, the whole sequence as one; without words, none."""
    return np.unique(shingle(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)
