"""Vectorised text primitives over a run of documents held as one byte buffer.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A substring's hash is the sum of random byte
values times powers of an odd base, modulo 2**64, from its start, mixed; long texts are hashed block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Symbols whose powers are held at once; longer texts are hashed in so many steps.
BLOCK = 1 << 18


def _multiples(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_POWERS, _INVERSES = _multiples(_BASE), _multiples(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the symbols; spans are in order and don't overlap. What goes on over a block's border is carried."""
    out = np.zeros(len(start), np.uint64)
    sums = np.zeros(min(BLOCK, len(symbols)) + 1, np.uint64)
    for a in range(0, len(symbols), BLOCK):
        b = min(a + BLOCK, len(symbols))
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b)
        if hi > lo:
            np.cumsum(_VALUES[symbols[a:b]] * _POWERS[: b - a], out=sums[1 : b - a + 1])
            s, e = np.maximum(start[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a
            part = (sums[e] - sums[s]) * _INVERSES[s]
            if start[lo] < a:
                part[:1] *= U(pow(_BASE, int(a - start[lo]), 1 << 64))
            out[lo:hi] += part
    return mix(out)


def short_hashes(symbols: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """As span_hashes, for spans of one small size that may overlap."""
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        out += _VALUES[symbols[start + j]] * _POWERS[j]
    return mix(out)


@dataclass
class Words:
    buf: np.ndarray  # bytes of all documents, a newline after each
    doc_at: np.ndarray  # first byte of each document, and the end
    start: np.ndarray  # of words
    end: np.ndarray
    first: np.ndarray  # first word of each document, and the number of words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts: list[bytes], lower: bool = False, stops: np.ndarray = SPACE) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    doc_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=doc_at[1:])
    stop = stops[buf]
    turn = np.flatnonzero(np.diff(stop)) + 1
    if not stop[0]:
        turn = np.concatenate(([0], turn))
    start, end = turn[0::2], turn[1::2]
    return Words(buf, doc_at, start, end, np.searchsorted(start, doc_at))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n word hashes, wherever it starts; the caller leaves out windows across documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * U(_BASE) + words[j : j + m]
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the window starts that stay in their document."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        bad = first[1:-1] - k
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def counts_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each stands there."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, np.int64)
    at = np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
    return sorted_values[at], np.diff(np.append(at, len(sorted_values)))
