"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

Word hashes are rolled into hashes of n words for several n; a window whose hash stands twice or more in its
document covers its words, the first occurrence included. A duplicated (n+1)-gram holds duplicated n-grams, so
only the shortest length looks at all windows; each longer one looks at the windows that the last one found.

Edge cases: null and empty texts have no words and fail; a text shorter than n words has no n-gram; equal rows get
equal results; a document of any length is hashed whole, block by block
(of a long one, arrays of about a dozen numbers a word are held).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossmill.llm import runtime, textvec
from glossmill.llm.textvec import U

#: n-gram length: most of the word characters that duplicated n-grams of it may cover.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Most of the word characters that may stand in lines equal to an earlier line.
LINE_LIMIT = 0.30
BASE_N, MIN_WORDS, BASE_PERCENT = 5, 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of keys that stand there twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside windows of n that start there."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Columns by name, a value for each text."""
    docs = len(texts)
    w = textvec.split_words(texts)
    total = len(w.start)
    chars = np.add.reduceat((w.buf & 0xC0) != 0x80, np.column_stack([w.start, w.end]).ravel(), dtype=np.int64)[::2] if total else np.zeros(0, np.int64)
    doc = w.doc
    per_doc = lambda values: np.bincount(doc, values, docs)
    word_chars = per_doc(chars).astype(np.int64)
    symbols = np.add.reduceat(_SYMBOL[w.buf], w.doc_at[:-1], dtype=np.int64)
    out = {"n_words": np.diff(w.first), "word_chars": word_chars, "n_symbols": symbols}

    salt = textvec.mix(np.arange(1, docs + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    hashes = textvec.span_hashes(w.buf, w.start, w.end)
    shares, at = {}, None
    for n in sorted(NGRAM_LIMITS):
        rolled = textvec.ngram_hash(hashes, n)
        ok = np.flatnonzero(textvec.inside(w.first, n, total))
        if at is not None:
            ok = ok[np.isin(ok, at)]
        at = ok[_repeated(rolled[ok] ^ salt[doc[ok]])] if len(ok) else ok
        cover = _covered(at, n, total)
        shares[n] = per_doc(chars * cover) / np.maximum(word_chars, 1)
        if n == BASE_N:
            out["n_repeat_words"] = per_doc(cover).astype(np.int64)

    ends = np.flatnonzero(w.buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    words_before = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
    full = words_before[1] > words_before[0]
    starts, ends, line_words = starts[full], ends[full], (words_before[0][full], words_before[1][full])
    line_doc = np.searchsorted(w.doc_at, starts, "right") - 1
    key = textvec.span_hashes(w.buf, starts, ends) ^ salt[line_doc] if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    before = np.zeros(total + 1, np.int64)
    np.cumsum(chars, out=before[1:])
    line_chars = before[line_words[1]] - before[line_words[0]]
    out["n_dup_lines"] = np.bincount(line_doc, again, docs).astype(np.int64)
    line_share = np.bincount(line_doc, line_chars * again, docs) / np.maximum(word_chars, 1)

    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    good = line_share <= LINE_LIMIT
    for n, most in NGRAM_LIMITS.items():
        good &= shares[n] <= most
    out |= {"dup_line_chars": line_share, **{f"dup_{n}gram_chars": s for n, s in shares.items()}, "base_failed": failed, "kept": good & ~failed}
    return out


def repetition_rules(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts, the covered shares and the verdict of each text. One pass, no shuffle."""
    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS), "base_failed", "kept"]
    fields = [T.StructField(prefix + n, kinds.get(n, T.DoubleType() if n.startswith("dup_") else T.LongType())) for n in names]

    def make():
        def step(texts: list[bytes]):
            got = measure(texts)
            return [pa.array(got[n]) for n in names]

        return step

    return runtime.append_columns(docs, text, fields, make)
