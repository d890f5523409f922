"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters, and beginnings and ends of them, hashed. From a sample of labelled rows, bounded in
rows and bytes (labelled.SAMPLE, labelled.SAMPLE_BYTES), the terms whose presence depends on the label (G test) become features; the machine has a weight and a vector
of factors for each, so pairs of terms (an insult and whom it means) count beyond their own weights. It is fitted
by Adam on the log loss; both labels weigh the same in all, so that the rarer one is not overlooked at 0.5. Features are present or absent in the whole text, so
one insult counts the same in a long document.

Edge cases: null and empty texts have no terms and get the score of the bias; with labels of one class or none the
score is that class's share (0.5 with none); repeated rows get equal scores; columns of other names stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from glossmill.llm import labelled, runtime, textvec
from glossmill.llm.textvec import U

BITS = 20
#: Bytes of a word's beginnings and ends that are terms.
BEGINNINGS, ENDS = (4, 5, 6), (4, 5)
#: A term's G statistic, and the rows that hold it, at least; features at most.
LEAST_G, LEAST_ROWS, FEATURES = 12.0, 3, 2048
FACTORS, STEPS, RATE, DECAY = 8, 150, 0.05, 1e-3

_STOPS = np.ones(256, bool)
_STOPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts and the text each is in."""
    w = textvec.split_words(texts, lower=True, stops=_STOPS)
    buf = w.buf.copy()
    upper = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    buf[upper] += 32  # Latin-1 capitals
    size, doc = w.end - w.start, w.doc
    out = [textvec.span_hashes(buf, w.start, w.end)]
    docs = [doc]
    for k in BEGINNINGS:
        long = size > k
        out.append(textvec.short_hashes(buf, w.start[long], k) + U(k))
        docs.append(doc[long])
    for k in ENDS:
        long = size > k
        out.append(textvec.short_hashes(buf, w.end[long] - k, k) + U(k + 16))
        docs.append(doc[long])
    return (np.concatenate(out) >> U(64 - BITS)).astype(np.int64), np.concatenate(docs)


class Machine:
    """chosen: the hashed terms that are features; bias, and weights and factors of each."""

    def __init__(self, bias: float, chosen: np.ndarray | None = None, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.chosen = np.zeros(0, np.int64) if chosen is None else chosen
        self.weights, self.factors = (np.zeros(1), np.zeros((1, FACTORS))) if weights is None else (weights, factors)
        self.place = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.place is None:  # only where texts are scored; the machine itself is a few KB
            self.place = np.full(1 << BITS, -1, np.int16)
            self.place[self.chosen] = np.arange(len(self.chosen))
        term, doc = terms(texts)
        feature = self.place[term]
        hit = feature >= 0
        pair = np.unique(doc[hit] * FEATURES + feature[hit])
        doc, feature = pair // FEATURES, pair % FEATURES
        n = len(texts)
        out = self.bias + np.bincount(doc, self.weights[feature], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(held: list[np.ndarray], y: np.ndarray, share: float) -> Machine:
    """held: the distinct hashed terms of each row."""
    rows = len(y)
    ones = int(y.sum())
    p = min(max(share, 1e-4), 1 - 1e-4) if rows else 0.5
    alone = Machine(float(np.log(p / (1 - p))))
    if not rows or ones in (0, rows):
        return alone
    size = 1 << BITS
    k0, k1 = counts = np.zeros((2, size), np.int64)
    for terms_, label in zip(held, y.astype(int), strict=True):  # row by row: all terms side by side would be hundreds of MB
        counts[label, terms_] += 1
    often = np.flatnonzero(k1 + k0 >= LEAST_ROWS)
    k1, k0 = k1[often], k0[often]

    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - p), 1e-9))

    p = (k1 + k0) / rows
    g = 2 * (part(k1, ones, p) + part(k0, rows - ones, p))
    best = np.argsort(-g, kind="stable")[:FEATURES]
    chosen = often[best[g[best] >= LEAST_G]]
    if not len(chosen):
        return alone
    place = np.full(size, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((rows, len(chosen)), np.float32)
    for of_row, terms_ in zip(x, held, strict=True):
        there = place[terms_]
        of_row[there[there >= 0]] = 1
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (rows - ones)).astype(np.float32)
    rng = np.random.default_rng(3)
    params = [np.zeros(1, np.float32), np.zeros(len(chosen), np.float32), rng.normal(0, 0.01, (len(chosen), FACTORS)).astype(np.float32)]
    moments = [(np.zeros_like(q), np.zeros_like(q)) for q in params]
    for t in range(1, STEPS + 1):
        b, w, v = params
        xv = x @ v
        z = b[0] + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(1)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gv = x.T @ (err[:, None] * xv) - v * (x.T @ err)[:, None]
        grads = [np.array([err.sum()]), x.T @ err + DECAY * w / 10, gv + DECAY * v]
        for q, (m, s), gr in zip(params, moments, grads, strict=True):
            m += 0.1 * (gr - m)
            s += 0.01 * (gr * gr - s)
            q -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Machine(float(params[0][0]), chosen, params[1].astype(float), params[2].astype(float))


def learn(docs: DataFrame, labels: DataFrame, folds: Column, label: str = "toxic") -> Machine:
    """From a bounded sample of labelled rows, fitted in one task; the driver gets the machine alone."""
    runtime.prepare(docs.sparkSession)
    rows, share = labelled.sample(docs, labels, label, folds)

    def extract(batches):
        for batch in batches:
            texts = runtime.text_bytes(batch.column(0))
            out = []
            for a, b in runtime.pieces(texts):
                term, doc = terms(texts[a:b])
                both = np.unique((doc << BITS) | term)
                ends = np.searchsorted(both >> BITS, np.arange(b - a + 1))
                ids = (both & (1 << BITS) - 1).astype(np.uint32)
                out += [ids[p:q].tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["terms", "y"])

    def fitted(table: pa.Table) -> Machine:
        pairs = sorted(zip(table.column("terms").to_pylist(), table.column("y").to_pylist(), strict=True))
        return fit([np.frombuffer(t, np.uint32) for t, _ in pairs], np.array([y for _, y in pairs], np.float32), share)

    return labelled.fit_apart(rows.mapInArrow(extract, "terms binary, y int"), fitted) or fit([], np.zeros(0), share)


def predict(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text. One pass, no shuffle."""
    runtime.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        return lambda texts: [pa.array(shared.value.score(texts))]

    return runtime.append_columns(docs, text, [T.StructField(name, T.DoubleType())], make)
