"""Quality by random-indexing word vectors and a small network.

Each token is two units: its shape (runs of capitals, small letters, digits and single signs, and whether the token
before was the same) and its lower-cased word, both hashed into buckets. A bucket has a sparse random index vector;
its word vector is the sum of the index vectors of the units beside it, scaled to unit length. A document is the mean
and the spread of its shapes' vectors, the mean of its words' vectors, the shares of its kinds of characters and of
repeated tokens. A two-layer network in numpy is fitted on these; its temperature is set on rows kept aside.

All is learned from a bounded sample of labelled rows (SAMPLE of each class, labelled.SAMPLE_BYTES of text).

Edge cases: null and empty texts are the zero document; with labels of one class or none the score is that class's
share (0.5 with none); repeated rows get equal scores; columns of other names stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from glossmill.llm import labelled, runtime, textvec
from glossmill.llm.textvec import U

BUCKETS, DIM, NONZERO, WINDOW = 1024, 48, 6, 2
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.02, 1e-4
#: Rows of each class that it is fitted on, at most.
SAMPLE = 2000
#: Units whose neighbours are counted at a time.
BLOCK = 1 << 20
#: Every so manieth sampled row is kept aside for the temperature.
ASIDE = 5

# 0 signs (each its own), 1 small letters and bytes of other scripts, 2 capitals, 3 digits
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_GROUP = np.zeros(256, np.uint8)
_GROUP[[*range(97, 123), *range(128, 256)]] = 1
_GROUP[65:91] = 2
_GROUP[48:58] = 3
_GROUP[[*b".,;:!?'\"()-"]] = 4


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape and word bucket of each token, first token of each text, and each text's plain shares."""
    w = textvec.split_words(texts)
    kind = _KIND[w.buf]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    turns = np.cumsum(np.add.reduceat(new, np.column_stack([w.start, w.end]).ravel(), dtype=np.int64)[:-1]) if len(w.start) else np.zeros(0, np.int64)
    turns = np.concatenate(([0], turns)) + (int(new[: w.start[0]].sum()) if len(w.start) else 0)  # runs before each word's start and end
    shape = textvec.span_hashes(kind[new], turns[0::2][: len(w.start)], turns[1::2][: len(w.start)])
    word = textvec.span_hashes(textvec.LOWER[w.buf], w.start, w.end)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[w.first[:-1][w.first[:-1] < len(word)]] = False
    shape = textvec.mix(shape + same.astype(np.uint64))
    n = len(texts)
    count = np.diff(w.first)
    group = _GROUP[w.buf]
    groups = np.column_stack([np.add.reduceat(group == g, w.doc_at[:-1], dtype=np.int64) for g in range(5)]) / np.diff(w.doc_at)[:, None]
    again = np.bincount(w.doc, same, n) / np.maximum(count, 1)
    plain = np.column_stack([groups, again, np.log1p(count) / 10])
    return (shape % U(BUCKETS)).astype(np.int64), (word % U(BUCKETS)).astype(np.int64), w.first, plain


def index_vectors(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def word_vectors(units_: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """From the units of many texts, one after the other."""
    beside = np.zeros(BUCKETS * BUCKETS)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    for d in range(1, WINDOW + 1):
        for at in range(0, len(units_) - d, BLOCK):
            end = min(at + BLOCK, len(units_) - d)
            ok = text[at + d : end + d] == text[at:end]
            a, b = units_[at:end][ok].astype(np.int64), units_[at + d : end + d][ok].astype(np.int64)
            beside += np.bincount(a * BUCKETS + b, minlength=BUCKETS**2) + np.bincount(b * BUCKETS + a, minlength=BUCKETS**2)
    out = beside.reshape(BUCKETS, BUCKETS).astype(np.float32) @ index_vectors(seed)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


class Network:
    def __init__(self, bias: float):
        self.bias = bias
        self.shapes = self.words = self.layers = None
        self.mean = self.scale = None
        self.temperature = 1.0

    def pooled(self, shape: np.ndarray, word: np.ndarray, first: np.ndarray, plain: np.ndarray) -> np.ndarray:
        n = len(plain)
        doc = np.repeat(np.arange(n), np.diff(first))
        size = np.maximum(np.diff(first), 1)[:, None]

        def of(unit: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            seen = np.unique(unit)
            place = np.zeros(BUCKETS, np.int64)
            place[seen] = np.arange(len(seen))
            count = np.bincount(doc * len(seen) + place[unit], minlength=n * len(seen)).reshape(n, -1).astype(np.float32) / size
            return count @ table[seen], count @ table[seen] ** 2

        if not len(shape):
            return np.column_stack([np.zeros((n, 3 * DIM)), plain])
        mean, square = of(shape, self.shapes)
        return np.column_stack([mean, np.sqrt(np.maximum(square - mean**2, 0)), of(word, self.words)[0], plain])

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.bias)
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias) if self.layers is None else self.logits(self.pooled(*units(texts)))
        # a product's last bits depend on the rows beside; rounded, equal texts have equal scores
        return np.round(1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40))), 9)


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Temperature of least log loss."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [float((weight * np.logaddexp(0, np.where(y == 1, -z, z) / t)).sum()) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(shape: list[np.ndarray], word: list[np.ndarray], plain: np.ndarray, y: np.ndarray, share: float) -> Network:
    rows, ones = len(y), int(y.sum())
    p = min(max(share, 1e-4), 1 - 1e-4) if rows else 0.5
    net = Network(float(np.log(p / (1 - p))))
    if not rows or ones in (0, rows):
        return net
    first = np.concatenate(([0], np.cumsum([len(s) for s in shape])))
    shapes, words = np.concatenate(shape), np.concatenate(word)
    net.shapes, net.words = word_vectors(shapes, first, 11), word_vectors(words, first, 12)
    x = np.concatenate([net.pooled(shapes[first[a] : first[b]], words[first[a] : first[b]], first[a : b + 1] - first[a], plain[a:b]) for a, b in ((i, min(i + 256, rows)) for i in range(0, rows, 256))])
    aside = np.arange(rows) % ASIDE == 0
    weight = np.where(y == 1, p / ones, (1 - p) / (rows - ones))
    net.mean, net.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    t, target, w = (x[~aside] - net.mean) / net.scale, y[~aside], weight[~aside] / weight[~aside].sum()
    rng = np.random.default_rng(5)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([net.bias])]
    moments = [(np.zeros_like(q), np.zeros_like(q)) for q in params]
    for k in range(1, STEPS + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(t @ w1 + b1)
        err = w * (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40))) - target)
        back = err[:, None] * w2 * (1 - h * h)
        grads = [t.T @ back + DECAY * w1, back.sum(0), h.T @ err + DECAY * w2, np.array([err.sum()])]
        for q, (m, s), g in zip(params, moments, grads, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    net.layers = params
    if aside.any():
        net.temperature = _calibrated(net.logits(x[aside]), y[aside], weight[aside])
    return net


def learn(docs: DataFrame, labels: DataFrame, folds: Column, label: str = "quality") -> Network:
    """From a bounded sample of labelled rows, fitted in one task; the driver gets the network alone."""
    runtime.prepare(docs.sparkSession)
    rows, share = labelled.sample(docs, labels, label, folds, SAMPLE)

    def extract(batches):
        for batch in batches:
            texts = runtime.text_bytes(batch.column(0))
            out = []
            for a, b in runtime.pieces(texts):
                shape, word, first, plain = units(texts[a:b])
                for i, (p, q) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    out.append((shape[p:q].astype(np.uint16).tobytes(), word[p:q].astype(np.uint16).tobytes(), plain[i].tobytes()))
            columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["shape", "word", "plain", "y"])

    def fitted(table: pa.Table) -> Network:
        back = sorted(zip(*(table.column(c).to_pylist() for c in ("word", "shape", "plain", "y")), strict=True))
        ints = lambda b: np.frombuffer(b, np.uint16)
        return fit([ints(r[1]) for r in back], [ints(r[0]) for r in back], np.array([np.frombuffer(r[2]) for r in back]), np.array([r[3] for r in back], float), share)

    none = np.zeros((0, 7))
    return labelled.fit_apart(rows.mapInArrow(extract, "shape binary, word binary, plain binary, y int"), fitted) or fit([], [], none, none[:, 0], share)


def predict(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text. One pass, no shuffle."""
    runtime.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda texts: [pa.array(shared.value.score(texts).astype(np.float64))]

    return runtime.append_columns(docs, text, [T.StructField(name, T.DoubleType())], make)
