"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as the product of its letters' vectors, each
permuted (rotated) by its place; a document is the bundle (sum) of its trigrams, a language the bundle of its
documents' vectors, each scaled to unit length first. A text gets the language with the largest cosine.

A document's bundle is its trigram counts times the matrix of trigram vectors, so a run of documents is one matrix
product over the trigrams that occur in it. Prototypes are sums of integers and don't depend on the order of tasks.

Edge cases: a text that is null or has no letter is `und` with score 0; ties go to the language that sorts first;
with nothing to learn from, every text is `und`; rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.llm import runtime
from glossmill.llm.runtime import text_bytes

DIM = 512
#: Letter classes; a-z have one each, all other letters share the rest by a hash.
CLASSES = 128
UNKNOWN = "und"
#: A unit vector's entries are rounded to so many steps when prototypes are summed.
STEPS = 1 << 20
#: Languages a model may have; the prototypes that every task holds are at most so many rows.
MOST_LANGUAGES = 8192
#: Bytes of a text past which it is bundled in pieces.
PIECE = 1 << 21

_classes: np.ndarray | None = None
_vectors: np.ndarray | None = None


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 if it is no letter."""
    global _classes
    if _classes is None:
        points = np.arange(0x110000, dtype=np.uint64)
        mixed = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CLASSES - 27) + np.uint64(27)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        table = np.where(letter, mixed, 0).astype(np.uint8)
        table[97:123] = table[65:91] = np.arange(1, 27)
        _classes = table
    return _classes


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    global _vectors
    if _vectors is None:
        _vectors = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (CLASSES, DIM))
    a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return np.roll(_vectors, 2, 1)[a] * np.roll(_vectors, 1, 1)[b] * _vectors[c]


def bundles(texts: list[bytes]) -> np.ndarray:
    """A row for each text; zero if it has no letter. Long texts are cut at spaces, where no trigram is lost, and their pieces' sums added."""
    if max(map(len, texts), default=0) <= PIECE:
        return _bundles(texts)
    cut = [list(_pieces(t)) for t in texts]
    return np.stack([sum(_bundles([p])[0].astype(np.float64) for p in parts) if parts else np.zeros(DIM) for parts in cut])


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) + 1 or len(text)
        yield text[at:end]
        at = end


def _bundles(texts: list[bytes]) -> np.ndarray:
    table = letter_classes()
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    data = table[np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.concatenate(([0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0) | (data[:-1] != 0)  # one break between words
    data, doc = data[keep].astype(np.int64), doc[keep]
    if len(data) < 3:
        data, doc = np.concatenate((data, [0, 0])), np.concatenate((doc, [doc[-1]] * 2))
    codes = (data[:-2] * CLASSES + data[1:-1]) * CLASSES + data[2:]
    doc = doc[1:-1]
    there = codes >= 0
    there &= data[1:-1] > 0  # centred on a letter
    codes, doc = codes[there], doc[there]
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(CLASSES**3, np.int32)
    place[seen] = np.arange(len(seen))
    counts = np.bincount(doc * len(seen) + place[codes], minlength=len(texts) * len(seen)).reshape(len(texts), -1) if len(seen) else np.zeros((len(texts), 0))
    return counts.astype(np.float32) @ trigram_vectors(seen) if len(seen) else np.zeros((len(texts), DIM), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-12)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes of unit length. docs: the rows to learn from.

    Each task sums its documents' vectors by language; what reaches the driver is a vector for each language.
    """
    runtime.prepare(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = text_bytes(batch.column(0)), batch.column(1).to_pylist()
            for a, b in runtime.pieces(texts, 1 << 20, 256):
                steps = np.rint(_unit(bundles(texts[a:b])) * STEPS).astype(np.int64)
                names = np.array(langs[a:b], object)
                for name in set(langs[a:b]):
                    held[name] = held.get(name, 0) + steps[names == name].sum(0)
        for name, vector in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(vector)], ["l", "i", "v"])

    total = rows.mapInArrow(sums, "l string, i int, v long").groupBy("l", "i").agg(F.sum("v").alias("v"))
    got = total.limit(MOST_LANGUAGES * DIM + 1).toArrow()
    names = sorted(set(got.column("l").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    where = {n: k for k, n in enumerate(names)}
    out = np.zeros((len(names), DIM))
    out[[where[x] for x in got.column("l").to_pylist()], got.column("i").to_numpy()] = got.column("v").to_numpy()
    return names, _unit(out)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score (the best cosine, not under 0). One pass, no shuffle."""
    runtime.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, prototypes = shared.value

        def step(texts: list[bytes]):
            vectors = bundles(texts)
            known = np.abs(vectors).max(1) > 0
            if not names:
                known[:] = False
            cosines = _unit(vectors) @ prototypes.T if names else np.zeros((len(texts), 1))
            best = np.round(cosines, 6).argmax(1)
            score = np.where(known, np.round(np.clip(cosines[np.arange(len(texts)), best], 0, 1), 6), 0.0)
            return [pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), pa.array(score)]

        return step

    fields = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]
    return runtime.append_columns(docs, text, fields, make, max_rows=256)
