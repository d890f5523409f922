"""Language-model scoring by a probabilistic suffix tree over bytes, beside an additive unigram base.

A text's words (lower-cased A-Z), one space between, and an end symbol are the sequence. All training texts are
counted: words, and windows of DEPTH + 1 symbols, from which counts of all shorter contexts follow. A context is
retained on its own evidence, however large the corpus: it occurs LEAST times, and its next-symbol distribution
diverges from that of its suffix (Kullback-Leibler divergence times its count) by half the logarithm of all symbols
for each symbol that follows it; suffixes of retained contexts are kept with it. So the tree grows with the corpus.
Distributions are smoothed towards the suffix's, the root's towards a uniform one.

Neither the tree nor the word counts are broadcast: texts are dealt into blocks, each block's distinct words and
contexts are joined with the counts, and the counts go back to the block.

Edge cases: null and empty texts are the end symbol alone; words and symbols not seen in training have their
smoothed probability; rows with a null id are scored and not learned from; repeated rows are rows of their own;
without training rows the base counts are 0 and the tree is uniform.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import runtime, textvec
from glossmill.llm.runtime import stored
from glossmill.llm.textvec import U

DEPTH, LEAST, PULL = 6, 8, 4.0
SYMBOLS, END = 257, 10
ADD = 0.1
#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Blocks are joined and scored in so many turns, each of which leaves the disks before the next.
TURNS = 4
#: Places whose windows are made at once; windows, or words, that are put in order together, with one such part more at
#: most; and windows whose order is held until their distinct ones are scored.
PLACES, TOGETHER, SCORED = 1 << 20, 2 << 20, 16 << 20
#: Rows of words and contexts in an Arrow batch.
FOUND_ROWS = 8192
#: Counts that a task holds before it sums them, and sums that it hands on.
HELD, FULL = 3_000_000, 2_000_000
#: Kinds of counts.
WORD, WINDOW, TEXT = 0, 1, 2
#: All keys are single longs, so that they are sorted and joined as such: a word's is negative, the others' have a tag
#: in the highest byte, a context's is its length and one.
TAG, MASK, WINDOW_TAG, TEXT_TAG = 56, (1 << 56) - 1, 8, 9


def normal(w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents with DEPTH end symbols before each, which are real, and each document's first real one."""
    buf = w.buf.copy()
    keep = ~textvec.SPACE[buf]
    buf[w.end] = 32
    some = np.flatnonzero(np.diff(w.first) > 0)
    last = w.doc_at[1:] - 1
    last[some] = w.end[w.first[some + 1] - 1]
    keep[w.end] = True
    buf[last] = END
    keep[last] = True
    size = np.add.reduceat(keep, w.doc_at[:-1], dtype=np.int64)
    pad, real = bytes([END]) * DEPTH, buf[keep].tobytes()
    ends = np.cumsum(size).tolist()
    out = pad + pad.join(real[a:b] for a, b in zip([0, *ends], ends))
    first = np.cumsum(size + DEPTH) - size
    is_real = np.ones(len(out), bool)
    for j in range(1, DEPTH + 1):
        is_real[first - j] = False
    return np.frombuffer(out, np.uint8), is_real, first


def windows(symbols: np.ndarray) -> np.ndarray:
    """Of each symbol but the first DEPTH: itself in the lowest byte, and those before it, the nearest lowest."""
    one = symbols.astype(np.uint64)
    two = one[1:] | (one[:-1] << U(8))
    four = two[2:] | (two[:-2] << U(16))
    return four[3:] | (two[1:-4] << U(32)) | (one[:-6] << U(48))


def blocks_of(symbols: np.ndarray, real: np.ndarray, first: np.ndarray):
    """For runs of PLACES symbols, so that a long text's windows are held a part at a time: the windows of the real
    symbols among them, the first document and the one after the last that they are of, and each one's first window."""
    end = np.append(first[1:] - DEPTH, len(symbols))
    for a in range(DEPTH, len(symbols), PLACES):
        b = min(a + PLACES, len(symbols))
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(first, b))
        if hi > lo:
            size = np.minimum(end[lo:hi], b) - np.maximum(first[lo:hi], a)
            yield windows(symbols[a - DEPTH : b])[real[a:b]], lo, hi, np.cumsum(size) - size


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(1)) | U(1 << 63)


def in_order(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Of windows in parts (windows, and what belongs to them): their order with the last symbol highest, the distinct
    ones, how often each is there, and the parts with their sizes in the windows' place."""
    turned = np.concatenate([p[0] for p in parts]).byteswap()
    order = np.argsort(turned)
    distinct, number = textvec.counts_of(turned[order])
    return order.astype(np.int32), distinct, number.astype(np.int32), [(len(p[0]), *p[1:]) for p in parts]


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Places of the first of each run of equal values."""
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)) if len(ordered) else np.zeros(0, np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    at = _distinct(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(keys) else counts


def _count(texts: DataFrame) -> DataFrame:
    """kind, key, n over all texts (a column text): words by hash, windows, and the number of texts."""

    def run(batches):
        raw: dict[int, list] = {WORD: [], WINDOW: []}
        held: dict[int, list] = {WORD: [], WINDOW: []}
        number = 0

        def add(kind: int, keys: np.ndarray, least: int = TOGETHER) -> bool:
            """Whether the keys held so far were counted, once there are enough."""
            raw[kind].append(keys)
            if sum(map(len, raw[kind])) < least:
                return False
            held[kind].append(textvec.counts_of(np.sort(np.concatenate(raw[kind]))))
            raw[kind].clear()
            return True

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            keys = keys if kind == WORD else keys | U((WINDOW_TAG if kind == WINDOW else TEXT_TAG) << TAG)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

        for batch in batches:
            got = runtime.text_bytes(batch.column(0))
            number += len(got)
            for a, b in runtime.pieces(got):
                w = textvec.split_words(got[a:b], lower=True)
                new = [(WORD, word_keys(textvec.span_hashes(w.buf, w.start, w.end))), *((WINDOW, part) for part, *_ in blocks_of(*normal(w)))]
                for kind, keys in new:
                    parts = held[kind]
                    if add(kind, keys) and sum(len(k) for k, _ in parts) > HELD:
                        merged = _merged(parts)
                        if len(merged[0]) > FULL:
                            yield out(kind, *merged)
                            parts.clear()
                        else:
                            parts[:] = [merged]
        for kind, parts in held.items():
            if parts or raw[kind]:
                add(kind, np.zeros(0, np.uint64), 0)
                yield out(kind, *_merged(parts))
        if number:
            yield out(TEXT, np.zeros(1, np.uint64), np.array([number]))

    # A task has summed its own counts, so nothing is gained by another sum before the shuffle.
    summed = texts.mapInArrow(run, "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("key") < 0, WORD).when(F.shiftright("key", TAG) == WINDOW_TAG, WINDOW).otherwise(TEXT)
    return summed.select(kind.alias("kind"), "key", "n")


def _contexts(counts: DataFrame, total: int, written: list[str] | None = None) -> DataFrame:
    """len, ctx, t, nodes of all retained contexts: total, and the count of each next symbol (times 256, plus the symbol). The root is of length 0."""
    bits = lambda n: F.expr(f"shiftleft(1L, cast(8 * ({n}) AS int)) - 1")
    # a node is one long: length, context, symbol; and so is a context, c: length and symbols
    of_len = lambda n, by: F.shiftleft(F.expr(f"cast({n} AS bigint)"), by)
    each = counts.where(F.col("kind") == WINDOW).select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("len"))
    each = each.groupBy(of_len("len", 56).bitwiseOR(F.col("key").bitwiseAND(bits("len + 1"))).alias("k")).agg(F.sum("n").alias("n"))
    node = F.shiftleft("n", 8).bitwiseOR(F.col("k").bitwiseAND(F.lit(255)))
    frequent = each.groupBy(F.shiftright("k", 8).alias("c")).agg(F.sum("n").alias("t"), F.collect_list(node).alias("nodes"))
    frequent = stored(frequent.where((F.col("t") >= LEAST) | (F.col("c") == 0)), written)
    runtime.sweep(counts.sparkSession)
    flat = frequent.select("c", "t", F.size("nodes").alias("v"), F.explode("nodes").alias("node"))
    flat = flat.select("c", F.shiftright("c", 48).alias("len"), "t", "v", F.col("node").bitwiseAND(F.lit(255)).alias("sym"), F.shiftright("node", 8).alias("n"))
    after = lambda c: F.shiftleft(c, 8).bitwiseOR(F.col("sym"))
    below = flat.select(after(F.col("c")).alias("up"), F.col("n").alias("pn"), F.col("t").alias("pt"))
    suffix = of_len("len - 1", 48).bitwiseOR(F.col("c").bitwiseAND(bits("len - 1")))
    child = flat.where("len > 0").withColumn("up", after(suffix))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("t")) / (F.col("pn") / F.col("pt"))))
    good = child.join(below, "up").groupBy("c").agg(gain.alias("gain"), F.max("v").alias("v")).where(F.col("gain") >= F.col("v") * (math.log(max(total, 1)) / 2))
    closed = good.select(F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("c", 48))).alias("l"), "c")
    closed = closed.select(of_len("l", 48).bitwiseOR(F.col("c").bitwiseAND(bits("l"))).alias("c"))
    closed = closed.unionByName(frequent.where("c = 0").select("c")).distinct()
    length = F.shiftright("c", 48)
    return frequent.join(closed, "c").select(length.cast("int").alias("len"), F.col("c").bitwiseAND(F.lit((1 << 48) - 1)).alias("ctx"), "t", "nodes")


def _retained(counts: DataFrame, total: int) -> pa.Table:
    """len, ctx, sym, n of a small corpus's contexts."""
    flat = _contexts(counts, total).select("len", "ctx", F.explode("nodes").alias("node"))
    return flat.select("len", "ctx", F.col("node").bitwiseAND(F.lit(255)).alias("sym"), F.shiftright("node", 8).alias("n")).toArrow()


def _level(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of contexts of one length and their next symbols: nodes in order with the symbol highest, their counts and their
    contexts' totals; and the contexts in order with the nearest symbol highest, and their totals."""
    first = _distinct(ctx)
    totals = np.add.reduceat(n, first).astype(np.float64) if len(first) else np.zeros(0)
    key = ((ctx.astype(np.uint64) << U(8)) | sym.astype(np.uint64)).byteswap()
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.float64)
    of_node = np.repeat(totals, np.diff(np.append(first, len(ctx))))[order]
    contexts = ctx[first].astype(np.uint64).byteswap()
    by_name = np.argsort(contexts)
    return key, n, of_node, contexts[by_name], totals[by_name]


class Tree:
    """A suffix tree, or the part of it that a block's texts meet. level(k) puts the retained contexts of length k with
    their totals and next symbols in order; it is made when it is used, so that one level is held at a time."""

    def __init__(self, length: np.ndarray, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray):
        """All next symbols of a context stand one after the other."""

        def level(k: int) -> tuple:
            at = np.flatnonzero(length == k)
            return _level(ctx[at], sym[at], n[at])

        self.level = level

    @classmethod
    def of_rows(cls, keys: np.ndarray, size: np.ndarray, nodes: np.ndarray) -> Tree:
        """keys of contexts, the number of next symbols of each, and these with their counts, all in one array."""
        first = np.cumsum(size) - size

        def level(k: int) -> tuple:
            rows = np.flatnonzero(keys >> TAG == k + 1)
            own = size[rows]
            node = nodes[np.repeat(first[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            return _level(np.repeat(keys[rows] & MASK, own), node & 255, node >> 8)

        tree = cls.__new__(cls)
        tree.level = level
        return tree

    def window_logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last symbol after the others."""
        order, distinct, number, _ = in_order([(keys, 0, 0, None)])
        out = np.empty(len(keys))
        out[order] = np.repeat(self.distinct_logs(distinct), number)
        return out

    def distinct_logs(self, turned: np.ndarray) -> np.ndarray:
        """As window_logs, of distinct windows in order, with the last symbol highest and the nearest next to it.

        Those that share the last symbol and a context of any length follow one another; a context is looked up once
        for all of them, only if the one before it is retained, and by itself only if the symbol was not seen after it.
        """
        if not len(turned):
            return np.zeros(0)
        chance, before, known = np.array([1 / SYMBOLS]), np.zeros(1, np.int64), np.ones(1, bool)
        for k in range(DEPTH + 1):
            if not known.any():
                break
            key, c, of_node, contexts, totals = self.level(k)
            if not len(key):
                break
            prefix = turned & ~U((1 << 8 * (7 - k)) - 1)
            at = _distinct(prefix)
            begins = np.zeros(len(turned), bool)
            begins[before] = True
            up = np.cumsum(begins)[at] - 1
            chance, tried, before = chance[up], np.flatnonzero(known[up]), at
            low = prefix[at[tried]]
            j = np.minimum(np.searchsorted(key, low), len(key) - 1)
            seen = key[j] == low
            n, total = np.where(seen, c[j], 0.0), np.where(seen, of_node[j], 0.0)
            unseen = np.flatnonzero(~seen)
            ctx = low[unseen] << U(8)
            i = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            total[unseen] = np.where(contexts[i] == ctx, totals[i], 0.0)
            hit = total > 0
            tried = tried[hit]
            chance[tried] = (n[hit] + PULL * chance[tried]) / (total[hit] + PULL)
            known = np.zeros(len(at), bool)
            known[tried] = True
        return np.repeat(np.log10(chance), np.diff(np.append(before, len(turned))))

    def logs(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol; those of the first DEPTH are 0 and not to be used."""
        return np.concatenate((np.zeros(DEPTH), self.window_logs(windows(symbols))))


def packed(batches):
    """Rows with their nodes (arrays of longs) as bytes."""
    for batch in batches:
        nodes = batch.column("nodes")
        ends = nodes.offsets.to_numpy()
        values = np.ascontiguousarray(nodes.flatten().to_numpy())
        of_bytes = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(((ends - ends[0]) * 8).astype(np.int32)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), of_bytes], ["key", "n", "nodes"])


def _long_values(column: pa.Array) -> np.ndarray:
    """All longs of a column of bytes, one row's after the other's; a null has none."""
    if not len(column):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64) if ends[-1] > ends[0] else np.zeros(0, np.int64)


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, learned (whether it was), n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text); train: the Column that marks training rows."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("learned"))
    written: list[str] = []
    last: list[str] = []
    counts = stored(_count(docs.where("learned").select("text")), written)
    runtime.sweep(spark)
    of = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    texts = of[TEXT]["n"] if TEXT in of else 0
    total = (of[WORD]["n"] if WORD in of else 0) + texts
    distinct = (of[WORD]["v"] if WORD in of else 0) + (1 if texts else 0)
    total_symbols = of[WINDOW]["n"] if WINDOW in of else 0
    key = F.shiftleft((F.col("len") + 1).cast("long"), TAG).bitwiseOR(F.col("ctx"))
    tree = _contexts(counts, total_symbols, written).select(key.alias("key"), F.col("t").alias("n"), "nodes").mapInArrow(packed, "key long, n long, nodes binary")
    learned = stored(counts.where(F.col("kind") == WORD).select("key", "n", F.lit(None).cast("binary").alias("nodes")).unionByName(tree), last)
    runtime.drop(spark, written)  # all that goes on is the words and the retained contexts
    runtime.sweep(spark)

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def met_in(table: pa.Table) -> pa.Table:
        words, seen = [], []
        texts = runtime.text_bytes(table.column("text").combine_chunks())
        for a, b in runtime.pieces(texts):
            w = textvec.split_words(texts[a:b], lower=True)
            words.append(textvec.counts_of(np.sort(word_keys(textvec.span_hashes(w.buf, w.start, w.end)))))
            for part, *_ in blocks_of(*normal(w)):
                part = np.sort(part.byteswap() << U(8))  # without the last symbol, the nearest highest
                seen.append(part[_distinct(part)])
        ctx = np.sort(np.concatenate(seen), kind="stable")
        keys = [_merged(words)[0]]
        for k in range(DEPTH, -1, -1):
            ctx = ctx & ~U((1 << 8 * (8 - k)) - 1)
            ctx = ctx[_distinct(ctx)]
            keys.append(ctx.byteswap() | U((k + 1) << TAG))
        key = np.concatenate(keys).view(np.int64)
        return pa.table({"block": pa.array(np.full(len(key), table.column("block")[0].as_py(), np.int64)), "key": pa.array(key)})

    rest = math.log10(total + ADD * (distinct + 1)) if total else 0.0

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / 1.0) - (rest if total else math.log10(ADD))

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        keys, numbers = (found.column(c).to_numpy() for c in ("key", "n"))
        nodes = found.column("nodes").combine_chunks()
        words = keys < 0
        size = pc.binary_length(nodes).fill_null(0).to_numpy(zero_copy_only=False)[~words].astype(np.int64) // 8
        tree = Tree.of_rows(keys[~words], size, _long_values(nodes))
        del nodes, found
        keys, numbers = keys[words].view(np.uint64), numbers[words]
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        keys, numbers = np.append(keys, U(2**64 - 1)), np.append(numbers, 0)
        texts = runtime.text_bytes(table.column("text").combine_chunks())
        out, logs, parts, held = [], np.zeros(len(texts)), [], []

        def add_logs() -> None:
            if parts:
                held.append(in_order(parts))
                parts.clear()
            if not held:
                return
            every = np.sort(np.concatenate([distinct for _, distinct, *_ in held]))
            every = every[_distinct(every)]
            chance = tree.distinct_logs(every)
            for order, distinct, number, spans in held:
                each = np.empty(len(order))
                each[order] = np.repeat(chance[np.searchsorted(every, distinct)], number)
                for size, lo, hi, at in spans:
                    logs[lo:hi] += np.add.reduceat(each[:size], at)
                    each = each[size:]
            held.clear()

        for a, b in runtime.pieces(texts):
            w = textvec.split_words(texts[a:b], lower=True)
            h = word_keys(textvec.span_hashes(w.buf, w.start, w.end))
            at = np.searchsorted(keys[:-1], h)
            c = np.where(keys[at] == h, numbers[at], 0)
            n = b - a
            doc = w.doc
            end = float(base(np.array([texts_seen]))[0])
            for part, lo, hi, at in blocks_of(*normal(w)):
                parts.append((part, a + lo, a + hi, at))
                if sum(len(p) for p, *_ in parts) >= TOGETHER:
                    held.append(in_order(parts))
                    parts.clear()
                    if sum(len(order) for order, *_ in held) >= SCORED:
                        add_logs()
            out.append((np.diff(w.first) + 1, np.bincount(doc, c > 0, n).astype(np.int64) + (texts_seen > 0), np.bincount(doc, base(c), n) + end))
        add_logs()
        tokens, seen, score0 = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": table.column("doc_id"), "learned": table.column("learned"), "n_tokens": tokens.astype(np.int64), "n_known": seen, "train_tokens": np.full(len(tokens), total), "base_score": score0, "score": logs})

    texts_seen = texts
    scored = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FOUND_ROWS))  # a block's texts are a table in any case
    for turn in range(min(TURNS, blocks)):
        part = dealt.where(F.col("block") % TURNS == turn)
        met = part.groupBy("block").applyInArrow(met_in, "block long, key long")
        known = met.join(learned, "key").select("block", "key", "n", "nodes")
        out = part.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        scored.append(stored(out))
        runtime.sweep(spark)
    runtime.prepare(spark)
    runtime.drop(spark, last)
    return reduce(DataFrame.unionByName, scored)
