"""Near-duplicate documents: MinHash with banding, verification, and connected components.

1. A document's set is its distinct word shingles (64-bit hashes). Equal sets are one class, and only classes go on,
   so groups of copies of any size cost nothing further.
2. Minima of universal hashes a*x + b modulo 2**64, four to a band; enough bands that a pair at the threshold is
   missed by all with a chance of 1e-9.
3. First round: in each bucket all are compared with one centre, chosen by a hash: as many pairs as members. Pairs
   pass if their signatures agree well enough, then if their full sets do.
4. Components by alternating large-star and small-star until nothing changes.
5. Second round: members of a bucket that are in different components still are compared with each other, those
   already compared with the centre aside. Buckets with many of them form crowds, which are compared in blocks: a task
   holds the sets of two blocks and gives only links that join components, never pairs. Then components again.

No bucket, group or candidate list is capped. Centres with many members are verified in salted groups.

Edge cases: null and empty texts have an empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows with the same id are one node, whatever their texts (linked with all that any of them is
linked with), and each has its own text's set size; repeated rows of an id that is kept are all marked kept; a row with a null id is linked with nothing, has a null
component and is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.llm import runtime, textvec
from glossmill.llm.runtime import checkpoint
from glossmill.llm.textvec import U

ROWS, MISS = 4, 1e-9
#: Signatures that agree by this much less than the threshold are not verified: seven standard deviations or more.
SLACK = 0.27
#: Pairs of a centre that one task verifies at a time; members of a bucket up to which all are paired directly.
GROUP, DIRECT = 128, 32
#: Members of a crowd in a block.
BLOCK = 512
#: Ids that are broadcast to pick their texts; with more, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, and where each text's begin."""
    w = textvec.split_words(texts, lower=True)
    total = len(w.start)
    words = textvec.span_hashes(w.buf, w.start, w.end)
    count = np.diff(w.first)
    full = textvec.ngram_hash(words, size)[textvec.inside(w.first, size, total)] if total else words
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(first[-1], np.uint64)
    whole = np.repeat(count >= size, number)
    out[whole] = full
    for i in np.flatnonzero((count > 0) & (count < size)):
        a, b = w.first[i], w.first[i + 1]
        out[first[i]] = textvec.ngram_hash(words[a:b], b - a)[0] ^ U(b - a)
    return out, first


def distinct(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def signatures(docs: DataFrame, size: int, bands: int, text: str = "text") -> DataFrame:
    """docs with n, s1, s2 (the set's size and hash), sig (binary) and bands (array of keys)."""
    rng = np.random.default_rng(41)
    k = bands * ROWS
    mul = rng.integers(1, 2**63, k, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 2**63, k, dtype=np.uint64) * U(2)

    def make():
        def step(texts: list[bytes]):
            hashes, first = shingles(texts, size)
            sets = distinct(hashes, first)
            n = np.array([len(s) for s in sets], np.int64)
            rows = np.flatnonzero(n)
            unique = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = (np.cumsum(n) - n)[rows]
            minima = np.zeros((len(texts), k), np.uint64)
            s1, s2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            if len(rows):
                for j in range(k):
                    minima[rows, j] = np.minimum.reduceat(unique * mul[j] + add[j], at)
                s1[rows] = np.add.reduceat(textvec.mix(unique), at)
                s2[rows] = np.bitwise_xor.reduceat(textvec.mix(unique + U(0x51ED270B)), at)
            keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(texts), 0)
            for j in range(ROWS):
                keys = textvec.mix(keys * U(0x9E3779B97F4A7C15) + minima[:, j::ROWS])
            sig = (minima >> U(32)).astype(np.uint32)
            keys[n == 0] = 0
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            return [pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary()), arrays]

        return step

    long = T.LongType()
    fields = [T.StructField("n", long), T.StructField("s1", long), T.StructField("s2", long), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(long))]
    return runtime.append_columns(docs, text, fields, make)


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and set (array of hashes) of the documents with these ids (a column id, distinct)."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"] == ids["id"]).select("id", "text")

    def make():
        def step(batch: list[bytes]):
            sets = distinct(*shingles(batch, size))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))]

        return step

    return runtime.append_columns(texts, "text", [T.StructField("set", T.ArrayType(T.LongType()))], make).drop("text")


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in such a share of their minima at least."""
    sig = lambda name: reps.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"))

    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            same = np.array([np.mean(np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(same >= least, pa.bool_()))

    both = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the Jaccard similarity."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / GROUP)).alias("salt"))
    wanted = checkpoint(dealt.select("a", "salt", F.col("b").alias("id")).unionByName(dealt.select("a", "salt", F.col("a").alias("id")).distinct()))
    sets = _sets(docs, wanted.select("id").distinct(), size)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        a = table.column("a")[0].as_py()
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("set").combine_chunks()]
        hit = set()
        for centre in (s for i, s in zip(ids, sets, strict=True) if i == a):
            for i, s in zip(ids, sets, strict=True):
                if i != a and len(s) and len(centre):
                    both = int((centre[np.minimum(np.searchsorted(centre, s), len(centre) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(centre) - both):
                        hit.add(int(i))
        return pa.table({"a": pa.array([a] * len(hit), pa.int64()), "b": pa.array(sorted(hit), pa.int64())})

    return wanted.join(sets, "id").groupBy("a", "salt").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges (a, b): the smallest node that it is linked with."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        runtime.sweep(e.sparkSession)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _pairs(rows: DataFrame, *key: str) -> DataFrame:
    """Pairs (a, b) of rows (key, rep, comp) with the same key and different components."""
    other = rows.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("rep").alias("_rep"), F.col("comp").alias("_comp"))
    same: Column = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(other, same & (F.col("rep") < F.col("_rep")) & (F.col("comp") != F.col("_comp"))).select(F.col("rep").alias("a"), F.col("_rep").alias("b"))


def _crowd_links(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components in crowds; rows: key, rep, comp of the crowded buckets.

    Buckets that share members are one crowd. A crowd is cut into blocks of BLOCK members, and each pair of blocks
    is a task, which compares the full sets of members of different components and gives only links that join
    components which it has not joined yet: as many rows as members at most, and no pairs.
    """
    hub = rows.groupBy("key").agg(F.min("rep").alias("hub"))
    crowd = components(rows.join(hub, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    members = rows.select("rep", "comp").distinct().join(crowd, F.col("rep") == F.col("node")).select("rep", "comp", F.col("component").alias("crowd"))
    number = members.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks"))
    placed = members.join(number.where("lo <> hi"), "crowd").withColumn("own", own)
    placed = placed.select("crowd", "rep", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    placed = checkpoint(placed.select("crowd", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "comp", "own"))
    sets = _sets(docs, placed.select(F.col("rep").alias("id")).distinct(), size)

    def run(table: pa.Table) -> pa.Table:
        rep, comp, own = (table.column(c).to_numpy() for c in ("rep", "comp", "own"))
        held = table.column("set").combine_chunks()
        flat, ends = held.flatten().to_numpy().view(np.uint64), np.diff(held.offsets.to_numpy())
        first = np.cumsum(ends) - ends
        crossing = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        # texts of small components are held against all others; each pair once is enough
        total = dict(zip(*np.unique(comp, return_counts=True), strict=True))
        weight = np.array([total[c] for c in comp])
        links = []
        for q in np.lexsort((rep, weight)).tolist():
            other = (comp != comp[q]) & ((weight > weight[q]) | ((weight == weight[q]) & (rep > rep[q])))
            if crossing:
                other &= own != own[q]
            n = int(ends[q])
            other &= (100 * np.minimum(ends, n) >= percent * np.maximum(ends, n)) & (ends > 0)
            near = np.flatnonzero(other)
            if not len(near) or not n:
                continue
            mine = flat[first[q] : first[q] + n]
            pick = np.concatenate([flat[first[k] : first[k] + ends[k]] for k in near])
            at = np.minimum(np.searchsorted(mine, pick), n - 1)
            both = np.add.reduceat((mine[at] == pick).astype(np.int64), np.cumsum(ends[near]) - ends[near])
            for k in near[100 * both >= percent * (n + ends[near] - both)].tolist():
                x, y = find(int(comp[q])), find(int(comp[k]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append(sorted((int(rep[q]), int(rep[k]))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return placed.join(sets, placed["rep"] == sets["id"]).groupBy("crowd", "i", "j").applyInArrow(run, "a long, b long")


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """label (node, component) with further links (a, b): components of components, as few as the links are."""
    named = more
    for side in "ab":
        own = label.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        named = named.join(own, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    above = checkpoint(components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    nodes = label.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").withColumn("component", F.col("node")))
    return nodes.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _one_id_many_texts(docs: DataFrame, ids: DataFrame, size: int, percent: int) -> DataFrame:
    """As near_duplicates where some ids (a column id) have rows of different texts: each text is a node of its own, and an id's nodes are linked."""
    ids = ids.select("id", F.lit(True).alias("many"))
    named = docs.join(ids, F.col("doc_id") == F.col("id"), "left")
    node = F.when(F.col("many"), F.xxhash64("doc_id", "text", F.lit("node"))).otherwise(F.col("doc_id"))
    named = checkpoint(named.select("doc_id", "text", "many", node.alias("node")))
    got = near_duplicates(named.select(F.col("node").alias("doc_id"), "text"), size, percent).where("doc_id IS NOT NULL AND component_id IS NOT NULL")
    got = checkpoint(got.select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("c")).distinct())
    of_ids = named.where("many").select("doc_id", "node").distinct().join(got.select("node", "c"), "node")
    bound = of_ids.groupBy("doc_id").agg(F.min("c").alias("b")).join(of_ids, "doc_id").select(F.col("c").alias("a"), "b")
    above = components(bound)
    rows = named.select("doc_id", "node").join(got, "node", "left").join(above.withColumnRenamed("node", "c"), "c", "left").select("doc_id", "n_shingles", F.coalesce("component", "c").alias("c"))
    rows = checkpoint(rows)
    least = checkpoint(rows.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id")))
    rows = rows.join(least, "c", "left").withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0)))
    null_ids = signatures(docs.where("doc_id IS NULL"), size, 1).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = rows.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "component_id").unionByName(null_ids)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    runtime.prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    bands = bands_for(percent)
    signed = checkpoint(signatures(docs, size, bands).drop("text"))
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    # an empty text is no class of its own: it brings its id no link
    repeated = signed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("k"), *(f(c).alias(f"{c}_{n}") for c in ("s1", "s2", "n") for n, f in (("lo", F.min), ("hi", F.max))))
    repeated = repeated.where("k > 1 AND (s1_lo <> s1_hi OR s2_lo <> s2_hi OR n_lo <> n_hi)").select("id")
    if repeated.head(1):
        return _one_id_many_texts(docs, checkpoint(repeated), size, percent)
    reps = checkpoint(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    placed = reps.select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    # one row a key is written out before each join with it: then both sides are plain shuffles, and a hot key's is split
    shared = checkpoint(shared)
    multi = placed.join(shared, "key")
    multi = checkpoint(multi)
    centre = checkpoint(multi.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("centre")))
    spokes = multi.join(centre, "key")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    first = spokes.where("rep <> centre").select(*pair("rep", "centre")).distinct()
    links = checkpoint(_linked(checkpoint(_agreeing(first, reps, percent / 100 - SLACK)), docs, size, percent))
    label = components(links)

    rest = spokes.where("rep <> centre").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    rest = rest.select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = rest.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "c")
    rest = checkpoint(rest.join(checkpoint(mixed), "key"))
    few = _pairs(rest.where(F.col("c") <= DIRECT), "key")
    many = checkpoint(rest.where(F.col("c") > DIRECT).select("key", "rep", "comp"))
    again = checkpoint(_agreeing(few.distinct(), reps, percent / 100 - SLACK))
    more = _linked(again, docs, size, percent)
    if many.head(1):
        more = more.unionByName(_crowd_links(many, docs, size, percent))
    more = checkpoint(more)
    if more.head(1):
        label = _joined(label, more)

    names = reps.select("s1", "s2", "n", "rep").join(label, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("c"))
    linked = real.select("doc_id", "s1", "s2", "n").join(names, ["s1", "s2", "n"]).select("doc_id", "n", "c")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("c"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))
