"""Operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import collections
import hashlib
import io
import math
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import bpe_automaton, chat_format, hyperlang, media, mixing, neardup, quality, queries, repetition, runtime, suffix_lm, toxicity

SIZE = lambda t: len((t or "").encode().split())


def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet'").fetchall()


# ---- mixing
def filled(sizes, weights=(5, 2, 1), most=3):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / max(1e-9, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in rest}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_totals(spark, sf):
    rows = queries.op1_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in documents(sf))
    sizes = collections.Counter()
    for _, t, _, s in documents(sf):
        sizes[s] += SIZE(t)
    want = filled(sizes)
    taken, least = collections.Counter(), {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
        least[r["source"]] = min(least.get(r["source"], r["size"]), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], least[s])
    assert {(r["doc_id"], r["taken"]) for r in queries.op1_mixing(spark, sf).collect()} == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixing_many_buckets_is_unbiased(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("x"), F.count("*").alias("n"), F.max("copies").alias("c")).collect()
    assert sum(r["n"] for r in got) == 6000
    for r in got:
        assert abs(r["t"] - r["x"]) <= 10 and r["c"] <= 3


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(no_docs).count() == 0
    again = mixing.apply_mix(odd_docs)
    assert again.columns == odd_docs.columns and again.count() == sum(r["copies"] for r in rows)


def test_names_of_any_kind_stay(spark, odd_docs):
    """Columns named as those that the operators use inside, or with dots, come out as they went in; those named as new ones are replaced."""
    names = ["h", "id", "nth", "k", "hash", "copies", "row", "col", "_hash", "_row", "_copy", "_id", "_h", "_k", "_copies", "bucket", "a.b", "source_", "media", "n_tokens", "ids"]
    docs = odd_docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id"), F.lit(-1))) for n in names})
    for r in mixing.apply_mix(docs).collect():
        assert all(r[n] == f"{n}:{-1 if r['doc_id'] is None else r['doc_id']}" for n in names)
    path = queries.vocabulary_path()
    coded = bpe_automaton.digests(bpe_automaton.encode(docs, path), path)
    tiled = media.with_tiles(media.store_text(docs))
    for got, new in ((coded, {"n_tokens", "ids"}), (tiled, {"media"})):
        assert len(got.columns) == len(set(got.columns))
        for r in got.collect():
            assert all(r[n] == f"{n}:{-1 if r['doc_id'] is None else r['doc_id']}" for n in names if n not in new)


def brute_pairs(rows, level):
    """The fold of one bucket, written out: words pass between the open document and the next."""
    chance = lambda a, b: (int(_hash(a, b, level)) & (1 << 64) - 1) >> 11
    open_, done = None, {}
    for h, i, size, base, p in sorted(rows):
        if p <= 1e-12 or p >= 1 - 1e-12:
            done[i] = base + (p > 0.5)
        elif open_ is None:
            open_ = (h, i, size, base, p)
        else:
            ah, ai, asize, abase, ap = open_
            up, down = min((1 - ap) * asize, p * size), min((1 - p) * size, ap * asize)
            gain, lose = ((ah, ai, asize, abase, ap), (h, i, size, base, p)) if chance(ah, h) / (1 << 53) * (up + down) < down else ((h, i, size, base, p), (ah, ai, asize, abase, ap))
            room, has = (1 - gain[4]) * gain[2], lose[4] * lose[2]
            open_ = None
            if room <= has:
                done[gain[1]] = gain[3] + 1
            if has <= room:
                done[lose[1]] = lose[3]
            if room < has:
                open_ = (*lose[:4], lose[4] - room / lose[2])
            elif has < room:
                open_ = (*gain[:4], gain[4] + has / gain[2])
    return done, open_


_hashes = {}


def _hash(a, b, level):
    return _hashes[a, b, level]


def test_pivotal_fold_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1 << 40), i, rng.randrange(1, 30), rng.randrange(2), rng.choice([0.0, 1.0, rng.random(), 0.5])) for i in range(40)]
    both = [(a[0], b[0]) for a in rows for b in rows if a != b]
    for r in spark.createDataFrame(both, "a long, b long").select("a", "b", F.xxhash64("a", "b", F.lit(0)).alias("x")).collect():
        _hashes[r["a"], r["b"], 0] = r["x"]
    df = spark.createDataFrame([("s", 0, *r) for r in rows], "source string, bucket long, h long, doc_id long, size long, base long, p double")
    got = mixing._fold(df, 0).first()
    done, open_ = brute_pairs(rows, 0)
    assert {d["doc_id"]: d["copies"] for d in got["done"]} == done
    assert (got["open"] is None) == (open_ is None) and (open_ is None or (got["open"]["doc_id"], got["open"]["p"]) == (open_[1], pytest.approx(open_[4])))


# ---- classifiers
@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.85), ("op3_quality", "quality", 0.9)])
def test_classifiers_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels if i in got and got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) >= least


@pytest.mark.parametrize("method,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_odd_rows(spark, odd_docs, no_docs, method, label):
    for rows in ([], [(1, 1)], [(1, 0), (5, 1), (6, None), (None, 1), (4, 0), (4, 1)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        model = method.learn(odd_docs, labels, runtime.crc_mod("doc_id", 5) >= 0, label)
        got = method.predict(odd_docs, model, name="own").collect()
        assert len(got) == 10 and all(0 <= r["own"] <= 1 for r in got)
        assert method.predict(no_docs, model, name="own").count() == 0
    assert got[5]["own"] == got[6]["own"]


def test_machine_equals_sum_over_pairs():
    """The score is the logistic of the bias, the weights and the products of all pairs of factors."""
    rng = np.random.default_rng(3)
    texts = [b"alpha beta gamma", b"beta", b"", b"Alpha delta delta"]
    chosen = np.unique(toxicity.terms(texts)[0])
    machine = toxicity.Machine(-0.3, chosen, rng.normal(size=len(chosen)), rng.normal(size=(len(chosen), 3)))
    for text, got in zip(texts, machine.score(texts), strict=True):
        on = np.searchsorted(chosen, np.unique(toxicity.terms([text])[0]))
        z = -0.3 + sum(machine.weights[i] for i in on) + sum(machine.factors[i] @ machine.factors[j] for i in on for j in on if i < j)
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_word_vectors_equal_brute_force():
    """Random indexing, one neighbour at a time, and pooling, one text at a time."""
    texts = [b"One two, THREE 44 five", b"", b"six six six seven two", b"x"]
    shape, word, first, plain = quality.units(texts)
    index = quality.index_vectors(12)
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            for j in range(a, b):
                if 0 < abs(i - j) <= quality.WINDOW:
                    want[word[i]] += index[word[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    assert np.allclose(quality.word_vectors(word, first, 12), want, atol=1e-6)
    net = quality.Network(0.0)
    net.shapes, net.words = quality.word_vectors(shape, first, 11), want
    pooled = net.pooled(shape, word, first, plain)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = [net.shapes[s] for s in shape[a:b]]
        parts = [np.mean(own, 0), np.std(own, 0), np.mean([want[x] for x in word[a:b]], 0)] if b > a else [np.zeros(3 * quality.DIM)]
        assert np.allclose(pooled[k], np.concatenate([*parts, plain[k]]), atol=2e-3)


def test_long_texts_are_hashed_the_same_in_blocks(monkeypatch):
    from glossmill.llm import textvec

    texts = [b"lorem ipsum dolor sit amet " * 40, b"", b"x" * 700, "wörter über 12 ABC".encode()]
    whole = [toxicity.terms(texts), quality.units(texts), list(repetition.measure(texts).values()), [neardup.shingles(texts, 3)[0]], [hyperlang.bundles(texts)]]
    monkeypatch.setattr(textvec, "BLOCK", 64)
    monkeypatch.setattr(hyperlang, "PIECE", 100)
    parts = [toxicity.terms(texts), quality.units(texts), list(repetition.measure(texts).values()), [neardup.shingles(texts, 3)[0]], [hyperlang.bundles(texts)]]
    for a, b in zip(whole, parts, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "a longer text of the same id"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None)], "doc_id long, toxic int")
    from glossmill.llm import labelled

    rows, share = labelled.sample(docs, labels, "toxic", F.lit(True), most=10)
    assert share == 0.5 and rows.groupBy("y").count().collect() == [(1, 10), (0, 10)] or rows.count() == 20
    rows, _ = labelled.sample(docs, labels, "toxic", F.lit(True), most_bytes=450)
    assert 4 <= rows.count() <= 8


def test_factorization_learns_a_pair():
    """Only two terms together make label 1."""
    rng = random.Random(2)
    texts, y = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"filler{rng.randrange(50)}" for _ in range(5)] + ["insult"] * a + ["group"] * b).encode())
        y.append(float(a and b))
    machine = toxicity.fit([np.unique(toxicity.terms([t])[0]) for t in texts], np.array(y, np.float32), float(np.mean(y)))
    assert ((machine.score(texts) >= 0.5) == (np.array(y) == 1)).mean() > 0.98


# ---- language model
def brute_base(docs, learned):
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    c = collections.Counter(w for i, t in docs if learned(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in docs}


def test_language_model_base(spark, sf):
    rows = queries.op4_suffix_lm(spark, sf).collect()
    want = brute_base([(i, t) for i, t, _, _ in documents(sf)], lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0


def brute_tree_score(tree_rows, text):
    """Longest retained suffix, smoothed down to the root, one symbol at a time."""
    counts = collections.defaultdict(collections.Counter)
    for a, b, c, d in tree_rows:
        counts[a, b][c] += d

    def chance(a, b, x):
        below = chance(a - 1, b & (1 << 8 * (a - 1)) - 1, x) if a else 1 / suffix_lm.SYMBOLS
        if (a, b) not in counts:
            return below
        return (counts[a, b][x] + suffix_lm.PULL * below) / (sum(counts[a, b].values()) + suffix_lm.PULL)

    symbols = [10] * suffix_lm.DEPTH + [*b" ".join(text.encode().lower().split()), 10]
    out = 0.0
    for i in range(suffix_lm.DEPTH, len(symbols)):
        ctx = [(k, int.from_bytes(bytes(symbols[i - k : i]), "big")) for k in range(suffix_lm.DEPTH, -1, -1)]
        a, b = next((c for c in ctx if c in counts), (0, 0))
        out += math.log10(chance(a, b, symbols[i]))
    return out


def test_suffix_automaton_equals_brute_force(spark, sf):
    texts = [t for _, t, _, _ in documents(sf)][:60]
    counts = suffix_lm._count(spark.createDataFrame([(t,) for t in texts[:40]], "text string"))
    total = sum(r["n"] for r in counts.where("kind = 1").collect())
    kept = suffix_lm._retained(runtime.checkpoint(counts), total)
    columns = [kept.column(c).to_numpy() for c in ("len", "ctx", "sym", "n")]
    assert columns[0].max() > 1
    tree = suffix_lm.Tree(*columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    for text in ["", "The A", "zzz qqq é", *texts[38:44]]:
        from glossmill.llm import textvec

        symbols, place, _ = suffix_lm.normal(textvec.split_words([text.encode()], lower=True))
        assert float(tree.logs(symbols)[place].sum()) == pytest.approx(brute_tree_score(rows, text), rel=1e-4)


def test_suffix_tree_grows_with_the_corpus(spark):
    """A context seen 10 times that settles its next symbol is kept, however many other texts there are."""
    for times in (1, 100):
        rows = [("qx qx qx qx qx",)] * 2 + [("some other words that say the same",)] * 1000 * times
        counts = runtime.checkpoint(suffix_lm._count(spark.createDataFrame(rows, "text string")))
        total = counts.where("kind = 1").agg(F.sum("n")).first()[0]
        kept = suffix_lm._retained(counts, total)
        assert (1, ord("q")) in set(zip(kept.column("len").to_pylist(), kept.column("ctx").to_pylist(), strict=True))


def test_language_model_odd_rows(spark, odd_docs, no_docs):
    rows = suffix_lm.score(odd_docs, runtime.crc_mod("doc_id", 10) != 0).collect()
    assert len(rows) == 10 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert suffix_lm.score(no_docs, runtime.crc_mod("doc_id", 10) != 0).count() == 0


# ---- media
def test_media_round_trips():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (13, 7)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P5 # note\n7 13\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2\n7 13\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    rgb = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert (media.decode(b"P6\n5 4\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P4\n10 1\n\xff\x00")[0] == [0] * 8 + [255] * 2).all()
    wide = rng.integers(0, 65536, (3, 4)).astype(">u2")
    assert (media.decode(b"P5\n4 3\n65535\n" + wide.tobytes()) == wide).all()
    for broken in (b"P5\n0 0\n255\n", b"P2\n2 1\n255\n300 1", b"P2\n2 1\n255\n-3 1", b"P5\n1 1\n100\n\xff", b"P5\n1 1\n0\n\0", b"P1\n3 3\n10", b"BM", media.encode_bmp(grey)[:400]):
        assert media.decode(broken) is None
    masks = bytearray(media.encode_bmp(grey))
    masks[30] = 3
    assert media.decode(bytes(masks)) is None
    tall = rng.integers(0, 256, (media.LONG + 77, 64)).astype(np.uint8)
    short = media.area_resize(tall, 64, 64)
    media_long, media.LONG = media.LONG, 1 << 30
    assert np.allclose(short, media.area_resize(tall, 64, 64))
    media.LONG = media_long
    assert media.decode(b"P5\n9 9\n255\nshort") is None and media.decode(b"GIF89a") is None and media.decode(None) is None


def test_area_resize_is_the_mean():
    x = np.random.default_rng(2).integers(0, 256, (37, 64)).astype(np.uint8)
    fine = np.repeat(np.repeat(x, 5, 0), 9, 1).reshape(5, 37, 9, 64).mean((1, 3))
    assert np.allclose(media.area_resize(x, 5, 9), fine)


def test_media_query(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op5_media(spark, sf).collect()}
    for i, text, _, _ in documents(sf):
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = media.encode_bmp(grey) if zlib.crc32(payload) % 2 else b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = rows[i]
        assert r["n_tiles"] == 4 and r["tiles_sha256"] == hashlib.sha256(b"".join(n for n, _ in media.tiles(grey))).hexdigest()
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(data), len(payload), len(stored), zlib.crc32(payload[-64:]))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())


def test_media_odd_rows(spark, odd_docs, no_docs):
    got = media.with_tiles(media.store_text(odd_docs)).collect()
    assert len(got) == 10 and np.load(io.BytesIO(got[4]["tiles"][0]["npy"])).shape == (32, 32)
    assert got[4]["tiles"] == got[5]["tiles"] and media.read_back(media.store_text(no_docs)).count() == 0


# ---- tokenizer
@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path())


def test_tokens_equal_library(tokenizer, monkeypatch):
    with open(queries.vocabulary_path(), "rb") as f:
        encoder = bpe_automaton.encoder_of(f.read())
    rng = random.Random(1)
    alphabet = "aabbttthhe ' 's'll'd're  \n\t\r\x0b\x1c\x85\xa0 é漢字١٢½Ⅷ😀-_!?**0099<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x33000), rng.randrange(32, 0x250)])) for _ in range(40)) for _ in range(1500)]
    texts += ["a" * k for k in range(1, 300, 7)] + ["", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "'tis 'S it's we'll''s", " " * 9 + "x", "\n\n x", "-" * 5000]
    for text in texts:
        ids, want = encoder.encode(text), tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert encoder.automaton.decode(ids).decode("utf-8", "replace") == tokenizer.decode(want, skip_special_tokens=False)
    monkeypatch.setattr(bpe_automaton, "MOST_STATES", 37)
    monkeypatch.setattr(bpe_automaton, "SPLIT", 20)
    monkeypatch.setattr(bpe_automaton, "CACHE_WORDS", 5)
    for text in [*texts[:300], *texts[-8:]]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_automaton_equals_merging():
    """A small random vocabulary, all words up to a length, against merging by rank."""
    import itertools

    rng = random.Random(9)
    labels, merges = {0: b"a", 1: b"b"}, []
    while len(labels) < 14:
        a, b = rng.choice(list(labels)), rng.choice(list(labels))
        label = labels[a] + labels[b]
        if label not in labels.values() and len(label) < 7:
            merges.append((a, b, len(labels)))
            labels[len(labels)] = label
    table = bpe_automaton.Automaton(labels, merges, {}, np.zeros(0x110000, np.uint8))

    def merged(word):
        seq = [0 if x == 97 else 1 for x in word]
        for a, b, c in merges:
            i, out = 0, []
            while i < len(seq):
                hit = seq[i : i + 2] == [a, b]
                out.append(c if hit else seq[i])
                i += 2 if hit else 1
            seq = out
        return seq

    words = [bytes(w) for n in range(1, 11) for w in itertools.product(b"ab", repeat=n)]
    assert [table.word(w) for w in words] == [merged(w) for w in words]
    # what a word takes is one look-up a byte: all transitions are in the table by now
    table._compile = None
    assert [table.word(w) for w in words] == [merged(w) for w in words]


def test_bpe_odd_rows(spark, odd_docs, no_docs, tokenizer):
    path = queries.vocabulary_path()
    rows = bpe_automaton.decode(bpe_automaton.encode(odd_docs, path), path).collect()
    assert [r["decoded"] for r in rows] == [r["text"] or "" for r in rows] and len(rows) == 10
    assert bpe_automaton.digests(bpe_automaton.encode(no_docs, path), path).count() == 0


# ---- chat
def test_chat_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = sorted(map(tuple, queries.op7_chat(spark, sf).select(*names).collect()))
    assert got == sorted(con.sql(queries.OP7_SQL).select(*names).fetchall())


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} \\<turn x>\\l " + "y" * (k % 5 * 20)) for k in range(1, 40)]
    turns += [(2, 0, None, None), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, "user", "x"), (3, 1, "assistant", "z" * 3000), (3, 2, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(df, budget=140, longest=40, history=2, history_tokens=60, system=10)
    assert made.where("conv_id = 1").count() > 3
    back = {}
    for r in sorted(chat_format.read_back(made).collect(), key=lambda r: (str(r["conv_id"]), r["window"])):
        turns_, loss = back.setdefault(r["conv_id"], ([], []))
        turns_ += [tuple(t) for t in r["turns"]]
        loss.append(r["loss_text"])
    for conv in (1, 2, 3, None):
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert back[conv][0] == [(t[2] or "", t[3] or "") for t in own]
        assert "".join(back[conv][1]) == "".join(t[3] for t in own if t[2] == "assistant")
    first = made.where("conv_id = 1 AND window = 2").first()
    assert first["text"].startswith("<turn system>be kind</turn>\n") and 1 <= first["n_repeated"] <= 3
    for r in made.where("conv_id = 1").collect():
        fresh = r["text"].split("</turn>\n")[r["n_repeated"] : -1]
        assert sum(max(1, (len(chat_format_text(x)) + 3) // 4) for x in r["text"].split("</turn>\n")[:-1]) <= 140 and fresh
    assert chat_format.digests(chat_format.windows(df.where("false"))).count() == 0


def chat_format_text(piece):
    text = piece.split(">", 1)[1]
    for plain, coded in reversed(chat_format.ESCAPES):
        text = text.replace(coded, plain)
    return text


# ---- near duplicates
def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("direct,group", [(64, 128), (1, 4)])
def test_near_duplicates(spark, monkeypatch, direct, group):
    """direct=1: all buckets are crowds, in blocks of a few; group=4: centres are salted."""
    monkeypatch.setattr(neardup, "DIRECT", direct)
    monkeypatch.setattr(neardup, "BLOCK", 5 if direct == 1 else 512)
    monkeypatch.setattr(neardup, "GROUP", group)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(own))
    texts += ["", "one", "one two", "ONE  two", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_components(rows, 3, 85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: c for n, c in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_one_id_with_different_texts(spark):
    """Ids 5 and 7 have two texts each: all that any of them is linked with is one component."""
    t = ["the cat sat on the mat and slept there all day long", "a dog ran over the hill and barked at every passing car", "some birds sang in the tree while it rained on us all", "nothing like the others is said here by anyone at all"]
    rows = [(3, t[0]), (5, t[0]), (5, t[1]), (9, t[1]), (7, t[2]), (7, None), (8, t[2]), (2, t[3]), (2, t[3]), (None, t[0]), (11, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7, 2: 2, None: None, 11: 11}
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 7) == [0, 10]


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(rows) == 10 and [r["component_id"] for r in rows if r["doc_id"] in (5, 6)] == [5, 5, 5]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert neardup.near_duplicates(no_docs).count() == 0


# ---- repetition
def brute_repetition(text):
    w = (text or "").encode().split()
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = collections.Counter(x for x in (text or "").encode().split(b"\n") if x.split())
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(inside)


def brute_shares(text):
    """Characters in words inside duplicated n-grams, for each n, and in lines equal to an earlier one, over all."""
    words = (text or "").encode().split()
    size = [len(x.decode()) for x in words]
    out = []
    for n in repetition.NGRAM_LIMITS:
        count = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if count[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        out.append(sum(size[j] for j in inside) / max(1, sum(size)))
    seen, again = set(), 0
    for line in (text or "").encode().split(b"\n"):
        again += sum(len(x.decode()) for x in line.split()) if line in seen else 0
        seen.add(line)
    return [*out, again / max(1, sum(size))]


def test_repetition(spark, sf, odd_docs, no_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = {r["doc_id"]: r for r in queries.op9_repetition(spark, sf).collect()}
    for i, text, _, _ in documents(sf):
        want = brute_repetition(text)
        assert tuple(rows[i][n] for n in names) == want
        shares = brute_shares(text)
        assert [rows[i][f"dup_{n}gram_chars"] for n in repetition.NGRAM_LIMITS] + [rows[i]["dup_line_chars"]] == [pytest.approx(s) for s in shares]
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and all(s <= most for s, most in zip(shares, [*repetition.NGRAM_LIMITS.values(), repetition.LINE_LIMIT], strict=True)))
        assert rows[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (rows[i]["base_failed"] and rows[i]["kept"])
    got = repetition.repetition_rules(odd_docs, prefix="r_").collect()
    assert [tuple(r[f"r_{n}"] for n in names) for r in got] == [brute_repetition(r["text"]) for r in got]
    assert repetition.repetition_rules(no_docs, prefix="r_").count() == 0


# ---- language
def test_language(spark, sf, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in queries.op10_language(spark, sf).collect()}
    truth = {i: lang for i, _, lang, _ in documents(sf)}
    held = [r["lang_pred"] == truth[i] for i, r in rows.items() if r["held_out"]]
    assert np.mean(held) > 0.95 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    # brute force: letter vectors bound by place, bundled, and compared by cosine
    names, prototypes = hyperlang.learn(spark.createDataFrame([(x, l) for _, x, l, _ in documents(sf)], "text string, lang string"))
    letters, vectors = hyperlang.letter_classes(), np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (hyperlang.CLASSES, hyperlang.DIM))

    def bundle(text):
        codes = [0]
        for c in text.lower():
            if letters[ord(c)] or codes[-1]:
                codes.append(int(letters[ord(c)]))
        codes += [0] * (codes[-1] != 0)
        total = np.zeros(hyperlang.DIM)
        for a, b, c in zip(codes, codes[1:], codes[2:]):  # noqa: B905
            if b:
                total += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
        return total / max(np.linalg.norm(total), 1e-12)

    some = [(i, x) for i, x, _, _ in documents(sf) if x][:25]
    sums = {n: sum(bundle(x) for _, x, l, _ in documents(sf) if l == n) for n in names[:1]}
    assert all(np.allclose(v / np.linalg.norm(v), prototypes[names.index(n)], atol=1e-4) for n, v in sums.items())
    got = hyperlang.predict(spark.createDataFrame(some, "doc_id long, text string"), (names, prototypes)).collect()
    for r, (_, x) in zip(sorted(got), sorted(some), strict=True):
        cosines = prototypes @ bundle(x)
        assert r["lang_pred"] == names[int(np.argmax(np.round(cosines, 5)))] and r["score"] == pytest.approx(max(cosines), abs=1e-4)
    model = hyperlang.learn(odd_docs)
    got = hyperlang.predict(odd_docs, model, prefix="p_").collect()
    assert [(r["p_lang_pred"], r["p_score"]) for r in got[:3]] == [("und", 0.0)] * 3 and got[5]["p_lang_pred"] == got[6]["p_lang_pred"]
    assert hyperlang.predict(no_docs, hyperlang.learn(no_docs), prefix="p_").count() == 0
    assert {r["p_lang_pred"] for r in hyperlang.predict(odd_docs, ([], np.zeros((0, hyperlang.DIM))), prefix="p_").collect()} == {"und"}


def test_trigram_counts_equal_single_bundles():
    texts = ["abc de".encode(), b"", "Ünï cödé 12 x".encode(), b"q"]
    together = hyperlang.bundles(texts)
    assert all(np.allclose(together[i], hyperlang.bundles([t])[0]) for i, t in enumerate(texts))


# ---- memory of Python workers
def test_tokenizing_takes_one_worker(spark, odd_docs):
    """Encoding and the digests are one step, with the rows of the two chained."""
    path = queries.vocabulary_path()
    chained = bpe_automaton.digests(bpe_automaton.encode(odd_docs, path), path).drop("text")
    one = bpe_automaton.encode_and_digest(odd_docs, path, ids="ids")
    assert one.columns == chained.columns and sorted(map(repr, one.collect())) == sorted(map(repr, chained.collect()))
    plan = corpus_pipeline.bpe_stage(spark, odd_docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_tables_of_a_worker_go_with_its_task():
    built = []
    for _ in range(2):
        runtime.held("table", lambda: built.append(1))
    assert built == [1]
    runtime.release(False)
    runtime.held("table", lambda: built.append(1))
    runtime.release()
    runtime.held("table", lambda: built.append(1))
    assert built == [1, 1]


def test_fitting_holds_no_copies_of_all_terms():
    rng = np.random.default_rng(1)
    held = [np.unique(rng.integers(0, 1 << toxicity.BITS, 4000)).astype(np.uint32) for _ in range(3000)]
    y = np.array([i % 2 for i in range(3000)], np.float32)
    for i, h in enumerate(held):
        held[i] = np.union1d(h, np.array([7 + i % 2], np.uint32))
    tracemalloc.start()
    machine = toxicity.fit(held, y, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {7, 8} <= set(machine.chosen.tolist())
    assert peak < 3 * sum(h.nbytes for h in held)
