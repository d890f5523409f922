"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source has a target in words, so each of its documents is due the same fractional number of copies. Copies
become whole by dependent rounding that keeps the source's words:

* A large document (over 1/1024 of its source; fewer than 1024 a source) is paired with the bundle of all that are
  smaller: it is rounded at random, and the words gained or lost pass to the bundle's rate, largest first. Where
  the bundle could not make up for one of the two roundings (at the end of a small source), the other is taken.
* All others are paired with each other: words pass from one to the other, in the direction that chance picks, until
  one has a whole number of copies; the other goes on to the next. Buckets of about FAN documents are folded first;
  what is left of each bucket, one document at most, is folded again with its neighbours', level by level, up to one
  bucket a source. A hot source is as many buckets as it needs; no task holds more than a bucket.

So a source's words differ from its target by about one small document, expected copies are exact but for the end of
small sources, and chance is a hash of the documents: reruns agree.

Edge cases: a null text has size 0 and is never taken; documents without words are returned with 0 taken; a null
source is a source, the last; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.runtime import checkpoint, let, quoted

WORD = r"[^\x20\x09-\x0D]+"
FAN, LARGE, SALTS = 32, 1024, 32
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _chance(*parts: Column) -> Column:
    """In [0, 1), by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, target. Weights repeat over the sources in code point order, null last.

    Sources in order of size over weight are at their limit as long as the share left for the rest reaches it.
    """
    stats = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    stats = stats.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    limit = F.col("source_size") * most
    by = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(limit).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    stats = stats.withColumn("share", F.when(limit / F.col("weight") > share, share))
    share = F.max("share").over(Window.partitionBy())
    target = F.least(limit.cast("double"), F.coalesce(share * F.col("weight"), limit.cast("double")))
    return stats.select("source", "n", "source_size", target.alias("target"))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of their source; a hot source is spread over SALTS keys."""
    names = [c for c in table.columns if c != "source"]
    table = table.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod("h", F.lit(SALTS)).cast("int"))
    return salted.join(table, (F.col("_s") == F.col("_salt")) & F.col("source").eqNullSafe(F.col("_source"))).select(*rows.columns, *names)


def _doc(x: Column, copies: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h"), x["size"].alias("size"), copies.cast("long").alias("copies"))


def _large(rows: DataFrame, most: int) -> DataFrame:
    """For each source with large documents: these, rounded, and the rate that is left for the others."""
    first = F.struct((-F.col("size")).alias("o"), "h", "doc_id", "size")
    groups = rows.where(F.col("size") * LARGE > F.col("source_size")).groupBy("source", "source_size", "target").agg(F.sort_array(F.collect_list(first)).alias("all"))
    empty = F.expr("CAST(array() AS array<struct<doc_id:bigint,h:bigint,size:bigint,copies:bigint>>)")
    rate = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.when(s["mass"] > 0, s["goal"] / s["mass"]).otherwise(0.0)))

    def step(s: Column, x: Column) -> Column:
        def take(copies: Column) -> Column:
            return F.struct((s["goal"] - copies * x["size"]).alias("goal"), (s["mass"] - x["size"]).alias("mass"), F.concat(s["done"], F.array(_doc(x, copies))).alias("done"))

        def rounded(r: Column) -> Column:
            low = F.floor(r)
            # words that the rest could not give back, or take
            over, under = F.greatest(F.lit(0.0), (low + 1) * x["size"] - s["goal"]), F.greatest(F.lit(0.0), s["goal"] - low * x["size"] - most * (s["mass"] - x["size"]))
            up = F.when(over > under, 0).when(under > over, 1).when(_chance(x["h"], F.lit("large")) < r - low, 1).otherwise(0)
            return F.least(low + up, F.lit(most))

        return let(rate(s), lambda r: let(rounded(r), take))

    state = F.struct(F.col("target").alias("goal"), F.col("source_size").alias("mass"), empty.alias("done"))
    folded = groups.withColumn("s", F.aggregate("all", state, step))
    return folded.select("source", F.col("s.done").alias("done"), rate(F.col("s")).alias("rate"))


_DOC = "doc_id:bigint,h:bigint,size:bigint,copies:bigint"
_OPEN = "h:bigint,doc_id:bigint,size:bigint,base:bigint,p:double"


def _pair(level: int):
    """Fold step: the open document and the next; one gets whole, the other stays open."""

    def step(s: Column, b: Column) -> Column:
        a = s["open"]

        def result(open_: Column, *done: Column) -> Column:
            return F.struct(F.concat(s["done"], F.array(*done)).alias("done"), open_.alias("open"))

        def left(x: Column, p: Column) -> Column:
            return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p"))

        nothing = F.lit(None).cast(f"struct<{_OPEN}>")

        def move(m: Column) -> Column:
            # words that can go from b to a, from a to b; up: a gains
            def to(gain: Column, lose: Column, room: Column, has: Column) -> Column:
                words = F.least(room, has)
                return (
                    F.when(room == has, result(nothing, _doc(gain, gain["base"] + 1), _doc(lose, lose["base"])))
                    .when(room < has, result(left(lose, lose["p"] - words / lose["size"]), _doc(gain, gain["base"] + 1)))
                    .otherwise(result(left(gain, gain["p"] + words / gain["size"]), _doc(lose, lose["base"])))
                )

            up, down = F.least(m["room_a"], m["has_b"]), F.least(m["room_b"], m["has_a"])
            return F.when(_chance(a["h"], b["h"], F.lit(level)) * (up + down) < down, to(a, b, m["room_a"], m["has_b"])).otherwise(to(b, a, m["room_b"], m["has_a"]))

        amounts = F.struct(
            ((1 - a["p"]) * a["size"]).alias("room_a"), (a["p"] * a["size"]).alias("has_a"), ((1 - b["p"]) * b["size"]).alias("room_b"), (b["p"] * b["size"]).alias("has_b")
        )
        whole = F.when(b["p"] <= 1e-12, result(a, _doc(b, b["base"]))).when(b["p"] >= 1 - 1e-12, result(a, _doc(b, b["base"] + 1)))
        return whole.when(a.isNull(), F.struct(s["done"].alias("done"), left(b, b["p"]).alias("open"))).otherwise(let(amounts, move))

    return step


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """One row a bucket: done documents, and the open one or null."""
    groups = rows.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "base", "p"))).alias("all"))
    start = F.expr(f"named_struct('done', CAST(array() AS array<struct<{_DOC}>>), 'open', CAST(NULL AS struct<{_OPEN}>))")
    return groups.select("source", "bucket", F.aggregate("all", start, _pair(level)).alias("s")).select("source", "bucket", "s.done", "s.open")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, h, size, source, source_size, target, copies for every row of docs (doc_id, text, source).

    h is a hash of the row's id and text.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sized = checkpoint(sized)
    table = checkpoint(targets(sized, weights, most))
    dealt = _with(sized, table)
    large = _large(dealt, most)
    large = checkpoint(large)
    done = [large.select("source", F.explode("done").alias("d"))]
    plain = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = table.join(large.select(F.col("source").alias("_l"), "rate"), F.col("source").eqNullSafe(F.col("_l")), "left")
    rates = rates.select("source", "n", "source_size", F.coalesce("rate", plain).alias("rate"))
    small = _with(sized, rates).where(F.col("size") * LARGE <= F.col("source_size"))
    done.append(small.where("size = 0").select("source", _doc_of_row(F.lit(0))))
    base = F.floor("rate")
    buckets = F.ceil(F.col("n") / FAN)
    level_rows = small.where("size > 0").select("source", "h", "doc_id", "size", base.alias("base"), (F.col("rate") - base).alias("p"), F.pmod(F.xxhash64("h", F.lit("bucket")), buckets).alias("bucket"))
    most_n = table.agg(F.max("n")).first()[0] or 0
    width, level = max(1, -(-most_n // FAN)), 0
    while True:
        folded = checkpoint(_fold(level_rows, level))
        done.append(folded.select("source", F.explode("done").alias("d")))
        open_ = folded.where(F.col("open").isNotNull()).select("source", "bucket", "open.*")
        if width <= 1:
            break
        width, level = -(-width // FAN), level + 1
        level_rows = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    rounded = F.col("base") + F.when(_chance(F.col("h"), F.lit("last")) < F.col("p"), 1).otherwise(0)
    done.append(open_.select("source", _doc_of_row(rounded)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.select("source", "d.*")
    return _with(out, table.drop("n")).select("doc_id", "h", "size", "source", "source_size", "target", "copies")


def _doc_of_row(copies: Column) -> Column:
    return F.struct("doc_id", "h", "size", copies.cast("long").alias("copies")).alias("d")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs' rows, each as often as the mix takes it; rows that it doesn't take are gone. Columns of any names stay as they are."""
    copies = mix(docs, weights, most).select("doc_id", "h", "copies")
    copies = copies.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("copies"))).where("copies > 0")
    # docs' columns travel in a struct of their own, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash")))
    both = rows.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h")) & (F.col("nth") == F.col("k")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
