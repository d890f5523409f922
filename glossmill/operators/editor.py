"""The rules of an editor as relations: glossary rows, alternatives, paragraphs side by side, target languages, pinned answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.functions.languages import CODES

PARAGRAPHS = r"\n[ \t]*\n"
# Alternatives that are shown, rows of a page, characters of a dictionary context, remembered answers, terms for an image.
ALTERNATIVES, PAGE_ROWS, CONTEXT_CHARS, REMEMBERED, IMAGE_TERMS = 5, 100, 2000, 30, 40


# ---- glossary rows
def filtered_rows(entries: DataFrame, query: Column | str) -> DataFrame:
    """Entries whose source, target or note holds the query, whatever its case; all for a blank one."""
    asked = F.lower(X.strip(F.lit(query) if isinstance(query, str) else query))
    return entries.where((asked == "") | F.contains(F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")), F.coalesce("note", F.lit("")))), asked))


def rows_page(entries: DataFrame, order: str, page: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page of rows in order; pages count from 0. The cap is the feature."""
    return entries.orderBy(order).offset(page * size).limit(size)


def draft_entries(texts: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos of enabled entries that may occur in each text: white space squashed, case aside. A superset of what matches."""
    from glossmill.operators import glossary

    fold = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    own = entries.where("enabled").select("pos", fold(F.col("source")).alias("needle")).where("needle <> ''").withColumn("anchors", F.array(F.left("needle", F.lit(2))))
    rows = texts.where(F.col(text).isNotNull()).select(key, fold(F.col(text)).alias("_t"))
    pairs = F.array_distinct(F.concat(F.regexp_extract_all("_t", F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all("_t", F.lit("(?s)."), F.lit(0))))
    return glossary.candidates(rows, own, key, pairs, own.count()).where(F.contains("_t", F.col("needle"))).select(key, "pos")


def half_filled(entries: DataFrame) -> DataFrame:
    """Rows with a source and no target, or the other way round: they can't be saved."""
    blank = lambda c: X.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return entries.where(blank("source") != blank("target"))


def with_entry(entries: DataFrame, entry: DataFrame) -> DataFrame:
    """entries (pos, …) and one more at the end."""
    last = entries.agg(F.coalesce(F.max("pos") + 1, F.lit(0).cast("long")).alias("pos"))
    return entries.unionByName(entry.drop("pos").join(F.broadcast(last)).select(*entries.columns))


def saved(documents: DataFrame, document: DataFrame) -> DataFrame:
    """documents (id, …) with one created, or in the place of that with its id."""
    return documents.join(F.broadcast(document.select("id")), "id", "left_anti").unionByName(document.select(*documents.columns))


def deleted(documents: DataFrame, id_: str, default_name: str = "default") -> DataFrame:
    """documents (id, name, entries) without one; the last one's place is taken by an empty default."""
    rest = documents.where(F.col("id") != id_)
    number = rest.agg(F.count("*").alias("_n"))
    empty = number.where("_n = 0").select(F.lit("default").alias("id"), F.lit(default_name).alias("name"), F.lit(None).cast(documents.schema["entries"].dataType).alias("entries"))
    empty = empty.withColumn("entries", F.coalesce("entries", F.array().cast(documents.schema["entries"].dataType)))
    return rest.select("id", "name", "entries").unionByName(empty)


def entry_counts(documents: DataFrame) -> DataFrame:
    """id, name, entry_count of glossaries, default first."""
    return documents.select("id", "name", F.size("entries").alias("entry_count")).orderBy(F.col("id") != "default", F.lower("name"), "id")


def image_terms(entries: DataFrame, target: str) -> DataFrame:
    """The first terms of a target, which a picture's prompt has room for."""
    return entries.where(F.col("enabled") & (F.col("target_lang") == target)).orderBy("pos").limit(IMAGE_TERMS)


# ---- alternatives
def alternatives(answers: DataFrame, req: str, pos: str, span: str, value: str) -> DataFrame:
    """req, n, value: distinct answers, case aside, other than the span itself; the first of each request."""
    rows = answers.select(req, pos, X.strip(F.col(value)).alias("value"), X.strip(F.col(span)).alias("_s")).where((F.col("value") != "") & (F.col("_s") != "") & (F.lower("value") != F.lower("_s")))
    first = rows.groupBy(req, F.lower("value").alias("_k")).agg(F.min(F.struct(pos, "value")).alias("v"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(req).orderBy(f"v.{pos}")))
    return ranked.where(F.col("n") <= ALTERNATIVES).select(req, "n", F.col("v.value").alias("value"))


def with_alternative(text: Column, start: Column, end: Column, span: Column, replacement: Column) -> Column:
    """text with the span replaced: at its offsets if it is still there, else where it first occurs, else not at all."""
    there = F.substr(text, start + 1, end - start) == span
    at = F.when(there, start).otherwise(F.position(span, text) - 1)
    return F.when(at < 0, text).otherwise(F.concat(F.left(text, at), replacement, F.substr(text, at + F.length(span) + 1)))


def remembered(uses: DataFrame, key: str, ts: str, keep: int = REMEMBERED) -> DataFrame:
    """The keys that a cache of so many still has: those used last."""
    last = uses.groupBy(key).agg(F.max(ts).alias(ts))
    return last.orderBy(F.desc(ts), key).limit(keep)


def cached_units(uses: DataFrame, key: str, ts: str, keep: int = 4096, shards: int = 64) -> DataFrame:
    """shard, key, ts: as remembered, for a cache that is kept in shards by a hash; each holds its share."""
    last = uses.groupBy(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), key).agg(F.max(ts).alias(ts))
    return last.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(ts), key))).where(F.col("_n") <= keep // shards).drop("_n")


# ---- texts side by side
def split_pairs(source: Column, target: Column) -> Column:
    """Array of (source, target): paragraph by paragraph if both have as many, else the whole texts."""
    cut = lambda c: F.transform(F.split(c, PARAGRAPHS), X.strip)
    pair = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    sources, targets = cut(source), cut(target)
    side = F.zip_with(sources, targets, pair)
    return F.when((F.size(sources) > 1) & (F.size(sources) == F.size(targets)), side).otherwise(F.array(pair(X.strip(source), X.strip(target))))


def swapped(requests: DataFrame) -> DataFrame:
    """requests (source, target, source_lang, target_lang) with sides changed, and pinned: each new source's answer is its old source."""
    pairs = split_pairs(F.col("source"), F.col("target"))
    text = lambda side: F.array_join(F.transform("_p", lambda p: p[side]), "\n\n")
    rows = requests.withColumn("_p", pairs)
    pinned = F.transform("_p", lambda p: F.struct(X.strip(p["target"]).alias("source"), p["source"].alias("target")))
    other = [c for c in requests.columns if c not in ("source", "target", "source_lang", "target_lang")]
    return rows.select(*other, text("target").alias("source"), text("source").alias("target"), F.col("target_lang").alias("source_lang"), F.col("source_lang").alias("target_lang"), pinned.alias("pinned"))


def pinned_answers(texts: DataFrame, pinned: DataFrame, key: str, text: str) -> DataFrame:
    """key, answer of texts that are pinned as a whole, or all of whose paragraphs are; pinned: source, target."""
    parts = texts.select(key, X.strip(F.col(text)).alias("_t")).withColumn("_p", F.transform(F.split("_t", PARAGRAPHS), X.strip))
    whole = parts.join(pinned.select(F.col("source").alias("_t"), F.col("target").alias("_w")), "_t", "left").select(key, "_p", "_w")
    each = whole.select(key, "_w", F.size("_p").alias("_n"), F.posexplode("_p").alias("pos", "_s"))
    each = each.join(pinned.select(F.col("source").alias("_s"), F.col("target").alias("_a")), "_s", "left")
    got = each.groupBy(key).agg(F.first("_w").alias("_w"), F.max("_n").alias("_n"), F.count("_a").alias("_k"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "_a"))), lambda x: x["_a"]).alias("_l"))
    answer = F.coalesce("_w", F.when((F.col("_n") > 1) & (F.col("_n") == F.col("_k")), F.array_join("_l", "\n\n")))
    return got.select(key, answer.alias("answer")).where("answer IS NOT NULL")


def automatic_target(chosen_source: Column, target: Column, mode: Column, primary: Column, remembered_source: Column) -> Column:
    """The target to go on with: another one where the text is found to be in the target already: the source language that was found last, if it is another, else Korean or English."""
    known = lambda c: c.isin(*CODES)
    same = (chosen_source == "auto") & (mode == "single") & known(primary) & (primary == target)
    other = F.when(known(remembered_source) & (remembered_source != primary), remembered_source).when(primary == "ko", "en").otherwise("ko")
    return F.when(F.coalesce(same, F.lit(False)), other).otherwise(target)


def context_around(text: Column, start: Column, end: Column, most: int = CONTEXT_CHARS) -> Column:
    """The paragraph around a span, so many characters of it at most."""
    before = F.left(text, start + 2)
    gap = F.length(before) - F.instr(F.reverse(before), "\n\n") + 1
    first = F.when(F.instr(F.reverse(before), "\n\n") > 0, gap).otherwise(0)
    after = F.instr(F.substr(text, end + 1), "\n\n")
    last = F.when(after > 0, end + after - 1).otherwise(F.length(text))
    low = F.when(last - first > most, F.greatest(first, start - most // 2)).otherwise(first)
    high = F.when(last - first > most, F.least(last, low + most)).otherwise(last)
    return X.strip(F.substr(text, low + 1, high - low))


# ---- gate
def allowed(visits: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """visits with allowed: whether the IPv4 address lies in a range (cidr) of the list; an empty list allows all."""
    number = lambda c: F.aggregate(F.transform(F.split(c, r"\."), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    valid = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$"
    bits = F.coalesce(F.nullif(F.split_part("cidr", F.lit("/"), F.lit(2)), F.lit("")), F.lit("32")).cast("int")
    low = number(F.split_part("cidr", F.lit("/"), F.lit(1)))
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    # a list has a few ranges: as one array, sorted, that travels with the plan
    nets = ranges.select(F.struct((low - low % size).alias("low"), (low - low % size + size - 1).alias("high")).alias("n")).agg(F.collect_set("n").alias("_nets"))
    address = F.when(F.col(ip).rlike(valid), number(F.col(ip)))
    inside = F.exists("_nets", lambda n: (address >= n["low"]) & (address <= n["high"]))
    return visits.join(F.broadcast(nets)).withColumn("allowed", (F.size("_nets") == 0) | F.coalesce(inside, F.lit(False))).drop("_nets")
