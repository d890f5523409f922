"""The registered queries of the text engine, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import languages, numbers, scripts, tags
from glossmill.functions import text as X
from glossmill.functions.chunks import join_units, split_units
from glossmill.operators import glossary, jobs, layout, model, packing, report
from glossmill.plans import fixtures as R
from glossmill.plans.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line"""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


# ---- pieces of SQL
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_squash(x: str) -> str:
    return rf"regexp_replace({sql_strip(x)}, '\s+', ' ', 'g')"


def sql_tokens(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^{X.CJK[1:-1]}]', '', 'g'))"
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE greatest(1, ({cjk} + 1) // 2 + (length({x}) - {cjk} + 3) // 4) END AS BIGINT)"


def sql_count(x: str, pattern: str) -> str:
    return f"CAST(length(regexp_replace({x}, '[^{pattern[1:-1]}]', '', 'g')) AS BIGINT)"


def sql_needs_document(x: str) -> str:
    p = sql_strip(x)
    return rf"({p} <> '' AND regexp_matches({p}, '{X.LETTER}') AND NOT regexp_matches({p}, '(?i)^(?:[a-z][a-z0-9+.-]*://\S+|www\.\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)$'))"


def sql_mock(x: str, lang: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '(\n[ \t]*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    return rf"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 OR regexp_matches(p, '^\s*$') THEN p ELSE '[{lang}] ' || p END), '')"


SENTENCES = r"""
s AS (SELECT doc_id, lang, regexp_replace(unnest(string_split(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'),
    '([.!?。！？])\s+|\n+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS u FROM documents),
u AS (SELECT * FROM s WHERE u <> '')"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(X.split_sentences(F.col("text"))).alias("u"))


@query(f"WITH {SENTENCES} SELECT lang, count(*) AS n_units, CAST(sum(length(u)) AS BIGINT) AS n_chars, CAST(sum({sql_tokens('u')}) AS BIGINT) AS n_tokens FROM u WHERE {sql_needs_document('u')} GROUP BY lang")
def units_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir).where(X.needs_translation_document(F.col("u")))
    return units.groupBy("lang").agg(F.count("*").alias("n_units"), F.sum(F.length("u")).cast("long").alias("n_chars"), F.sum(X.estimate_tokens(F.col("u"))).alias("n_tokens"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, max(length(u)) AS longest, CAST(sum(length(u)) AS BIGINT) AS total FROM u GROUP BY doc_id")
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("u")).cast("long").alias("longest"), F.sum(F.length("u")).cast("long").alias("total"))


@query()
def long_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of at most 400 characters; all of a document's text is in them."""
    units = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_units(F.col("text"), 400)).alias("pos", "u"))
    return units.select("doc_id", "pos", "u.*")


@query()
def units_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts from their units, white space squashed; same tells whether nothing was lost."""
    docs = read(spark, sf_dir, "documents").withColumn("units", split_units(F.col("text"), 400))
    return docs.select("doc_id", F.size("units").alias("n_units"), (X.squash(join_units(F.col("units"), F.lit(" "))) == X.squash(F.col("text"))).alias("same"))


@query(f"SELECT doc_id, {', '.join(f'{sql_count("text", p)} AS {n}' for n, p in (('ko', scripts.HANGUL), ('ja', scripts.KANA), ('han', scripts.HAN), ('latin', scripts.LATIN), ('cyrillic', scripts.CYRILLIC)))} FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {R.SCRIPT_TEXTS.sql()})")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(R.SCRIPT_TEXTS.frame(spark))
    each = {"ko": scripts.HANGUL, "ja": scripts.KANA, "han": scripts.HAN, "latin": scripts.LATIN, "cyrillic": scripts.CYRILLIC}
    return rows.select("doc_id", *(scripts.count(F.col("text"), p).alias(n) for n, p in each.items()))


DETECT_SQL = f"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {R.SCRIPT_TEXTS.sql()}),
c AS (SELECT doc_id, {sql_count('text', scripts.HANGUL)} AS ko, {sql_count('text', scripts.KANA)} AS ja, {sql_count('text', scripts.HAN)} AS han, {sql_count('text', scripts.LATIN)} AS en,
  {sql_count('text', scripts.chinese_classes()[0])} AS tr, {sql_count('text', scripts.chinese_classes()[1])} AS si FROM t),
a AS (SELECT *, CASE WHEN ja >= greatest(2, han / 8.0) THEN 'ja' WHEN ko > 0 AND han <= greatest(2, ko / 8.0) THEN 'ko' WHEN tr > si THEN 'zh-Hant' ELSE 'zh-Hans' END AS ah FROM c),
l AS (SELECT doc_id, 'en' AS code, en AS n FROM a UNION ALL SELECT doc_id, 'ko', ko + CASE WHEN ah = 'ko' THEN han ELSE 0 END FROM a
  UNION ALL SELECT doc_id, 'ja', ja + CASE WHEN ah = 'ja' THEN han ELSE 0 END FROM a UNION ALL SELECT doc_id, ah, han FROM a WHERE ah LIKE 'zh%'),
r AS (SELECT *, round_even(n / sum(n) OVER (PARTITION BY doc_id), 4) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS rk FROM l WHERE n > 0),
m AS (SELECT doc_id, count(*) AS n_languages, count(*) FILTER (WHERE n >= 4 AND share >= 0.18) AS sig, count(*) FILTER (WHERE rk > 1 AND n >= 2) AS tra, max(share) AS top, min(code) FILTER (WHERE rk = 1) AS first FROM r GROUP BY doc_id),
d AS (SELECT t.doc_id, coalesce(n_languages, 0) AS n_languages, CASE WHEN m.doc_id IS NULL THEN 'unknown' WHEN sig >= 2 OR tra > 0 THEN 'mixed' WHEN top >= 0.55 OR n_languages = 1 THEN 'single' ELSE 'unknown' END AS mode, first FROM t LEFT JOIN m USING (doc_id))
SELECT doc_id, mode, CASE WHEN mode = 'single' THEN first END AS primary_language, CAST(n_languages AS BIGINT) AS n_languages FROM d
"""


@query(DETECT_SQL)
def detect_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(R.SCRIPT_TEXTS.frame(spark))
    rows = rows.select("doc_id", scripts.detect(F.col("text")).alias("d"))
    return rows.select("doc_id", "d.mode", "d.primary_language", F.size("d.languages").cast("long").alias("n_languages"))


@query(f"SELECT id, service, document FROM {R.NEEDS.sql()}")
def needs_translation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.NEEDS.frame(spark).select("id", X.needs_translation_service(F.col("text")).alias("service"), X.needs_translation_document(F.col("text")).alias("document"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {sql_needs_document('line')}) AS n_needed FROM l GROUP BY doc_id")
def needs_translation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(read(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.needs_translation_document(F.col("line"))).alias("n_needed"))


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens, CAST(least(8192, greatest(256, 3 * {sql_tokens('text')} + 256)) AS BIGINT) AS budget FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.estimate_tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), X.completion_budget(tokens).alias("budget"))


# ---- terminology
BORDER = r"[^\p{Latin}\p{Nd}_]"
HITS = f"""
terms AS (SELECT *, CASE WHEN mode = 'acronym' THEN '' ELSE '(?i)' END || '(^|{BORDER})' || source || CASE WHEN mode = 'acronym' THEN 's?' ELSE '(s|es|''s|’s)?' END || '($|{BORDER})' AS rx
  FROM {R.TERMS.sql()} WHERE enabled AND target_lang = 'de')"""


@query(f"WITH {HITS}, t AS (SELECT lang, {sql_squash('text')} AS x FROM documents) SELECT lang, source, target, count(*) AS n FROM t JOIN terms ON regexp_matches(x, rx) GROUP BY ALL")
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = glossary.match_terms(docs, glossary.directed(R.TERMS.frame(spark), "de"), "doc_id", "text", carry=["lang"])
    return found.groupBy("lang", "source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {HITS}, t AS (SELECT conv_id * 1000 + turn AS k, {sql_squash('text')} AS x FROM conversations), h AS (SELECT k, source, row_number() OVER (PARTITION BY k ORDER BY length(source) DESC, pos) AS rank FROM t JOIN terms ON regexp_matches(x, rx)) SELECT k, source, rank FROM h")
def glossary_hits_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    found = glossary.match_terms(turns, glossary.directed(R.TERMS.frame(spark), "de"), "k", "text")
    return found.select("k", "source", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HITS}, t AS (SELECT conv_id * 1000 + turn AS k, {sql_squash('text')} AS x FROM conversations) SELECT source, count(*) AS n FROM t JOIN terms ON regexp_matches(x, rx) GROUP BY source")
def glossary_hits_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for a glossary too large to broadcast: joined by salted anchors."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    found = glossary.match_terms(turns, glossary.directed(R.TERMS.frame(spark), "de"), "k", "text", number=glossary.BROADCAST_TERMS + 1)
    return found.groupBy("source").agg(F.count("*").alias("n"))


EXACT = R.Relation("pos long, source string, target string", [(0, "All rights reserved.", "Alle Rechte vorbehalten."), (1, "licensed under cc by-nc 4.0.", "Lizenziert unter CC BY-NC 4.0."), (2, "of.", "von.")])


@query(f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT target AS exact, count(*) AS n FROM l JOIN {EXACT.sql()} ON lower({sql_strip('line')}) = lower(source) GROUP BY target")
def exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = glossary.exact_terms(lines_of(read(spark, sf_dir, "documents")), EXACT.frame(spark), "line")
    return done.where("exact IS NOT NULL").groupBy(X.strip(F.col("exact")).alias("exact")).agg(F.count("*").alias("n"))


def sql_key(prefix: str = "") -> str:
    return f"CASE WHEN lower({prefix}source_lang) LIKE 'en%' THEN 'en' ELSE {prefix}source_lang END AS s, {prefix}target_lang AS t, lower(trim({prefix}source)) AS x"


@query(f"""
WITH o AS (SELECT *, {sql_key()}, row_number() OVER (PARTITION BY CASE WHEN lower(source_lang) LIKE 'en%' THEN 'en' ELSE source_lang END, target_lang, lower(trim(source)) ORDER BY pos) AS k FROM {R.OLD_TERMS.sql()}),
n0 AS (SELECT *, {sql_key()} FROM {R.NEW_TERMS.sql()}),
n AS (SELECT s, t, x, max_by(source, pos) AS source, max_by(target, pos) AS target, max_by(source_lang, pos) AS source_lang, min(pos) AS first FROM n0 GROUP BY s, t, x)
SELECT CASE WHEN o.pos IS NULL THEN 1 ELSE 0 END AS part, coalesce(o.pos, n.first) AS at, coalesce(n.source_lang, o.source_lang) AS source_lang, coalesce(n.t, o.target_lang) AS target_lang, coalesce(n.source, o.source) AS source, coalesce(n.target, o.target) AS target
FROM o FULL OUTER JOIN n ON o.s = n.s AND o.t = n.t AND o.x = n.x WHERE n.x IS NULL OR o.k IS NULL OR o.k = 1
""")
def merge_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.merge(R.OLD_TERMS.frame(spark), R.NEW_TERMS.frame(spark))


# ---- model stage
@query(f"SELECT conv_id, turn, CASE WHEN {sql_needs_document('text')} THEN {sql_mock('text', 'de')} ELSE text END AS output FROM conversations")
def lookup_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return model.apply_model(turns, "text", model.mock_engine, "de").select("conv_id", "turn", "output")


@query(f"SELECT doc_id, md5({sql_mock('text', 'ko')}) AS digest FROM documents")
def mock_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.mock_translate(F.col("text"), "ko")).alias("digest"))


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS uses FROM l GROUP BY line HAVING count(*) > 1")
def distinct_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(read(spark, sf_dir, "documents")).withColumn("at", F.struct("doc_id", "pos"))
    return model.distinct_units(lines, "line", "at").where("uses > 1").select("line", "uses")


@query(f"SELECT conv_id, turn, 0 AS side, text FROM conversations UNION ALL SELECT conv_id, turn, 1, {sql_mock('text', 'fr')} FROM conversations")
def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("out", X.mock_translate(F.col("text"), "fr"))
    return model.bilingual(turns, ["conv_id", "turn"], "text", "out")


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) % 7 = 0 THEN text ELSE '[it] ' || text END AS output FROM conversations")
def retry_in_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch answers only if none of its items is bad; bad items end alone and keep their text."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") + 1).alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")

    def run(items: DataFrame) -> DataFrame:
        bad = items.groupBy("batch").agg(F.max(F.length("text") % 7 == 0).alias("bad"))
        return items.join(bad, "batch").where("NOT bad").select("batch", "id", F.concat(F.lit("[it] "), "text").alias("output"))

    return model.retry_in_halves(turns, run)


# ---- packing and context
@query("""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
p AS (SELECT doc_id, i, length(line) AS size, length(line) AS n, 1 AS k, 0 AS batch FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, length(l.line), CASE WHEN p.n + length(l.line) > 2000 OR p.k >= 30 THEN length(l.line) ELSE p.n + length(l.line) END,
    CASE WHEN p.n + length(l.line) > 2000 OR p.k >= 30 THEN 1 ELSE p.k + 1 END, p.batch + CASE WHEN p.n + length(l.line) > 2000 OR p.k >= 30 THEN 1 ELSE 0 END
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1)
SELECT doc_id, batch, count(*) AS items, CAST(sum(size) AS BIGINT) AS chars FROM p GROUP BY doc_id, batch
""")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_batches(lines_of(read(spark, sf_dir, "documents")), "doc_id", "pos", F.length("line"), 2000)
    return packed.groupBy("doc_id", "batch").agg(F.count("*").alias("items"), F.sum("size").alias("chars"))


@query("""
WITH w AS (SELECT conv_id, turn, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS before, sum(length(text)) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
SELECT conv_id, turn, CAST(least(least(3, c) - 1, before * least(3, c) // greatest(total, 1)) AS INTEGER) AS lane FROM w
""")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    return packing.lanes(turns, "conv_id", "turn", "size", 3).select("conv_id", "turn", "lane")


@query(f"""
WITH r AS (SELECT conv_id, turn // 4 AS chunk, turn, '- ' || left({sql_squash('text')}, 400) AS line, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, chunk + 1 AS chunk, string_agg(line, chr(10) ORDER BY turn) AS context FROM r WHERE k <= 3 GROUP BY conv_id, chunk
""")
def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("chunk", F.floor(F.col("turn") / 4))
    return packing.preceding_context(turns, "conv_id", "chunk", "turn", "text")


@query(f"""
WITH u AS (SELECT conv_id, turn, {sql_strip('text')} AS t, turn // 2 AS p, turn % 3 = 0 AS nl, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS pp FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN pp IS NULL THEN '' WHEN pp <> p THEN chr(10) || chr(10) WHEN nl THEN chr(10) ELSE ' ' END || t, '' ORDER BY turn)) AS digest FROM u GROUP BY conv_id
""")
def join_units_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.struct("turn", "text", F.floor(F.col("turn") / 2).cast("int").alias("paragraph"), (F.col("turn") % 3 == 0).alias("newline_before"))
    listed = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    return listed.select("conv_id", F.md5(join_units(F.col("units"), F.lit(" "))).alias("digest"))


# ---- quality report
@query(f"SELECT id, missing FROM {R.NUMBER_PAIRS.sql()}")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.NUMBER_PAIRS.frame(spark).select("id", F.array_join(numbers.missing_numbers(F.col("source"), F.col("target")), ",").alias("missing"))


@query(f"SELECT id, ok, distance FROM {R.TAGGED.sql()}")
def tag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.TAGGED.frame(spark).select("id", tags.tags_ok(F.col("source"), F.col("output")).alias("ok"), tags.distance(F.col("source"), F.col("output")).alias("distance"))


@query(r"""
WITH p AS (SELECT item_id AS pos, text AS s, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN '[de] ' || text ELSE regexp_replace(text, '[0-9]', '', 'g') END AS t FROM benchmark),
d AS (SELECT s, t, min(pos) AS pos FROM p GROUP BY s, t),
i AS (
  SELECT pos, 0 AS o, 'untranslated' AS issue FROM d WHERE s = t AND len(regexp_extract_all(s, '[A-Za-zÀ-ɏ]{2,}')) >= 2 AND len(list_filter(regexp_extract_all(s, '[A-Za-zÀ-ɏ]{2,}'), lambda w: w = lower(w))) > 0
  UNION ALL SELECT pos, 1, 'term not applied: the → die' FROM d WHERE regexp_matches(s, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])') AND NOT regexp_matches(t, '(?i)(^|[^A-Za-z0-9])die($|[^A-Za-z0-9])'))
SELECT pos, issue FROM i
""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read(spark, sf_dir, "benchmark")
    target = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("[de] "), "text")).otherwise(F.regexp_replace("text", "[0-9]", ""))
    pairs = bench.select(F.col("item_id").alias("pos"), F.col("text").alias("source"), target.alias("target"))
    entries = R.TERMS.frame(spark).where("pos = 0").select("pos", "source", "target")
    return report.report_items(pairs, entries, "en", "de", None).select("pos", "issue")


@query(f"SELECT id, value, CASE WHEN regexp_matches(value, '^''*[=+\\-@\\t\\r]') THEN '''' || value ELSE value END AS escaped, value AS back FROM {R.CELLS.sql()}")
def formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.CELLS.frame(spark).withColumn("escaped", X.escape_cell(F.col("value")))
    return cells.withColumn("back", X.unescape_cell(F.col("escaped")))


@query(f"SELECT id, safe FROM {R.FILES.sql()}")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.FILES.frame(spark).select("id", X.safe_filename(F.col("name")).alias("safe"))


@query(f"SELECT id, normal FROM {R.CODES.sql()}")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.CODES.frame(spark).select("id", languages.normalize_code(F.col("code")).alias("normal"))


# ---- jobs, load and history
@query("""
WITH e AS (SELECT user_id, event_id, ts, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN done = total THEN 100.0 WHEN done = 1 THEN 0.0 ELSE max(CASE WHEN done > 1 THEN round(least(100.0 * done / total, 99.0), 1) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS percent FROM e
""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    rows = rows.withColumn("done", F.row_number().over(w.orderBy("at"))).withColumn("total", F.count("*").over(w))
    rows = rows.withColumn("status", F.when(F.col("done") == F.col("total"), "done").when(F.col("done") == 1, "queued").otherwise("translating"))
    return jobs.percent(rows, "user_id", "at", "done", "total", "status").select("event_id", "percent")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.unix_timestamp("ts").alias("s")).agg(F.count("*").alias("c"))
    return rows.withColumn("done", F.sum("c").over(w.orderBy("s"))).withColumn("total", F.sum("c").over(w))


@query("""
WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS c FROM events GROUP BY ALL),
t AS (SELECT user_id, s, sum(c) OVER (PARTITION BY user_id ORDER BY s) AS done, sum(c) OVER (PARTITION BY user_id) AS total FROM g),
f0 AS (SELECT *, first_value(s) OVER w AS r0, first_value(done) OVER w AS q0, first_value(s) OVER a AS a0, first_value(done) OVER a AS b0 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN r0 = s THEN a0 ELSE r0 END AS s0, CASE WHEN r0 = s THEN b0 ELSE q0 END AS d0 FROM f0)
SELECT user_id, s, CASE WHEN s - s0 >= 1 AND done > d0 THEN CAST(floor((total - done) * (s - s0) / (done - d0) + 0.5) AS BIGINT) END AS eta_seconds FROM f WHERE s - s0 >= 1 AND done > d0
""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.eta(_samples(spark, sf_dir), "user_id", "s", "done", "total", window_s=86400).where("eta_seconds IS NOT NULL").select("user_id", "s", "eta_seconds")


@query(rf"""
WITH m AS (SELECT regexp_extract(line, '^([^{{\s]+)', 1) AS name, try_cast(regexp_extract(line, '\s(\S+)$', 1) AS DOUBLE) AS v FROM {R.METRICS.sql()})
SELECT CASE name WHEN 'vllm:num_requests_running' THEN 'running' WHEN 'vllm:num_requests_waiting' THEN 'waiting' ELSE 'kv_cache' END AS metric, CASE WHEN name LIKE '%kv_cache%' THEN max(v) ELSE sum(v) END AS value
FROM m WHERE v IS NOT NULL AND name IN ('vllm:num_requests_running', 'vllm:num_requests_waiting', 'vllm:kv_cache_usage_perc') GROUP BY name
""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossmill.sources.metrics import rollup

    return rollup(R.METRICS.frame(spark), "line")


@query("""
WITH e AS (SELECT user_id, event_type AS text, CASE WHEN value > 50 THEN 'de' ELSE 'fr' END AS target, min(CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events GROUP BY user_id, ts, event_type, CASE WHEN value > 50 THEN 'de' ELSE 'fr' END),
u AS (SELECT user_id, s, min(text) AS text, min(target) AS target FROM e GROUP BY user_id, s),
b AS (SELECT *, lag(text) OVER w AS pt, lag(target) OVER w AS pl, lag(s) OVER w AS ps, lead(s) OVER (PARTITION BY user_id, text, target ORDER BY s) IS NOT NULL AS again FROM u WINDOW w AS (PARTITION BY user_id ORDER BY s)),
p AS (SELECT *, least(length(text), length(pt)) AS lim, len(list_filter(range(1, least(length(text), length(pt)) + 1), lambda i: left(text, i) = left(pt, i))) AS pre,
  len(list_filter(range(1, least(length(text), length(pt)) + 1), lambda i: right(text, i) = right(pt, i))) AS suf FROM b),
m AS (SELECT *, CASE WHEN pl = target AND s - ps <= 36000 AND pre + least(suf, lim - pre) >= 0.8 * lim THEN 0 ELSE 1 END AS new FROM p),
d AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS draft FROM m),
g AS (SELECT user_id, draft, max(s) AS s, max_by(text, s) AS text, max_by(target, s) AS target, max_by(again, s) AS again, count(*) AS edits FROM d GROUP BY user_id, draft HAVING NOT max_by(again, s)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS rank FROM g)
SELECT user_id, s, text, target, edits FROM r WHERE rank <= 50
""")
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("value") > 50, "de").otherwise("fr")
    edits = read(spark, sf_dir, "events").groupBy("user_id", F.unix_timestamp("ts").alias("s")).agg(F.min("event_type").alias("text"), F.min(target).alias("target"))
    return jobs.history(edits, "user_id", "s", "text", "target", gap_s=36000).select("user_id", "s", "text", "target", "edits")


@query("WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS finished_at FROM events GROUP BY user_id) SELECT user_id FROM l, n WHERE finished_at + INTERVAL 24 HOUR <= now")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("finished_at"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    return jobs.expired(last.join(F.broadcast(now)), F.col("now")).select("user_id")


@query("""
WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), d AS (SELECT DISTINCT user_id, s FROM s)
SELECT user_id, s FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM d) WHERE nxt IS NULL OR nxt - s >= 600
""")
def debounced_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("s")).distinct()
    return jobs.debounced(rows, "user_id", "s", 600)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
w AS (SELECT user_id, min(s) AS s FROM e GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.s + 7200) FROM w WHERE w.s IS NOT NULL)
SELECT user_id, s FROM w WHERE s IS NOT NULL
""")
def throttled_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("s"))
    return jobs.throttled(rows, "user_id", "s", 7200)


STATUS_SQL = """CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'extracting' WHEN 'purchase' THEN 'done' ELSE 'translating' END"""


@query(f"SELECT user_id AS job, max_by({STATUS_SQL}, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(STATUS_SQL).alias("status"))
    return jobs.current_status(events)


@query(f"""
WITH e AS (SELECT user_id AS job, event_id AS seq, {STATUS_SQL} AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY seq) AS b FROM e)
SELECT seq, CASE WHEN b IS NULL THEN status = 'queued' ELSE (b, status) IN (('queued', 'extracting'), ('extracting', 'translating'), ('translating', 'writing'), ('writing', 'done')) END AS ok FROM l
""")
def job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(STATUS_SQL).alias("status"))
    return jobs.valid_moves(events).select("seq", "ok")


@query("WITH a AS (SELECT min(event_id) AS m FROM events GROUP BY user_id), i AS (SELECT user_id AS job, event_id - (SELECT min(event_id) FROM events) AS pos FROM events), f AS (SELECT job, min(pos) AS pos FROM i WHERE pos < 100 GROUP BY job) SELECT f.job, f.pos, c_name AS name FROM f JOIN customer ON c_custkey = f.job")
def listed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred ids asked for, each once, in the order asked; the cap is the feature."""
    events = read(spark, sf_dir, "events")
    least = events.agg(F.min("event_id").alias("least"))  # one row
    ids = events.join(F.broadcast(least)).select(F.col("user_id").alias("job"), (F.col("event_id") - F.col("least")).alias("pos"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.col("c_name").alias("name"))
    return jobs.listed(names, ids).select("job", "pos", "name")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 415 WHEN value < 1 THEN 400 WHEN value > 90 THEN 413 WHEN event_id % 5 = 0 THEN 429 WHEN value + event_id % 100 > 150 THEN 507 ELSE 202 END AS status FROM events")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("value") < 1, 0.0).otherwise(F.col("value"))
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("known_type"), size.alias("size"), F.when(F.col("event_id") % 5 == 0, 2).otherwise(0).alias("active"), (F.col("event_id") % 100).alias("used"))
    return jobs.admission(rows, 90, 2, 150).select("id", "status")


@query("SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of events with gaps under thirty minutes."""
    grouped = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes"))
    return grouped.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


# ---- layout
@query("WITH v AS (SELECT 1 AS page, 1 AS paragraph, 'Title' AS text UNION ALL SELECT 1, 2, 'First line of a paragraph.' UNION ALL SELECT 1, 3, 'Next one' UNION ALL SELECT 1, 4, 'aside' UNION ALL SELECT 2, 1, 'Small print') SELECT CAST(page AS BIGINT) AS page, CAST(paragraph AS BIGINT) AS paragraph, text FROM v")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(R.LINES.frame(spark)).select("page", "paragraph", "text")


# a document is a page, its lines are spans: some hidden, some of one letter, some garbage, beside images of several sizes
LINE_SPANS = """SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN left(line, 3) WHEN doc_id % 13 = 5 THEN regexp_replace(line, '[a-m]', chr(57344), 'g') ELSE line END AS text, (doc_id + pos) % 3 = 0 OR doc_id % 5 = 0 AS hidden, least(length(line), 30) * 2 AS area FROM l"""


@query(rf"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM a), s AS ({LINE_SPANS}),
n AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS n, list_transform(regexp_split_to_array(text, '\s+'), lambda t: length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))) AS k FROM s),
v AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE NOT hidden), 0) AS vis, coalesce(sum(n) FILTER (WHERE hidden), 0) AS hid, coalesce(sum(area) FILTER (WHERE NOT hidden), 0) AS va, coalesce(sum(list_sum(k)) FILTER (WHERE NOT hidden), 0) AS letters,
  coalesce(max(list_max(k)) FILTER (WHERE NOT hidden), 0) AS longest, coalesce(sum(length(regexp_replace(text, '[^' || chr(65533) || chr(57344) || '-' || chr(63743) || ']', '', 'g'))) FILTER (WHERE NOT hidden), 0) AS bad FROM n WHERE n > 0 GROUP BY doc_id),
p AS (SELECT doc_id, 2000.0 AS area, (doc_id % 4) * 500.0 AS img FROM documents),
j AS (SELECT p.doc_id, area, img / area > 0.5 AS scan, coalesce(vis, 0) AS vis, coalesce(hid, 0) AS hid, coalesce(va, 0) AS va, coalesce(letters, 0) AS letters, coalesce(longest, 0) AS longest, coalesce(bad, 0) AS bad FROM p LEFT JOIN v USING (doc_id))
SELECT doc_id AS page, CASE WHEN vis = 0 AND hid = 0 THEN CASE WHEN scan THEN 'scanned' ELSE 'empty' END WHEN vis = 0 THEN 'ocr_layer'
  WHEN vis < 200 AND va < 0.05 * area AND scan AND hid > vis THEN 'ocr_layer'
  WHEN vis < 200 AND va < 0.05 * area AND scan AND (letters < 20 OR longest <= 3) THEN CASE WHEN hid > 0 THEN 'ocr_layer' ELSE 'scanned' END
  WHEN bad > 0.2 * vis THEN 'garbled' ELSE 'digital' END AS kind FROM j
""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    d, line = F.col("doc_id"), F.col("line")
    text = F.when(d % 11 == 3, F.left(line, F.lit(3))).when(d % 13 == 5, F.regexp_replace(line, "[a-m]", "\ue000")).otherwise(line)
    spans = lines_of(docs).select(d.alias("page"), text.alias("text"), (((d + F.col("pos")) % 3 == 0) | (d % 5 == 0)).alias("hidden"), (F.least(F.length("line"), F.lit(30)) * 2).alias("area"))
    pages = docs.select(d.alias("page"), F.lit(2000.0).alias("area"), ((d % 4) * 500.0).alias("image_area"))
    return layout.page_kinds(spans, pages)


def _boxes(rows: DataFrame, key: str, x: Column, y: Column, w: int, h: int) -> DataFrame:
    return rows.select(F.col(key).alias("id"), (F.col(key) % 7).alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))


@query("""
WITH s AS (SELECT event_id AS id, event_id % 7 AS page, event_id % 501 AS x0, event_id % 733 AS y0, event_id % 501 + 30 AS x1, event_id % 733 + 11 AS y1 FROM events),
b AS (SELECT c_custkey AS id, c_custkey % 7 AS page, c_custkey * 31 % 501 AS x0, c_custkey * 17 % 733 AS y0, c_custkey * 31 % 501 + 9 AS x1, c_custkey * 17 % 733 + 40 AS y1 FROM customer)
SELECT s.page, s.id AS span, b.id AS box FROM s JOIN b ON s.page = b.page AND s.x0 < b.x1 AND b.x0 < s.x1 AND s.y0 < b.y1 AND b.y0 < s.y1
""")
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = F.col("event_id"), F.col("c_custkey")
    spans = _boxes(read(spark, sf_dir, "events"), "event_id", e % 501, e % 733, 30, 11)
    boxes = _boxes(read(spark, sf_dir, "customer"), "c_custkey", c * 31 % 501, c * 17 % 733, 9, 40)
    return layout.overlapping(spans, boxes)


# ---- document formats
@query()
def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossmill.sources.html import html_units as units

    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(units(F.col("html"))).alias("pos", "u")).select("page_id", "pos", "u.*")


@query("WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) SELECT doc_id, CAST(pos AS INTEGER) AS pos, " + sql_strip("line") + rf" AS text FROM l WHERE regexp_matches(line, '{X.LETTER}')")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossmill.sources.plaintext import text_units

    return text_units(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "text")


@query("WITH v AS (SELECT event_type, date_trunc('hour', ts) AS hour, value FROM events) SELECT event_type, hour, count(*) AS n, round(sum(value), 4) AS total FROM v GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossmill.streaming.events import hourly_totals

    return hourly_totals(spark, f"{sf_dir}/events.parquet")
