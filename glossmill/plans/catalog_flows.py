"""Registered queries of the end-to-end flows and of the editor's and the server's rules, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import answers, carets, languages, scripts
from glossmill.functions import text as X
from glossmill.functions.chunks import pack_paragraphs
from glossmill.operators import editor, flows, glossary, jobs, layout, model, packing, report
from glossmill.plans import fixtures as R
from glossmill.plans.catalog import HITS, SENTENCES, lines_of, query, read, sql_mock, sql_needs_document, sql_squash, sql_strip, sql_tokens
from glossmill.sources import html, plaintext

PARAGRAPHS_SQL = rf"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n[ \t]*\n'), lambda x: {sql_strip('x')}), lambda x: x <> '')"


# ---- flows
@query(f"WITH p AS (SELECT doc_id, {PARAGRAPHS_SQL} AS a FROM documents) SELECT doc_id, len(a) AS n_units, md5(array_to_string(list_transform(a, lambda x: '[de] ' || x), chr(10) || chr(10))) AS digest FROM p")
def text_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from detection to the joined translation; units are whole paragraphs here."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = flows.translate_texts(docs, "doc_id", "text", model.mock_engine, "de", max_chars=1 << 30)
    return done.select("doc_id", "n_units", F.md5("translation").alias("digest"))


@query()
def text_flow_in_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As text_flow with units of 1,200 characters, terms and detected languages."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = flows.translate_texts(docs, "doc_id", "text", model.mock_engine, "de", entries=R.TERMS.frame(spark))
    return done.select("doc_id", "n_units", "mode", "primary_language", "shown_lang", F.size("hits").alias("n_hits"), F.md5("translation").alias("digest"))


NEEDS_SERVICE = r"""(regexp_matches(regexp_replace(text, '(?i)(?:https?://|ftp://|www[.])\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+', ' ', 'g'), '[\p{L}\p{Nl}\p{No}]')
  AND NOT (regexp_matches(trim(text), '^[A-Z0-9][A-Z0-9_./:#()-]*$') AND regexp_matches(text, '[0-9]')))"""


@query(f"""
WITH RECURSIVE w AS (SELECT conv_id, turn, text, {sql_tokens('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE {NEEDS_SERVICE}),
p AS (SELECT conv_id, turn, text, i, t AS n, 1 AS k, 0 AS batch FROM w WHERE i = 1
  UNION ALL SELECT w.conv_id, w.turn, w.text, w.i, CASE WHEN p.n + w.t > 2000 OR p.k >= 30 THEN w.t ELSE p.n + w.t END, CASE WHEN p.n + w.t > 2000 OR p.k >= 30 THEN 1 ELSE p.k + 1 END,
    p.batch + CASE WHEN p.n + w.t > 2000 OR p.k >= 30 THEN 1 ELSE 0 END FROM p JOIN w ON w.conv_id = p.conv_id AND w.i = p.i + 1)
SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch, {sql_strip(sql_mock('text', 'fr'))} AS output FROM p
UNION ALL SELECT conv_id, turn, NULL, text FROM conversations WHERE NOT {NEEDS_SERVICE}
""")
def batch_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as items of batches."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return flows.translate_items(turns, "conv_id", "turn", "text", model.mock_engine, "fr").select("conv_id", "turn", "batch", "output")


def _read_lines(c):
    return F.transform(F.split(c, "\n"), lambda x: F.struct(X.strip(x).alias("text")))


def _write_lines(c, outputs):
    return F.array_join(F.zip_with(F.split(c, "\n"), outputs, lambda line, out: F.when(out.isNull(), line).otherwise(X.keep_outer_whitespace(line, out))), "\n")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
o AS (SELECT doc_id, i, {sql_needs_document('line')} AS need, CASE WHEN {sql_needs_document('line')} THEN regexp_extract(line, '^\s*') || '[it] ' || {sql_strip('line')} || regexp_extract(line, '\s*$') ELSE line END AS x FROM l)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE need) AS n_translated, md5(string_agg(x, chr(10) ORDER BY i)) AS digest FROM o GROUP BY doc_id
""")
def file_flow_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text files: lines scanned, distinct ones translated, the file written."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = flows.translate_documents(docs, "doc_id", "text", _read_lines, _write_lines, model.mock_engine, "it")
    return done.select("doc_id", "n_units", "n_translated", F.md5("text").alias("digest"))


@query()
def file_flow_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: units scanned, distinct ones translated, the pages written with all else as it was."""
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    done = flows.translate_documents(pages, "page_id", "html", html.html_units, html.write_pages, model.mock_engine, "it")
    return done.select("page_id", "n_units", "n_translated", F.md5("html").alias("digest"))


@query()
def file_flow_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as Markdown."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = flows.translate_documents(docs, "doc_id", "text", plaintext.markdown, plaintext.write_markdown_column, model.mock_engine, "it")
    return done.select("doc_id", "n_units", "n_translated", F.md5("text").alias("digest"))


@query(f"""
WITH {HITS}, t AS (SELECT conv_id, turn // 4 AS batch, {sql_squash('text')} AS x FROM conversations), h AS (SELECT DISTINCT conv_id, batch, pos, source FROM t JOIN terms ON regexp_matches(x, rx))
SELECT conv_id, CAST(batch AS INTEGER) AS batch, string_agg(source, '|' ORDER BY pos) AS terms FROM h GROUP BY conv_id, batch
""")
def batch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", F.floor(F.col("turn") / 4).cast("int").alias("batch"))
    found = flows.batch_terms(turns, "conv_id", "text", R.TERMS.frame(spark), "de")
    return found.select("conv_id", "batch", F.array_join(F.transform("terms", lambda t: t["source"]), "|").alias("terms"))


# ---- units and detection
@query(rf"""
WITH s AS (SELECT doc_id, {sql_strip('text')} AS t FROM documents),
u AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '\n{{2,}}|([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: length(x) >= 8) AS a FROM s)
SELECT doc_id, CASE WHEN len(a) > 0 THEN len(a) ELSE 1 END AS n, CAST(CASE WHEN len(a) > 0 THEN list_sum(list_transform(a, lambda x: length(x))) ELSE length(t) END AS BIGINT) AS chars FROM u
""")
def detection_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return read(spark, sf_dir, "documents").select("doc_id", scripts.detection_units(F.col("text")).alias("u")).select("doc_id", F.size("u").cast("long").alias("n"), units.alias("chars"))


@query(f"WITH {SENTENCES} SELECT doc_id, md5(string_agg(u, ' ')) IS NOT NULL AS whole FROM u GROUP BY doc_id")
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older packing of 600 characters: nothing but white space is lost."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", pack_paragraphs(F.col("text"), 600).alias("u"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return docs.where(F.size("u") > 0).select("doc_id", (bare(F.array_join("u", "")) == bare(F.col("text"))).alias("whole"))


@query()
def sentence_at_caret(spark: SparkSession, sf_dir: str) -> DataFrame:
    caret = F.col("doc_id") * 37 % F.greatest(F.length("text"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", caret.alias("caret"), carets.sentence_at(F.col("text"), caret).alias("sentence"))


# ---- the editor
@query("SELECT item_id FROM benchmark WHERE contains(lower(text), 'ing')")
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.lit("").alias("target"), F.lit(None).cast("string").alias("note"))
    return editor.filtered_rows(rows, " ING ").select("item_id")


@query(rf"""
WITH t AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), e AS (SELECT pos, lower(source) AS s FROM {R.TERMS.sql()} WHERE enabled)
SELECT doc_id, count(*) AS n FROM t JOIN e ON contains(x, s) GROUP BY doc_id
""")
def draft_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editor.draft_entries(read(spark, sf_dir, "documents"), R.TERMS.frame(spark), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT user_id AS req, event_id, event_type || CASE WHEN event_id % 3 = 0 THEN upper(left(props, 2)) ELSE left(props, 2) END AS value FROM events), f AS (SELECT req, lower(value) AS k, min(event_id) AS o, arg_min(value, event_id) AS value FROM a WHERE lower(value) <> 'click{"' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY o) AS n FROM f) SELECT req, CAST(n AS INTEGER) AS n, value FROM r WHERE n <= 5
""")
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.left("props", F.lit(2))
    value = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.upper(start)).otherwise(start))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("req"), "event_id", value.alias("value"), F.lit(' CLICK{"').alias("span"))
    return editor.alternatives(rows, "req", "event_id", "span", "value")


@query("SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 30")
def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty keys used last; the cap is the feature."""
    return editor.remembered(read(spark, sf_dir, "events"), "user_id", "ts").select("user_id")


@query(f"""
WITH c AS (SELECT conv_id, turn, text, {sql_mock('text', 'de')} AS o FROM conversations)
SELECT conv_id, turn, CASE WHEN len(string_split_regex(text, '\\n[ \\t]*\\n')) > 1 AND len(string_split_regex(text, '\\n[ \\t]*\\n')) = len(string_split_regex(o, '\\n[ \\t]*\\n')) THEN len(string_split_regex(text, '\\n[ \\t]*\\n')) ELSE 1 END AS n_pairs,
  CASE WHEN len(string_split_regex(text, '\\n[ \\t]*\\n')) > 1 THEN array_to_string(list_transform(string_split_regex(o, '\\n[ \\t]*\\n'), lambda x: {sql_strip('x')}), chr(10) || chr(10)) ELSE {sql_strip('o')} END AS source FROM c
""")
def swapped_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("source"), X.mock_translate(F.col("text"), "de").alias("target"), F.lit("en").alias("source_lang"), F.lit("de").alias("target_lang"))
    return editor.swapped(turns).select("conv_id", "turn", F.size("pinned").cast("long").alias("n_pairs"), "source")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'ko' END ELSE 'de' END AS target FROM documents")
def automatic_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    remembered_ = F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("de")
    target = editor.automatic_target(F.lit("auto"), F.lit("de"), F.lit("single"), F.col("lang"), remembered_)
    return read(spark, sf_dir, "documents").select("doc_id", target.alias("target"))


@query("""
WITH r AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN substr(text, 4, 5) ELSE substr(text, 9, 4) END AS span FROM benchmark)
SELECT item_id, CASE WHEN substr(text, 4, length(span)) = span THEN left(text, 3) || '<>' || substr(text, 4 + length(span)) WHEN instr(text, span) > 0 THEN left(text, instr(text, span) - 1) || '<>' || substr(text, instr(text, span) + length(span)) ELSE text END AS text FROM r
""")
def applied_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.when(F.col("item_id") % 2 == 0, F.substring("text", 4, 5)).otherwise(F.substring("text", 9, 4))
    rows = read(spark, sf_dir, "benchmark").withColumn("span", span)
    new = editor.with_alternative(F.col("text"), F.lit(3), F.lit(3) + F.length("span"), F.col("span"), F.lit("<>"))
    return rows.select("item_id", new.alias("text"))


@query("SELECT event_id, user_id % 256 BETWEEN 64 AND 127 OR user_id % 256 = 7 AS allowed FROM events")
def allowed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("ip"))
    ranges = spark.createDataFrame([("10.0.0.64/26",), ("10.0.0.7",), ("192.168.0.0/16",)], "cidr string")
    return editor.allowed(visits, ranges).select("event_id", "allowed")


# ---- jobs and files
@query(f"""
WITH l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {sql_needs_document('line')})
SELECT doc_id, count(*) AS units, CAST(sum(length(line)) AS BIGINT) AS chars, sum(length(line)) <= 3000 AS allowed FROM l GROUP BY doc_id
""")
def text_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.text_chars(lines_of(read(spark, sf_dir, "documents")), "doc_id", "line", 3000)


@query("""
WITH f AS (SELECT user_id, event_type AS m, min(event_id) AS o FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n FROM f)
SELECT user_id, string_agg(m, ',' ORDER BY o) AS warnings FROM r WHERE n <= 3 GROUP BY user_id
""")
def job_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.warnings(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", most=3)
    return rows.select("user_id", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 4")
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent_samples(read(spark, sf_dir, "events"), "user_id", "event_id", keep=4).select("event_id")


@query("""
WITH f AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.TXT' WHEN 2 THEN '.xls' WHEN 3 THEN '' ELSE '.htm' END AS e FROM documents)
SELECT doc_id, lower(e) AS ext, CASE doc_id % 5 WHEN 0 THEN 'office' WHEN 1 THEN 'text' WHEN 4 THEN 'html' END AS family, e = '.xls' AS better FROM f
""")
def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 5
    name = F.concat(F.lit("a.b/file"), F.when(d == 0, ".docx").when(d == 1, ".TXT").when(d == 2, ".xls").when(d == 3, "").otherwise(".htm"))
    rows = languages.dispatched(read(spark, sf_dir, "documents").select("doc_id", name.alias("name")), "name")
    return rows.select("doc_id", "ext", "family", F.coalesce(F.col("hint") == "save as .xlsx", F.lit(False)).alias("better"))


@query("SELECT doc_id, coalesce(text, '') AS content, NULL AS error FROM documents")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model server: reasoning goes, the content stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    message = F.struct(F.concat(F.lit("<think>let me see</think>\n"), "text").alias("content"))
    body = F.to_json(F.struct(F.array(F.struct(message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.lit("m").alias("model")))
    return docs.select("doc_id", answers.choice(body).alias("c")).select("doc_id", "c.content", "c.error")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
s AS (SELECT doc_id, pos, 10.0 + (doc_id + pos) % 4 * 5 AS size, length(line) AS n FROM l), m AS (SELECT doc_id, median(size) AS m FROM s GROUP BY doc_id)
SELECT doc_id AS doc, CAST(pos AS INTEGER) AS pos, CASE WHEN n < 200 AND size >= 1.7 * m THEN 1 WHEN n < 200 AND size >= 1.3 * m THEN 2 ELSE 0 END AS level FROM s JOIN m USING (doc_id)
""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), "pos", F.col("line").alias("text"), (F.lit(10.0) + (F.col("doc_id") + F.col("pos")) % 4 * 5).alias("size"))
    return layout.headings(lines).select("doc", "pos", "level")


@query(f"""
WITH RECURSIVE r AS (SELECT item_id AS pos, text FROM benchmark),
n AS (SELECT pos, text, len(regexp_extract_all(text, '[0-9]+')) AS k FROM r)
SELECT pos, k > 0 AS any_digits FROM n
""")
def digits_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare digit runs are among a translation's numbers."""
    from glossmill.functions.numbers import target_numbers

    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), (F.size(target_numbers(F.col("text"))) > 0).alias("any_digits"))


@query(f"""
WITH e AS (SELECT pos, source, target FROM {R.TERMS.sql()} WHERE enabled AND target_lang = 'de' AND lower(source_lang) LIKE 'en%'),
b AS (SELECT item_id AS pos, text AS s, '[de] ' || regexp_replace(text, '[aeiou]', '', 'g') AS t FROM benchmark), d AS (SELECT s, t, min(pos) AS pos FROM b GROUP BY s, t),
h AS (SELECT d.pos, e.pos AS n, e.source, e.target FROM d JOIN e ON regexp_matches(lower(s), '(^|[^a-z0-9])' || lower(e.source) || '($|[^a-z0-9])') AND NOT regexp_matches(lower(t), '(^|[^a-z0-9])' || lower(e.target) || '($|[^a-z0-9])'))
SELECT pos, 'term not applied: ' || source || ' → ' || target AS issue FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n) AS k FROM h) WHERE k <= 5
""")
def report_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with all terms of a direction: their order, and five issues at most."""
    bench = read(spark, sf_dir, "benchmark")
    pairs = bench.select(F.col("item_id").alias("pos"), F.col("text").alias("source"), F.concat(F.lit("[de] "), F.regexp_replace("text", "[aeiou]", "")).alias("target"))
    entries = glossary.directed(R.TERMS.frame(spark), "de", "en").select("pos", "source", "target")
    return report.report_items(pairs, entries, "en", "de", None).where(F.col("issue").startswith("term")).select("pos", "issue")


@query(f"""
WITH p AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: x) AS a FROM documents), w AS (SELECT doc_id, text, a, list_transform(range(1, len(a) + 1), lambda i: length(array_to_string(a[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS s FROM p)
SELECT doc_id, left(array_to_string(a, chr(10)), 500) AS preview FROM w
""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each row, be its id repeated or its text null."""
    rows = read(spark, sf_dir, "documents").select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("key"), "text")
    lines = rows.select("key", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return report.preview(lines, "key", "pos", "line", 500).select("key.doc_id", "preview")


@query("""
WITH j AS (SELECT user_id AS job, max(event_id) AS rev, max(value) AS v FROM events GROUP BY user_id)
SELECT job, CASE WHEN job % 3 = 0 THEN v ELSE -1.0 END AS v FROM j WHERE job % 3 <> 0 OR job % 5 <> 0
""")
def polled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a poll for every third job: the server has them but for every fifth; the others were changed meanwhile."""
    events = read(spark, sf_dir, "events")
    own = events.groupBy(F.col("user_id").alias("job")).agg(F.max("event_id").alias("rev"), F.max("value").alias("server"))
    local = own.select("job", "rev", F.lit(-1.0).alias("v"))
    asked = own.select("job", F.when(F.col("job") % 3 == 0, F.col("rev")).otherwise(F.col("rev") - 1).alias("rev"))
    server = own.where("job % 5 <> 0").select("job", F.col("server").alias("v"))
    return jobs.merge_rows(local, server, asked, "job").select("job", "v")


@query(f"""
WITH t AS (SELECT doc_id, {sql_tokens('text')} AS n FROM documents) SELECT doc_id, CASE WHEN n % 4 = 0 THEN 1 ELSE 3 END AS wait FROM t WHERE n % 4 <= 1
""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.estimate_tokens(F.col("text")) % 4
    wait = answers.next_try(F.when(n <= 1, 503).otherwise(200), F.lit(True), F.when(n == 0, 1).otherwise(2))
    return read(spark, sf_dir, "documents").select("doc_id", wait.alias("wait")).where("wait IS NOT NULL")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(DISTINCT line) FILTER (WHERE {sql_needs_document('line')}) AS n FROM l GROUP BY doc_id")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a document's translation pays for."""
    lines = lines_of(read(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count_distinct(F.when(X.needs_translation_document(F.col("line")), F.col("line"))).alias("n"))


@query(f"""
WITH RECURSIVE l AS (SELECT conv_id, turn, {sql_tokens('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, t AS n, 1 AS k, 0 AS batch FROM l WHERE i = 1
  UNION ALL SELECT l.conv_id, l.turn, l.i, CASE WHEN p.n + l.t > 300 OR p.k >= 3 THEN l.t ELSE p.n + l.t END, CASE WHEN p.n + l.t > 300 OR p.k >= 3 THEN 1 ELSE p.k + 1 END, p.batch + CASE WHEN p.n + l.t > 300 OR p.k >= 3 THEN 1 ELSE 0 END
  FROM p JOIN l ON l.conv_id = p.conv_id AND l.i = p.i + 1)
SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch FROM p
""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return packing.pack_batches(turns, "conv_id", "turn", X.estimate_tokens(F.col("text")), 300, 3).select("conv_id", "turn", "batch")
