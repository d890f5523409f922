"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each query applies its operator to the whole table; the contract's columns are derived from what it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import bpe_automaton, chat_format, hyperlang, media, mixing, neardup, quality, repetition, runtime, suffix_lm, toxicity


#: The vocabulary file; public_tokenizers gives its place.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(runtime.read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: Labels are learned from rows whose crc32(doc_id) modulo 5 is not 0.
LABEL_FOLDS = 5
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3


def _classified(spark: SparkSession, sf_dir: str, method, label: str, least: float) -> DataFrame:
    docs = runtime.read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = runtime.crc_mod("doc_id", LABEL_FOLDS)
    model = method.learn(docs, runtime.read(spark, sf_dir, "labels").select("doc_id", label), fold != 0, label)
    scored = method.predict(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic", TOXIC_FROM)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, "quality", QUALITY_FROM)


#: Learned from rows with another remainder of crc32(doc_id) modulo 10.
LM_FOLDS = 10


def op4_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_lm.score(runtime.read(spark, sf_dir, "documents"), runtime.crc_mod("doc_id", LM_FOLDS) != 0)
    held = (~F.col("learned") & F.col("doc_id").isNotNull()).alias("held_out")
    return got.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    docs = runtime.read(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.store_text(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return media.read_back(stored).drop("media")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_and_digest(runtime.read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


#: A conversation of control strings, beside those of the table.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = runtime.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.digests(chat_format.windows(turns.unionByName(control)))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(runtime.read(spark, sf_dir, "documents"), size=3, percent=85)


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    return repetition.repetition_rules(runtime.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Learned from rows with another remainder of crc32(doc_id) modulo 4.
LANGUAGE_FOLDS, LANGUAGE_HELD = 4, 2


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.read(spark, sf_dir, "documents")
    fold = runtime.crc_mod("doc_id", LANGUAGE_FOLDS)
    model = hyperlang.learn(docs.where(fold != LANGUAGE_HELD))
    held = F.coalesce(fold == LANGUAGE_HELD, F.lit(False)).alias("held_out")
    return hyperlang.predict(docs.select("doc_id", held, "text"), model).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_quality, op4_suffix_lm, op5_media, op6_bpe, op7_chat, op8_neardup, op9_repetition, op10_language)}


OP7_SQL = rf"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
sized AS (SELECT *, greatest(1, (length(text) + 3) // 4) AS tokens FROM src),
ordered AS (
  SELECT *, row_number() OVER w AS n, sum(tokens) OVER w - tokens AS before FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
summed AS (
  SELECT *, n = 1 AND role = 'system' AND tokens <= {chat_format.SYSTEM} AS is_system,
    {chat_format.BUDGET - chat_format.LONGEST - chat_format.HISTORY_TOKENS} - coalesce(max(tokens) FILTER (WHERE n = 1 AND role = 'system' AND tokens <= {chat_format.SYSTEM}) OVER (PARTITION BY conv_id), 0) AS wide
  FROM ordered),
flagged AS (
  SELECT *, CASE WHEN n > 1 AND (before // wide <> lag(before // wide) OVER w
    OR tokens > {chat_format.LONGEST} OR lag(tokens > {chat_format.LONGEST}) OVER w) THEN 1 ELSE 0 END AS opens
  FROM summed WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS win FROM flagged),
spans AS (
  SELECT *, max(n) OVER (PARTITION BY conv_id, win) AS last_n, max(before + tokens) OVER (PARTITION BY conv_id, win) AS last_sum,
    max(win) OVER (PARTITION BY conv_id) AS last_win FROM placed),
counted AS (
  SELECT *, 1 + CASE WHEN is_system THEN last_win
    WHEN n > last_n - {chat_format.HISTORY} AND last_sum - before <= {chat_format.HISTORY_TOKENS} AND win < last_win THEN 1 ELSE 0 END AS times,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g'))
      + {len(chat_format.HEAD + chat_format.HEAD_END + chat_format.TAIL)} AS chars FROM spans)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(times * chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.a),
least_id AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least_id l ON l.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op8_neardup": OP8_SQL}
