"""The queries opN_<name> over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, fingerprints, kneser_ney, licenses, packing, passages, quality_rules, simhash, toxicity
from .shared import read_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, with_ids=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat_format.format_conversations(turns)
    digest = lambda s: F.sha2(F.encode(s, "UTF-8"), 256)
    back = formatted.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged_documents(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality_rules.MEASURES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_packing, op3_kneser_ney, op4_fingerprints, op5_chat_format, op6_passages, op7_licenses, op8_toxicity, op9_quality_rules, op10_simhash)}

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), n AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same, row_number() OVER w AS k,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0)
      + len(regexp_extract_all(text, '</turn>|<\|also\|>')) AS escaped
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(escaped + CASE WHEN same THEN 8 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), again AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, cast(sum(least(8, coalesce(next - i, 8))) AS BIGINT) AS n_repeat_words FROM again GROUP BY doc_id
), base AS (
  SELECT doc_id, lang, source, cast(len(words) AS BIGINT) AS n_words, cast(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len([x for x in list_zip(words, words[2:]) if x[1] = x[2]]) AS n_echoes,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_marks
  FROM d LEFT JOIN repeats USING (doc_id)
), m AS (
  SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    cast(least(1000, n_symbols * 1000 // greatest(word_chars, 1)) AS INT) AS symbol_rate,
    cast(least(1000, n_dup_lines * 1000 // greatest(n_lines, 1)) AS INT) AS dup_line_rate,
    cast(least(1000, n_repeat_words * 1000 // greatest(n_words, 1)) AS INT) AS repeat_rate,
    cast(least(1000, n_echoes * 1000 // greatest(n_words, 1)) AS INT) AS echo_rate,
    cast(least(1000, n_capitals * 1000 // greatest(word_chars, 1)) AS INT) AS capital_rate,
    cast(least(1000, n_marks * 1000 // greatest(word_chars, 1)) AS INT) AS mark_rate,
    cast(least(4000, word_chars * 100 // greatest(n_words, 1)) AS INT) AS mean_word
  FROM base
), v AS (
  SELECT doc_id, lang, source, base_failed, measure, value
  FROM (SELECT * FROM m) UNPIVOT (value FOR measure IN (symbol_rate, dup_line_rate, repeat_rate, echo_rate, capital_rate, mark_rate, mean_word))
), levels AS (
  SELECT 2 AS level, lang, source, measure, value FROM v WHERE NOT base_failed
  UNION ALL SELECT 1, lang, '', measure, value FROM v WHERE NOT base_failed
  UNION ALL SELECT 0, '', '', measure, value FROM v WHERE NOT base_failed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY value) AS k,
    count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM levels
), settings(measure, tail, reach, up, down) AS (
  VALUES ('symbol_rate', 900, 4, 30, NULL), ('dup_line_rate', 990, 2, 100, NULL), ('repeat_rate', 990, 2, 50, NULL), ('echo_rate', 900, 4, 5, NULL),
    ('capital_rate', 900, 4, 5, NULL), ('mark_rate', 900, 4, 20, NULL), ('mean_word', 900, 4, 20, 20)
), points AS (
  SELECT level, lang, source, measure, any_value(n) AS n, any_value(reach) AS reach, any_value(up) AS up, any_value(down) AS down,
    min(value) FILTER (k >= (n * (1000 - tail) + 999) // 1000) AS low, min(value) FILTER (k >= (n * 500 + 999) // 1000) AS median,
    min(value) FILTER (k >= (n * tail + 999) // 1000) AS high
  FROM ranked JOIN settings USING (measure) GROUP BY level, lang, source, measure
), raw AS (
  SELECT *, high + greatest(reach * (high - median), up) AS raw_most,
    CASE WHEN down IS NOT NULL THEN low - greatest(reach * (median - low), down) END AS raw_least FROM points
), fences AS (
  SELECT r.level, r.lang, r.source, r.measure, least(r.raw_most, r.median + 2 * (a.raw_most - a.median)) AS most,
    CASE WHEN r.down IS NOT NULL THEN greatest(r.raw_least, r.median - 2 * (a.median - a.raw_least)) END AS least
  FROM raw r JOIN raw a ON a.measure = r.measure AND a.level = 0 WHERE r.n >= 200 OR r.level = 0
), chosen AS (
  SELECT lang, source, max(level) AS level FROM (
    SELECT DISTINCT v.lang, v.source, f.level FROM v JOIN fences f
    ON f.level = 0 OR f.lang = v.lang AND (f.level = 1 OR f.source = v.source)) GROUP BY ALL
), beyond AS (
  SELECT DISTINCT v.doc_id FROM v JOIN chosen c ON c.lang = v.lang AND c.source = v.source JOIN fences f
  ON f.level = c.level AND f.measure = v.measure AND (f.level = 0 OR f.lang = v.lang) AND (f.level < 2 OR f.source = v.source)
  WHERE v.value > f.most OR f.measure = 'mean_word' AND v.value < f.least
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept,
  symbol_rate, dup_line_rate, repeat_rate, echo_rate, capital_rate, mark_rate, mean_word
FROM m
"""

ORACLE_SQL = {"op5_chat_format": _CHAT_SQL, "op9_quality_rules": _QUALITY_SQL}
