"""op1: quality rules over all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import quality


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cascade = quality.QualityCascade().fit(quality.few_files(docs))
    rows = quality.judged(docs, cascade)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows in DuckDB's SQL; windows are compared as the lists of their words.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM h) WHERE n > 1),
cov AS (
  SELECT doc_id, sum(CASE WHEN nxt IS NULL OR nxt - i > 8 THEN 8 ELSE nxt - i END) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
    OR 10 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 4 * length(text)
    OR 10 * n_dup_lines > 4 * len(lines)
    OR (20 * len(list_distinct(words)) < n_words AND len(list_distinct(words)) < 200)
    OR length(text) > 40 * n_words) AS kept
FROM c
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": OP1_SQL}
