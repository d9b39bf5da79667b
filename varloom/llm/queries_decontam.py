"""op9: documents that hold windows of benchmark items."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.decontam import find_contamination


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_text=True)


#: The same rows in DuckDB's SQL.
OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bx AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM bx),
ks AS (SELECT DISTINCT k FROM pat),
dx AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, dx.k, i, item FROM dx JOIN pat ON pat.k = dx.k AND pat.p = array_to_string(w[i:i + dx.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""

QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE_SQL = {"op9_decontamination": OP9_SQL}
