"""op11: near-duplicate groups of all documents by b-bit MinHash."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.minhash import near_duplicates


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows in DuckDB's SQL: all pairs that share a shingle, and what their links reach.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS h FROM s),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(doc_id, other) AS (SELECT u, v FROM both_ UNION SELECT reach.doc_id, both_.v FROM reach JOIN both_ ON both_.u = reach.other)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(r.least, n.doc_id)) AS component_id, n.doc_id <= coalesce(r.least, n.doc_id) AS kept
FROM n LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = n.doc_id
"""

QUERIES = {"op11_minhash_dedup": op11_minhash_dedup}
ORACLE_SQL = {"op11_minhash_dedup": OP11_SQL}
