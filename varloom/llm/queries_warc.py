"""op5: all pages written as WARC archives and read back through the index of captures."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.warc import archive_and_index


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_and_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB's SQL.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN CAST(kept AS BIGINT) END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""

QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL = {"op5_warc": OP5_SQL}
