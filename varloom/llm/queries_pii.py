"""op6: personal data in all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.pii import find_spans


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_spans(docs, drop_text=True)


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
