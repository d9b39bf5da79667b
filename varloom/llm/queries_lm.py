"""op10: language-model scores of all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.lm import score_texts


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
