"""op7 and op8: near-duplicate groups, and repeated byte strings, of all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.simhash import near_duplicates
from varloom.llm.substrings import remove_repeats


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = remove_repeats(docs)
    removed = (F.col("n_bytes") - F.length("kept")).alias("n_removed")
    return rows.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_simhash_dedup": op7_simhash_dedup, "op8_substring_dedup": op8_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
