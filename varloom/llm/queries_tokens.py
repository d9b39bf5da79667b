"""op2 and op3: token counts, and BPE encoding and decoding, of all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.bpe_codec import codec_digests
from varloom.llm.token_counts import count_tokens

LIMIT = 1024


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), LIMIT, drop_text=True)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return codec_digests(docs, public_tokenizers.path("word_bpe_49k.json"), drop_text=True)


QUERIES = {"op2_token_counts": op2_token_counts, "op3_bpe_codec": op3_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
