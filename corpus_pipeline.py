"""From raw documents to token ids: quality rules, near-duplicates, benchmark passages, personal data, encoding.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns documents with the columns
it got; the last returns ids.  Stages work on rows of any further columns, whatever their names: these travel in one struct
beside what an operator reads and adds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import bpe_codec, decontam, pii, quality, simhash
from varloom.llm.base import written

#: File of the vocabulary that the last stage encodes with, in the public tokenizers' folder.
VOCABULARY = "word_bpe_49k.json"


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of rules keeps."""
    cascade = quality.QualityCascade().fit(quality.few_files(docs))
    return cascade.transform(_packed(docs)).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(_packed(docs), benchmark).where("not contaminated").select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is brought up to date."""
    rows = pii.redact(docs)
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return rows


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text."""
    import public_tokenizers

    rows = bpe_codec.codec_digests(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), drop_text=True, with_ids=True)
    return rows.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", encoding),
]

#: Fingerprints, boosted trees and BPE have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
