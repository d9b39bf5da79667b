"""Transcripts for predicted effects, from a gene database's files: features as GTF text, coding sequences as FASTA text.

Both are read with Spark's own expressions, in parts of any size.  Features of a transcript meet by its name; lines that are no
features (comments, blank or short lines) are passed over.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features whose places make up the coding part: some databases leave the stop codon out of CDS.
CODING = ("CDS", "start_codon", "stop_codon")
COLUMNS = ("contig", "gene_name", "transcript", "strand", "exons", "cds_start", "cds_end", "sequence")


def _attribute(name: str) -> Column:
    """The first value of a key among `key "value"; key value;`, null where it is not there."""
    value = F.regexp_extract("attributes", rf'(?:^|;)\s*{name}\s+("?)([^";]*)\1', 2)
    return F.nullif(value, F.lit(""))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(contig, feature, start, end, strand, gene_name, transcript): lines of GTF text; without a gene's name its id stands."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).where("size(p) >= 9")
    at = lambda i: F.get("p", F.lit(i))
    rows = lines.select(at(0).alias("contig"), at(2).alias("feature"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), at(6).alias("strand"), at(8).alias("attributes"))
    rows = rows.where("start is not null and `end` >= start and strand in ('+', '-')")
    return rows.select("contig", "feature", "start", "end", "strand", F.coalesce(_attribute("gene_name"), _attribute("gene_id")).alias("gene_name"), _attribute("transcript_id").alias("transcript"))


def read_sequences(spark: SparkSession, path: str, versions: bool = False) -> DataFrame:
    """(transcript, sequence): records of FASTA text; names end at the first blank, and before `.1` and the like unless `versions`."""
    # a record ends where a line begins with >
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("r")).where("trim(r) <> ''")
    name = F.regexp_extract("r", r"^\S+" if versions else r"^[^\s.]+(?:\.(?!\d+(?:\s|$))[^\s.]*)*", 0)
    letters = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(name.alias("transcript"), F.upper(letters).alias("sequence"))


def transcripts_of(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """Transcripts as `operators.effects` takes them; one without coding features has no coding part, one without a sequence null."""
    coding, exon = F.col("feature").isin(*CODING), F.col("feature") == "exon"
    rows = features.where("transcript is not null").where(coding | exon).groupBy("contig", "transcript", "strand").agg(
        F.min("gene_name").alias("gene_name"),
        F.array_sort(F.collect_set(F.when(exon, F.struct("start", "end")))).alias("exons"),
        F.min(F.when(coding, F.col("start"))).alias("cds_start"),
        F.max(F.when(coding, F.col("end"))).alias("cds_end"),
    )
    found = sequences.groupBy("transcript").agg(F.max("sequence").alias("sequence"))
    return rows.where("size(exons) > 0").join(found, "transcript", "left").select(*COLUMNS)


def read_transcripts(spark: SparkSession, gtf: str, cds: str, versions: bool = False) -> DataFrame:
    """Transcripts of a gene database's release."""
    return transcripts_of(read_features(spark, gtf), read_sequences(spark, cds, versions))
