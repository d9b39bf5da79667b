"""The call table in buckets of whole calls: runs are compared bucket by bucket, without moving their rows.

Each call carries its key as one text; of every run the calls of one key lie in the bucket of the same number.  A join of
two runs on that text needs no exchange, however many runs and calls there are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varloom.schema import CALL_ID, CALL_KEY, CALLS, NULLABLE
from varloom.sources import header as H
from varloom.sources.vcf import facts, observed, read_vcf

#: Enough that a bucket of the longest run fits into a task's memory.
BUCKETS = 64
#: Calls of all runs that a bucket should hold at most, where their number is known.
BUCKET_ROWS = 500_000
MODE = "spark.sql.sources.partitionOverwriteMode"


def call_id() -> Column:
    """A call's key as one text.  Cells of VCF text hold no tabs, and a missing reference or alternate is `.` there too."""
    parts = [F.coalesce(F.col(c), F.lit(".")) if c in NULLABLE else F.col(c).cast("string") for c in CALL_KEY]
    return F.concat(*[x for p in parts for x in (F.lit("\t"), p)][1:])


def create(spark: SparkSession, name: str, columns: list[str] | None = None, buckets: int = BUCKETS, location: str | None = None) -> None:
    """A bucketed table in the session's catalog, partitioned by run; its files lie at `location` or in the warehouse."""
    kept = [f for f in CALLS.fields if f.name != "vcf_id" and (columns is None or f.name in {*CALL_KEY, *columns})]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ddl}, {CALL_ID} string, vcf_id bigint) USING parquet PARTITIONED BY (vcf_id)"
        f" CLUSTERED BY ({CALL_ID}) SORTED BY (contig, position) INTO {buckets} BUCKETS{place}"
    )


def buckets_for(calls: int, least: int = 1) -> int:
    """How many buckets so many calls need: a task reads, sorts and joins one of them."""
    return max(least, -(-calls // BUCKET_ROWS))


def buckets_of(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def write(calls: DataFrame, name: str) -> None:
    """Puts runs into the table, in place of what it has of them: one file for each run and bucket, in order of position."""
    spark = calls.sparkSession
    target = spark.table(name)
    rows = calls.withColumn(CALL_ID, call_id()).select(*[F.col(f"`{c}`") for c in target.columns])
    dealt = rows.repartition(buckets_of(spark, name), CALL_ID).sortWithinPartitions("vcf_id", "contig", "position")
    # tables of a catalog know no such option of one write
    before = spark.conf.get(MODE)
    spark.conf.set(MODE, "dynamic")
    try:
        dealt.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(MODE, before)


def ingest(spark: SparkSession, path: str, vcf_id: int, name: str, header: list[str] | None = None) -> dict:
    """Reads a VCF file once into its run's partition; returns what runs record."""
    header, seen = header or H.read_header(spark, path), Observation()
    write(observed(read_vcf(spark, path, vcf_id, header), seen), name)
    found = facts(seen)
    if not found["genotype_count"]:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (vcf_id = {vcf_id})")
    return {"vcf_header": "\n".join(header), "vcf_release": H.release_of(header), **found}
