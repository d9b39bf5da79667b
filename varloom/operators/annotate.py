"""Gene annotations from a table of gene models, joined by interval."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import cell
from varloom.operators.calls import same
from varloom.schema import ANNOTATIONS, RECORD_KEY

#: Bases in a bin of the interval join.
BIN = 1 << 16


def annotations(calls: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(record key, annotation columns): for each variant the gene model of highest priority that covers its position.

    `genes` has contig, start, end (closed), priority and the annotation columns.  Both sides are joined by contig and bin,
    so that no contig is compared with all its genes; ties are resolved by the gene's name and transcript.
    """
    variants = calls.select(*RECORD_KEY).distinct().withColumn("_bin", F.expr(f"position div {bin_size}"))
    models = genes.withColumn("_bin", F.explode(F.expr(f"sequence(cast(start div {bin_size} as long), cast(end div {bin_size} as long))")))
    models = models.select(F.col("contig").alias("_contig"), "_bin", "start", "end", "priority", *[cell(c) for c in ANNOTATIONS])
    on = (variants["contig"] == models["_contig"]) & (variants["_bin"] == models["_bin"]) & variants["position"].between(models["start"], models["end"])
    best = F.min(F.struct((-F.col("priority")).alias("p"), *[cell(c) for c in ANNOTATIONS])).alias("b")
    found = variants.join(models, on).groupBy(*RECORD_KEY).agg(best)
    return found.select(*RECORD_KEY, *[F.col("b").getField(c).alias(c) for c in ANNOTATIONS])


def annotated(calls: DataFrame, found: DataFrame) -> DataFrame:
    """The calls with new annotations where there are any, else their old ones."""
    new = found.select(*[F.col(c).alias(f"_{c}") for c in RECORD_KEY], *[cell(c).alias(f"_{c}") for c in ANNOTATIONS])
    rows = calls.join(new, same(calls, new, RECORD_KEY, "_"), "left")
    return rows.select(*[F.coalesce(cell(f"_{c}"), cell(c)).alias(c) if c in ANNOTATIONS else cell(c) for c in calls.columns])
