"""Calls back to VCF text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.folders import path_of, shared_folder
from varloom.functions import cell, vcf_cell
from varloom.schema import RECORD_KEY
from varloom.sources import header as H


def _info(fields: list[H.Field]) -> Column:
    parts = []
    for f in fields:
        value = cell(f.column)
        text = F.lit(f.name) if f.type.lower() == "flag" else F.concat(F.lit(f"{f.name}="), vcf_cell(value))
        parts.append(F.when(value.isNotNull(), text))
    joined = F.array_join(F.array_compact(F.array(*parts)), ";") if parts else F.lit("")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def record_lines(calls: DataFrame, header: list[str], extant: list[str]) -> DataFrame:
    """(record key, line): one VCF line per record, samples in the header's order; a sample that is not there is an error.

    A sample without a row in the record is `.`.
    """
    names, there = H.samples(header), set(extant)
    fields = [f for f in H.fields(header) if f.column in there]
    forms = [f for f in fields if f.group == "FORMAT"]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("sample_name"))
    checked = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("a sample is not in the header: "), F.coalesce("sample_name", F.lit("null")))).cast("long"))
    own = F.array_join(F.array(*[vcf_cell(cell(f.column)) for f in forms]), ":") if forms else F.lit(".")
    rows = calls.select(
        *RECORD_KEY,
        F.struct(*[vcf_cell(F.col(c)).alias(c) for c in ("id", "quality")], F.coalesce(F.nullif("filters", F.lit("")), F.lit("PASS")).alias("filters"), _info([f for f in fields if f.group == "INFO"]).alias("info")).alias("fixed"),
        F.struct(checked.alias("place"), own.alias("text")).alias("sample"),
    )
    records = rows.groupBy(*RECORD_KEY).agg(F.min("fixed").alias("fixed"), F.collect_list("sample").alias("samples"))
    by_place = F.map_from_entries(F.transform(F.array_distinct(F.transform("samples", lambda s: s["place"])), lambda p: F.struct(p, F.filter("samples", lambda s: s["place"] == p)[0]["text"])))
    texts = F.array(*[F.coalesce(F.try_element_at(by_place, F.lit(i + 1).cast("long")), F.lit(".")) for i in range(len(names))])
    form = ":".join(f.name for f in forms) or "."
    line = F.concat_ws("\t", "contig", F.col("position").cast("string"), "fixed.id", "reference", F.coalesce("alternates", F.lit(".")), "fixed.quality", F.replace("fixed.filters", F.lit(","), F.lit(";")), "fixed.info", F.lit(form), F.array_join(texts, "\t"))
    return records.select(*RECORD_KEY, line.alias("line"))


def export_lines(calls: DataFrame, header: list[str], extant: list[str]) -> DataFrame:
    """All lines of the file in one column `value`: the header, then records in the order of export."""
    spark = calls.sparkSession
    top = spark.createDataFrame([(0, i, h) for i, h in enumerate(header)], "part int, at long, value string")
    body = record_lines(calls, header, extant)
    keys = [F.length("contig").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in RECORD_KEY]]
    nulls = [F.lit(None).cast(t).alias(c) for c, t in zip(RECORD_KEY, ("string", "int", "string", "string"))]
    both = top.select("part", "at", *nulls, "value").unionByName(body.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), *RECORD_KEY, F.col("line").alias("value")))
    return both.orderBy("part", "at", *keys).select("value")


def export_vcf(calls: DataFrame, header: list[str], extant: list[str], path: str) -> None:
    """Writes text files whose names sort in the file's order; a folder that exists is an error."""
    export_lines(calls, header, extant).write.mode("errorifexists").text(path)


def export_file(calls: DataFrame, header: list[str], extant: list[str], path: str) -> None:
    """One file with the header and all records in the order of export; a file that exists is an error."""
    write_one(export_lines(calls, header, extant), path)


def write_one(lines: DataFrame, path: str) -> None:
    """Ordered lines (column `value`) as one text file: tasks write parts of it, which the file system then joins in order.

    Where it can, it joins them without moving a byte; elsewhere their bytes are copied one after the other, some at a time.
    The file has its name only when it is whole.
    """
    spark = lines.sparkSession
    target, fs = path_of(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    parts, _ = path_of(spark, shared_folder(spark, "parts") if fs.getScheme() == "file" else f"{path}.parts")
    lines.select("value").write.text(str(parts))
    names = sorted(str(s.getPath()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen())
    whole, _ = path_of(spark, f"{path}.writing")
    try:
        if fs.getScheme() == "hdfs" and names:
            first, *rest = [path_of(spark, n)[0] for n in names]
            fs.rename(first, whole)
            if rest:
                gateway = spark.sparkContext._gateway
                array = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(rest))
                for i, p in enumerate(rest):
                    array[i] = p
                fs.concat(whole, array)
        else:
            out = fs.create(whole, True)
            for n in names:
                part = fs.open(path_of(spark, n)[0])
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
            out.close()
        if not fs.rename(whole, target):
            raise FileExistsError(path)
    finally:
        fs.delete(parts, True)
