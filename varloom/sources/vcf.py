"""Reading VCF text as calls: one row for each record and sample, cells as text.  All native; files are split as text is."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varloom.folders import path_of
from varloom.functions import cell
from varloom.schema import CALLS, EXTANT_CANDIDATES
from varloom.sources import header as H


#: Files that a task may have open at once.  With more than none Spark does not sort by run first, and these rows are of one run.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _text(value: Column) -> Column:
    return F.when((value != ".") & (value != ""), value)


def _list(value: Column, f: H.Field) -> Column:
    """List text of a field with several values: `[1, 2]`, or `['a', 'b']` for strings."""
    if not f.is_list:
        return value
    mark = "'" if f.type.lower() in ("string", "character") else ""
    inner = F.array_join(F.transform(F.split(value, ","), lambda x: F.concat(F.lit(mark), x, F.lit(mark))), ", ")
    return F.when(value.isNotNull(), F.concat(F.lit("["), inner, F.lit("]")))


def _has_key(name: str):
    return lambda x: F.substring_index(x, "=", 1) == name


def read_vcf(spark: SparkSession, path: str, vcf_id: int, header: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Calls of a VCF file (any path that Spark reads), with the columns of the call table; `ordered` by contig and position
    within partitions.  Lines are sorted then, not calls: these have a hundred columns, and there is one for each sample.

    `.` and '' are null; FILTER PASS is null; several filters or alternates are joined by commas.  Fields that the header
    does not declare, or that the call table has no column for, are left out.
    """
    header = header or H.read_header(spark, path)
    names = H.samples(header)
    declared = [f for f in H.fields(header) if H.known(f)]
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if ordered:
        place = F.get(F.split("value", "\t", 3), F.lit(1)).try_cast("int")
        lines = lines.withColumns({"_contig": F.substring_index("value", "\t", 1), "_position": place}).sortWithinPartitions("_contig", "_position").select("value")
    return calls_of_lines(lines, vcf_id, names, declared)


def calls_of_lines(lines: DataFrame, vcf_id: int, names: list[str], declared: list[H.Field]) -> DataFrame:
    """Calls of record lines (column `value`): a record's own parts are read once, then it is repeated for its samples."""
    at = lambda i: F.get(F.col("p"), F.lit(i))
    own = {}
    for f in declared:
        if f.group == "INFO":
            # of a key that is repeated the last one counts
            entry = F.try_element_at(F.filter("info", _has_key(f.name)), F.lit(-1))
            if f.type.lower() == "flag":
                own[f.column] = F.when(entry.isNotNull(), F.lit("True"))
            else:
                own[f.column] = _list(_text(F.when(entry.contains("="), F.substr(entry, F.lit(len(f.name) + 2)))), f)
    records = lines.select(F.split("value", "\t").alias("p")).select("p", F.split(at(7), ";").alias("info")).select(
        at(0).alias("contig"), at(1).try_cast("int").alias("position"), _text(at(2)).alias("id"), at(3).alias("reference"),
        _text(at(4)).alias("alternates"), _text(at(5)).alias("quality"),
        F.when(at(6) != "PASS", F.replace(_text(at(6)), F.lit(";"), F.lit(","))).alias("filters"),
        *[c.alias(n) for n, c in own.items()], F.split(at(8), ":").alias("keys"),
        F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("sample_name"), F.slice("p", H.FIXED + 1, len(names)).alias("cell")).alias("samples"),
    )
    rows = records.withColumn("s", F.explode("samples")).withColumn("cells", F.split("s.cell", ":"))
    cells = {"vcf_id": F.lit(vcf_id), "sample_name": F.col("s.sample_name")}
    for f in declared:
        if f.group == "FORMAT":
            cells[f.column] = _list(_text(F.get("cells", F.array_position("keys", f.name).cast("int") - 1)), f)
    there = set(records.columns)
    return rows.select(*[cells.get(f.name, cell(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in CALLS.fields])


def ingest(spark: SparkSession, path: str, vcf_id: int, table: str, header: list[str] | None = None) -> dict:
    """Writes a file's calls as the run's partition of the call table (again replaces it); returns what runs record.

    The header is that of the file, or given for files without one.
    """
    header = header or H.read_header(spark, path)
    seen = Observation()
    # position ranges skip row groups of sorted files
    write_run(observed(read_vcf(spark, path, vcf_id, header, True), seen), table, True)
    found = facts(seen)
    if not found["genotype_count"]:
        # overwriting touches only partitions that the new rows have
        old, files = path_of(spark, f"{table}/vcf_id={vcf_id}")
        files.delete(old, True)
    return {"vcf_header": "\n".join(header), "vcf_release": H.release_of(header), **found}


def observed(calls: DataFrame, seen: Observation) -> DataFrame:
    """The calls of one run; once they have been written, `seen` has what runs record of them.  They are read only once."""
    there = [F.bool_or(cell(c).isNotNull()).alias(c) for c in EXTANT_CANDIDATES]
    return calls.observe(seen, F.count("*").alias("genotype_count"), *there)


def facts(seen: Observation) -> dict:
    try:
        found = seen.get
    except Py4JJavaError:
        # a plan that turns out to have no rows leaves out what observes them
        return {"extant_columns": [], "genotype_count": 0}
    return {"extant_columns": [c for c in EXTANT_CANDIDATES if found[c]], "genotype_count": found["genotype_count"]}


def write_run(calls: DataFrame, table: str, ordered: bool = False) -> None:
    """Writes a run's calls as its partition, in place of what it was, sorted within files; `ordered` calls are so already."""
    rows = calls if ordered else calls.sortWithinPartitions("contig", "position")
    spark = calls.sparkSession
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, "2")
    try:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vcf_id").parquet(table)
    finally:
        spark.conf.set(WRITERS, before)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The call table; a filter on vcf_id reads that run's files only."""
    return spark.read.schema(CALLS).parquet(table)


def write_csv(calls: DataFrame, columns: list[str], path: str, defaults: dict[str, str] | None = None) -> None:
    """Calls as CSV without a header line, null as ''; `defaults` fill empty columns."""
    out = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit((defaults or {}).get(c, ""))).alias(c) for c in columns]
    calls.select(*out).write.option("emptyValue", "").csv(path)
