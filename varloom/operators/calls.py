"""Operators on the call table: filters, ranges, orders, pages, comparison with a truth run, statistics, closure."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.folders import shared_folder
from varloom.functions import cell, contig_order, literal, ratio, typed
from varloom.plans.query import Filter, Query, Range
from varloom.schema import CALL_ID, CALL_KEY, NULLABLE, RECORD_KEY

TRUE_POSITIVE = "tag:true-positive"

_COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def condition(f: Filter, kind: str = "string") -> Column:
    """One filter.  Comparisons are of the column's query type; null tests and patterns look at the text cell."""
    if f.op in _COMPARISONS:
        return _COMPARISONS[f.op](typed(f.column, kind), literal(f.value, kind))
    text = cell(f.column)
    if f.op == "NULL":
        return text.isNull()
    if f.op == "NOT NULL":
        return text.isNotNull()
    if f.op == "LIKE":
        return text.cast("string").like(str(f.value))
    if f.op == "RLIKE":
        return text.cast("string").rlike(f"(?i){f.value}")
    raise ValueError(f"unknown filter {f.op!r}")


def where_all(df: DataFrame, filters: tuple[Filter, ...], types: dict) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [condition(f, types.get(f.column, "integer" if f.column == "position" else "string")) for f in filters])) if filters else df


def in_range(df: DataFrame, r: Range) -> DataFrame:
    """Calls on a contig, from start up to but without end; bounds that are missing or 0 are open."""
    if r.contig is not None:
        df = df.where(F.col("contig") == r.contig)
    if r.start:
        df = df.where(F.col("position") >= r.start)
    if r.end:
        df = df.where(F.col("position") < r.end)
    return df


def run_calls(calls: DataFrame, run: int) -> DataFrame:
    """The calls of one run; the table is partitioned by it."""
    return calls.where(F.col("vcf_id") == run)


def order_columns(query: Query, natural_desc: bool = False) -> list[Column]:
    """The query's sort columns, then contig, position and the rest of the call's key, so that pages are stable."""
    out = []
    for s in query.sort:
        if s.column == "contig":
            out += contig_order("contig", s.descending, natural_desc)
        else:
            c = typed(s.column, query.type_of(s.column))
            out.append(c.desc_nulls_first() if s.descending else c.asc_nulls_last())
    out += contig_order("contig")
    return out + [F.col(c).asc_nulls_last() for c in ("position", "reference", "alternates", "sample_name")]


def page(df: DataFrame, query: Query) -> DataFrame:
    return df.offset(query.limit * query.page).limit(query.limit) if query.limit else df


def filtered(calls: DataFrame, run: int, query: Query) -> DataFrame:
    return where_all(in_range(run_calls(calls, run), query.range), query.filters, query.types)


def truth_calls(calls: DataFrame, query: Query) -> DataFrame:
    """The truth run's calls: the range and the filters on reference, alternates and sample hold for it too."""
    return where_all(in_range(run_calls(calls, query.truth), query.range), query.truth_filters(), query.types)


def same(left: DataFrame, right: DataFrame, names: tuple[str, ...], prefix: str = "") -> Column:
    """Whether rows have one key; `right` has its columns under the prefix.  A missing reference or alternate equals itself."""
    equal = lambda c: left[c].eqNullSafe(right[prefix + c]) if c in NULLABLE else left[c] == right[prefix + c]
    return reduce(lambda a, b: a & b, [equal(c) for c in names])


def call_key(calls: DataFrame) -> tuple[str, ...]:
    """What tells calls apart: one text where the table has it, which spares a bucketed table the exchange, else their parts."""
    return (CALL_ID,) if CALL_ID in calls.columns else CALL_KEY


def compared(calls: DataFrame, run: int, query: Query) -> DataFrame:
    """The run's calls with the tag whether the truth run has the same call; repeated truth calls repeat rows."""
    key = call_key(calls)
    left = filtered(calls, run, query)
    right = run_calls(calls, query.truth).select(*[F.col(c).alias(f"t_{c}") for c in key])
    rows = left.join(right, same(left, right, key, "t_"), "left")
    return rows.withColumn(TRUE_POSITIVE, F.col(f"t_{key[0]}").isNotNull()).drop(*right.columns)


def query_calls(calls: DataFrame, run: int, query: Query, natural_desc: bool = False) -> DataFrame:
    """Filtered, compared where a truth run is given, ordered, one page."""
    rows = compared(calls, run, query) if query.truth is not None else filtered(calls, run, query)
    return page(rows.orderBy(*order_columns(query, natural_desc)), query)


def true_positives(calls: DataFrame, run: int, query: Query) -> DataFrame:
    """The run's calls that the truth run has too, once for each time that it has them."""
    key = call_key(calls)
    left = filtered(calls, run, query)
    right = truth_calls(calls, query).select(*[F.col(c).alias(f"t_{c}") for c in key])
    return left.join(right, same(left, right, key, "t_")).drop(*right.columns)


def statistics(calls: DataFrame, run: int, query: Query) -> DataFrame:
    """One row: number of records that pass and in all; with a truth run also TP, FP, FN, precision, recall and F1."""
    kept = lambda filters: reduce(lambda a, b: a & b, [F.lit(True), *[condition(f, query.type_of(f.column)) for f in filters], *_range_conditions(query.range)])
    own = F.col("vcf_id") == run
    if query.truth is None:
        return run_calls(calls, run).agg(F.count_if(kept(query.filters)).alias("number_of_records"), F.count("*").alias("total_unfiltered_count"))
    # the run and the truth run are counted in one pass
    truth = F.col("vcf_id") == query.truth
    counts = calls.where(own | truth).agg(
        F.count_if(own & kept(query.filters)).alias("number_of_records"),
        F.count_if(own).alias("total_unfiltered_count"),
        F.count_if(truth & kept(query.truth_filters())).alias("total_truth_records"),
    )
    found = true_positives(calls, run, query).agg(F.count("*").alias("true_positives"))
    # two single rows, joined by a constant
    one = lambda df: df.withColumn("_one", F.lit(1))
    return scores(one(counts).join(F.broadcast(one(found)), "_one").drop("_one"))


def _range_conditions(r: Range) -> list[Column]:
    out = [F.col("contig") == r.contig] if r.contig is not None else []
    out += [F.col("position") >= r.start] if r.start else []
    return out + ([F.col("position") < r.end] if r.end else [])


def scores(row: DataFrame) -> DataFrame:
    """FP, FN, precision, recall and F1 from counts; a ratio with nothing below the line is 0."""
    tp = F.col("true_positives")
    row = row.withColumns({"false_positives": F.col("number_of_records") - tp, "false_negatives": F.col("total_truth_records") - tp})
    row = row.withColumns({"precision": ratio(tp, tp + F.col("false_positives")), "recall": ratio(tp, tp + F.col("false_negatives"))})
    return row.withColumn("f1score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def record_closure(calls: DataFrame, run: int, query: Query) -> DataFrame:
    """All samples' calls of every record of which one call matches; null parts of the key are equal."""
    keys = filtered(calls, run, query).select(*[F.col(c).alias(f"k_{c}") for c in RECORD_KEY]).distinct()
    rows = run_calls(calls, run)
    return rows.join(keys, same(rows, keys, RECORD_KEY, "k_"), "left_semi")


def export_order(df: DataFrame, *ties: str) -> DataFrame:
    """Length of the contig, contig, position, reference, alternates, sample; then the columns that settle ties."""
    return df.orderBy(F.length("contig").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in CALL_KEY], *ties)


def with_places(ordered: DataFrame) -> DataFrame:
    """All rows of an ordered frame with their places, from 1: the row's number in its range of the order, after the
    rows of the ranges before.  The driver gets one count for each range.

    The ordered rows are written to a shared folder, so that counts and rows are of the same ranges whatever becomes of an
    executor; the folder goes when the session ends.
    """
    spark, path = ordered.sparkSession, shared_folder(ordered.sparkSession, "places")
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    numbered.write.parquet(path)
    kept = spark.read.schema(numbered.schema).parquet(path)
    offsets, before = [], 0
    for r in sorted(kept.groupBy("_range").count().collect()):
        offsets.append((r["_range"], before))
        before += r["count"]
    first = spark.createDataFrame(offsets, "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(first), "_range").withColumn("place", place).drop("_range", "_at", "_before")


def contigs(calls: DataFrame, run: int) -> DataFrame:
    return run_calls(calls, run).select("contig").distinct().orderBy(F.length("contig").asc_nulls_last(), F.col("contig").asc_nulls_last())


def samples(calls: DataFrame, run: int) -> DataFrame:
    return run_calls(calls, run).select("sample_name").distinct().orderBy(F.col("sample_name").asc_nulls_last())


def sample_count(calls: DataFrame, run: int) -> DataFrame:
    return run_calls(calls, run).agg(F.countDistinct("sample_name").alias("n"))


def extant_columns(calls: DataFrame, candidates: list[str]) -> DataFrame:
    """(vcf_id, extant_columns, genotype_count): per run, the candidates that are not null somewhere, and its number of
    calls; one aggregate, no shuffle of cells."""
    flags = calls.groupBy("vcf_id").agg(*[F.bool_or(cell(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(candidates)], F.count("*").alias("genotype_count"))
    names = F.array_compact(F.array(*[F.when(F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(candidates)]))
    return flags.select("vcf_id", names.alias("extant_columns"), "genotype_count")


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("vcf_id").agg(F.count("*").alias("genotype_count"))


def overlapping(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads (contig, start, end) that overlap the half-open interval."""
    return reads.where((F.col("contig") == contig) & (F.col("start") < end) & (F.col("end") > start))
