"""Queries of this library on the shared tables, and the SQL that must give the same rows.

`calls` is a call table made of lineitem: two runs, two samples, natural contig names, text cells and alternates with nulls.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom import functions as V
from varloom.operators import annotate, calls as C, catalog as K
from varloom.plans import cql
from varloom.folders import shared_folder
from varloom.plans.query import Filter, Query, Range, Sort
from varloom.schema import ANNOTATIONS, STARRED
from varloom.sources import vcf, vcf_writer

RUN, TRUTH = 1, 2
TYPES = {"info:DP": "integer", "info:AF": "float", "position": "integer"}
COLUMNS = ["reference", "alternates", "contig", "position", "sample_name", "info:DP", "info:AF"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.expr("cast(case when l_linestatus = 'F' then 1 else 2 end as long)").alias("vcf_id"),
        F.expr("case when l_returnflag = 'A' then 'NORMAL' else 'TUMOR' end").alias("sample_name"),
        F.expr("case when l_suppkey % 25 < 22 then concat('chr', cast(l_suppkey % 25 + 1 as string)) when l_suppkey % 25 = 22 then 'chrX' when l_suppkey % 25 = 23 then 'chrY' else 'KI270728' end").alias("contig"),
        F.col("l_partkey").cast("int").alias("position"),
        F.expr("case when l_linenumber % 2 = 0 then 'A' else 'C' end").alias("reference"),
        F.expr("case when l_linenumber % 3 = 0 then null when l_linenumber % 2 = 0 then 'G' else 'T' end").alias("alternates"),
        F.expr("case when l_tax = 0.0 then null else cast(cast(l_quantity as int) as string) end").alias("info:DP"),
        F.col("l_discount").cast("string").alias("info:AF"),
        "l_orderkey", "l_partkey", "l_suppkey",
    )


_CALLS = """calls AS (SELECT CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS vcf_id,
  CASE WHEN l_returnflag = 'A' THEN 'NORMAL' ELSE 'TUMOR' END AS sample_name,
  CASE WHEN l_suppkey % 25 < 22 THEN concat('chr', CAST(l_suppkey % 25 + 1 AS VARCHAR)) WHEN l_suppkey % 25 = 22 THEN 'chrX' WHEN l_suppkey % 25 = 23 THEN 'chrY' ELSE 'KI270728' END AS contig,
  CAST(l_partkey AS INTEGER) AS position,
  CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'C' END AS reference, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'T' END AS alternates,
  CASE WHEN l_tax = 0.0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS "info:DP", CAST(l_discount AS VARCHAR) AS "info:AF",
  l_orderkey, l_partkey, l_suppkey FROM lineitem)"""

_ALL = 'vcf_id, sample_name, contig, position, reference, alternates, "info:DP", "info:AF", l_orderkey, l_partkey, l_suppkey'
_NUMBER = "CASE WHEN regexp_matches(contig, '^(chr)?[0-9]+') THEN CAST(regexp_extract(contig, '([0-9]+)', 1) AS INTEGER) ELSE 10000 END"
_NATURAL = f"{_NUMBER} ASC NULLS LAST, length(contig) ASC NULLS LAST, contig ASC NULLS LAST"
_TIES = "position ASC NULLS LAST, reference ASC NULLS LAST, alternates ASC NULLS LAST, sample_name ASC NULLS LAST"
_UNIQUE = "l_orderkey, l_partkey, l_suppkey"


def with_calls(sql: str) -> str:
    return f"WITH {_CALLS} {sql}"


def query(*filters: Filter, range: Range = Range(), sort: tuple[Sort, ...] = (), page: int = 0, limit: int | None = None, truth: int | None = None) -> Query:
    return Query(filters, range, sort, page, limit, truth, TYPES)


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    """The queries of this module."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# scans, filters, ranges

_add("scan_run", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1"))(lambda s, d: C.run_calls(calls(s, d), RUN))

_DP = 'TRY_CAST("info:DP" AS INTEGER)'
for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("le", "<=", "<="), ("ge", ">=", ">=")):
    _add(f"filter_{_name}", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 AND {_DP} {_sql} 25"))(
        lambda s, d, op=_op: C.filtered(calls(s, d), RUN, query(Filter("info:DP", op, "25")))
    )
for _name, _op, _sql in (
    ("isnull", Filter("info:DP", "NULL"), '"info:DP" IS NULL'),
    ("notnull", Filter("info:DP", "NOT NULL"), '"info:DP" IS NOT NULL'),
    ("like", Filter("contig", "LIKE", "chr1_"), "contig LIKE 'chr1_'"),
    ("rlike", Filter("contig", "RLIKE", "^CHR[xy]$|ki2"), "regexp_matches(contig, '(?i)^CHR[xy]$|ki2')"),
    ("float", Filter("info:AF", "<=", "0.05"), 'TRY_CAST("info:AF" AS DOUBLE) <= 0.05'),
    ("text", Filter("sample_name", "=", "TUMOR"), "sample_name = 'TUMOR'"),
):
    _add(f"filter_{_name}", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 AND {_sql}"))(lambda s, d, f=_op: C.filtered(calls(s, d), RUN, query(f)))

_add("range_contig", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 AND contig = 'chrX'"))(lambda s, d: C.filtered(calls(s, d), RUN, query(range=Range("chrX"))))
_add("range_half_open", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 AND contig = 'chr2' AND position >= 100 AND position < 1200"))(
    lambda s, d: C.filtered(calls(s, d), RUN, query(range=Range("chr2", 100, 1200)))
)
_add(
    "cql_compound",
    with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 AND contig = 'chr12' AND position >= 10 AND position < 15000 AND {_DP} <= 30 AND sample_name LIKE 'TUM%' AND \"info:AF\" IS NOT NULL"),
)(lambda s, d: C.query_calls(calls(s, d), RUN, cql.parse("info:DP <= 30 AND chr12:10-15,000 AND sample_name LIKE 'TUM%' AND info:AF IS NOT NULL ORDER BY info:DP DESC, contig", COLUMNS).typed(TYPES, COLUMNS)))

# orders and pages: the place in the order is part of the rows


def _add_order(name: str, order: str):
    """An order of the whole run, also under the name it had beside a shorter one."""

    def put(f):
        for n in (name, f"{name}_all"):
            _add(n, with_calls(f"SELECT {_ALL}, row_number() OVER (ORDER BY {order}) AS place FROM calls WHERE vcf_id = 1"))(f)
        return f

    return put


def _sorted(*sort: Sort):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query(sort=sort)
        return C.with_places(C.filtered(calls(spark, sf_dir), RUN, q).orderBy(*C.order_columns(q), *_UNIQUE.split(", ")))

    return run


_add_order("sort_typed", f"{_DP} ASC NULLS LAST, {_NATURAL}, {_TIES}, {_UNIQUE}")(_sorted(Sort("info:DP")))
_add_order("sort_typed_desc_nulls", f"{_DP} DESC NULLS FIRST, {_NATURAL}, {_TIES}, {_UNIQUE}")(_sorted(Sort("info:DP", True)))
_add_order("sort_contig_natural", f"{_NATURAL}, {_TIES}, {_UNIQUE}")(_sorted(Sort("contig")))
_add_order("sort_contig_natural_desc", f"{_NUMBER} ASC NULLS LAST, length(contig) DESC NULLS FIRST, contig DESC NULLS FIRST, {_NATURAL}, {_TIES}, {_UNIQUE}")(_sorted(Sort("contig", True)))


@_add("page_limit_offset", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 ORDER BY {_NATURAL}, {_TIES}, {_UNIQUE} LIMIT 250 OFFSET 500"))
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query(sort=(Sort("contig"),), page=2, limit=250)
    return C.page(C.filtered(calls(spark, sf_dir), RUN, q).orderBy(*C.order_columns(q), *_UNIQUE.split(", ")), q)


@_add_order("export_order", f"length(contig) NULLS LAST, contig NULLS LAST, {_TIES}, {_UNIQUE}")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_places(C.export_order(C.run_calls(calls(spark, sf_dir), RUN), *_UNIQUE.split(", ")))


# comparison with the truth run

SAME_SQL = " AND ".join(f"t.{c} IS NOT DISTINCT FROM r.{c}" for c in C.CALL_KEY)
_RALL = ", ".join(f"r.{c.strip()}" for c in _ALL.split(","))
_add("compare_left_tag", with_calls(f'SELECT {_RALL}, t.contig IS NOT NULL AS "tag:true-positive" FROM calls r LEFT JOIN (SELECT * FROM calls WHERE vcf_id = 2) t ON {SAME_SQL} WHERE r.vcf_id = 1'))(
    lambda s, d: C.compared(calls(s, d), RUN, query(truth=TRUTH))
)
_add("compare_true_positives", with_calls(f"SELECT {_RALL} FROM calls r JOIN calls t ON {SAME_SQL} WHERE r.vcf_id = 1 AND t.vcf_id = 2"))(
    lambda s, d: C.true_positives(calls(s, d), RUN, query(truth=TRUTH))
)


def _stats_sql(run: str, truth: str) -> str:
    return with_calls(f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1score FROM (
  SELECT *, CASE WHEN number_of_records > 0 THEN CAST(true_positives AS DOUBLE) / number_of_records ELSE 0.0 END AS precision,
    CASE WHEN total_truth_records > 0 THEN CAST(true_positives AS DOUBLE) / total_truth_records ELSE 0.0 END AS recall,
    number_of_records - true_positives AS false_positives, total_truth_records - true_positives AS false_negatives
  FROM (SELECT (SELECT count(*) FROM calls r WHERE vcf_id = 1 AND {run}) AS number_of_records, (SELECT count(*) FROM calls WHERE vcf_id = 1) AS total_unfiltered_count,
    (SELECT count(*) FROM calls r JOIN calls t ON {SAME_SQL} WHERE r.vcf_id = 1 AND t.vcf_id = 2 AND {run} AND {truth}) AS true_positives,
    (SELECT count(*) FROM calls t WHERE vcf_id = 2 AND {truth}) AS total_truth_records))""")


_add("stats_full", _stats_sql("true", "true"))(lambda s, d: C.statistics(calls(s, d), RUN, query(truth=TRUTH)))
_add("stats_filtered", _stats_sql("r.sample_name = 'TUMOR' AND TRY_CAST(r.\"info:DP\" AS INTEGER) > 10", "t.sample_name = 'TUMOR'"))(
    lambda s, d: C.statistics(calls(s, d), RUN, query(Filter("sample_name", "=", "TUMOR"), Filter("info:DP", ">", "10"), truth=TRUTH))
)
_add("stats_range", _stats_sql("r.contig = 'chr2' AND r.position < 1500", "t.contig = 'chr2' AND t.position < 1500"))(
    lambda s, d: C.statistics(calls(s, d), RUN, query(range=Range("chr2", 0, 1500), truth=TRUTH))
)
_add("stats_no_truth", with_calls("SELECT count(*) FILTER (WHERE sample_name = 'TUMOR') AS number_of_records, count(*) AS total_unfiltered_count FROM calls WHERE vcf_id = 1"))(
    lambda s, d: C.statistics(calls(s, d), RUN, query(Filter("sample_name", "=", "TUMOR")))
)
_add("record_closure_semi", with_calls(f"SELECT {_RALL} FROM calls r WHERE vcf_id = 1 AND EXISTS (SELECT 1 FROM calls k WHERE k.vcf_id = 1 AND TRY_CAST(k.\"info:DP\" AS INTEGER) > 45 AND k.contig = r.contig AND k.position = r.position AND k.reference = r.reference AND k.alternates IS NOT DISTINCT FROM r.alternates)"))(
    lambda s, d: C.record_closure(calls(s, d), RUN, query(Filter("info:DP", ">", "45")))
)

# what is known about runs

_add("contig_list", with_calls("SELECT DISTINCT contig FROM calls WHERE vcf_id = 1"))(lambda s, d: C.contigs(calls(s, d), RUN))
_add("sample_list", with_calls("SELECT DISTINCT sample_name FROM calls WHERE vcf_id = 1"))(lambda s, d: C.samples(calls(s, d), RUN))
_add("sample_count", with_calls("SELECT count(DISTINCT sample_name) AS n FROM calls WHERE vcf_id = 1"))(lambda s, d: C.sample_count(calls(s, d), RUN))
_add(
    "extant_columns",
    with_calls("""SELECT vcf_id, concat_ws(',', CASE WHEN count("info:DP") > 0 THEN 'info:DP' END, CASE WHEN count("info:AF") > 0 THEN 'info:AF' END, CASE WHEN count(none) > 0 THEN 'info:GQ' END) AS extant
  FROM (SELECT *, NULL AS none FROM calls) GROUP BY vcf_id"""),
)(lambda s, d: C.extant_columns(calls(s, d).withColumn("info:GQ", F.lit(None).cast("string")), ["info:DP", "info:AF", "info:GQ"]).select("vcf_id", F.array_join("extant_columns", ",").alias("extant")))
_add("genotype_count", with_calls("SELECT vcf_id, count(*) AS genotype_count FROM calls GROUP BY vcf_id"))(lambda s, d: C.call_counts(calls(s, d)))


# the small tables, on the shared ones: orders are runs, lineitem comments, customer projects, events tasks


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"))


def comments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("vcf_id"))


_add("comment_counts", "SELECT o_orderkey AS id, o_custkey AS project_id, coalesce(n, 0) AS num_comments FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")(
    lambda s, d: K.comment_counts(runs(s, d), comments(s, d))
)


@_add("attach_dims", "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _dims(s: SparkSession, d: str) -> DataFrame:
    # nation and region have a fixed number of rows
    nation, region = table(s, d, "nation"), table(s, d, "region")
    rows = table(s, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@_add("nest_children", "SELECT c_custkey, coalesce(k, '') AS run_ids, newest FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS k, max(o_orderkey) AS newest FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _nest(s: SparkSession, d: str) -> DataFrame:
    nested = runs(s, d).groupBy("project_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"), F.max("id").alias("newest"))
    rows = table(s, d, "customer").join(nested, F.col("c_custkey") == F.col("project_id"), "left")
    return rows.select("c_custkey", F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("run_ids"), "newest")


def tasks(s: SparkSession, d: str) -> DataFrame:
    states = F.when(F.col("event_type") == "purchase", "FAILURE").when(F.col("event_type") == "view", "SUCCESS").otherwise("STARTED")
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("vcf_id"), states.alias("state"), F.concat(F.lit("workers.genotype."), "event_type", F.lit(".run")).alias("type"))


STATE_SQL = "CASE event_type WHEN 'purchase' THEN 'FAILURE' WHEN 'view' THEN 'SUCCESS' ELSE 'STARTED' END"
_add("task_states_distinct", f"SELECT c_custkey AS id, coalesce(s, '') AS task_states FROM customer LEFT JOIN (SELECT user_id, string_agg(DISTINCT {STATE_SQL}, ',' ORDER BY {STATE_SQL}) AS s FROM events GROUP BY 1) ON user_id = c_custkey")(
    lambda s, d: K.with_task_states(table(s, d, "customer").select(F.col("c_custkey").alias("id")), tasks(s, d)).select("id", F.array_join("task_states", ",").alias("task_states"))
)
_add("tasks_unfinished", f"SELECT event_id AS id, user_id AS vcf_id, {STATE_SQL} AS state, concat('workers.genotype.', event_type, '.run') AS type FROM events WHERE {STATE_SQL} NOT IN ('SUCCESS', 'FAILURE')")(
    lambda s, d: K.unfinished(tasks(s, d))
)
_add("task_labels", "SELECT event_id AS id, concat('genotype.', event_type) AS label FROM events")(lambda s, d: tasks(s, d).select("id", V.task_label(F.col("type")).alias("label")))
_add("latest_n", "SELECT event_id AS id, ts AS created, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")(
    lambda s, d: K.latest(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created"), "user_id"))
)


@_add("star_overlay", "SELECT c_custkey, coalesce(starred, false) AS starred FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type = 'purchase', (ts, event_id)) AS starred FROM events GROUP BY 1) ON user_id = c_custkey")
def _stars(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events")
    now = events.groupBy("user_id").agg(F.max_by(F.col("event_type") == "purchase", F.struct("ts", "event_id")).alias("starred"))
    rows = table(s, d, "customer").join(now, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select("c_custkey", F.coalesce("starred", F.lit(False)).alias("starred"))


_GENES = "SELECT CASE WHEN p_partkey % 25 < 22 THEN concat('chr', CAST(p_partkey % 25 + 1 AS VARCHAR)) ELSE 'chrX' END AS contig, p_partkey AS s, p_partkey + p_size AS e, p_size AS pr, p_name AS g, p_brand AS t FROM part"


_FOUND = (
    f"SELECT contig, position, reference, alternates, b.g AS gene_name, b.t AS transcript FROM (SELECT contig, position, reference, alternates, min(struct_pack(p := -pr, g := g, t := t)) AS b FROM (SELECT DISTINCT contig, position, reference, alternates FROM calls WHERE vcf_id = 1) v JOIN ({_GENES}) m USING (contig) WHERE position BETWEEN s AND e GROUP BY ALL)"
)


def _annotate(s: SparkSession, d: str) -> DataFrame:
    contig = F.expr("case when p_partkey % 25 < 22 then concat('chr', cast(p_partkey % 25 + 1 as string)) else 'chrX' end")
    genes = table(s, d, "part").select(
        contig.alias("contig"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_size").alias("priority"),
        F.col("p_name").alias("annotations:gene_name"), F.col("p_brand").alias("annotations:transcript"), F.lit(None).cast("string").alias("annotations:effect_notation"), F.lit(None).cast("string").alias("annotations:effect_type"),
    )
    return annotate.annotations(C.run_calls(calls(s, d), RUN), genes, 1 << 8)


@_add("annotate_update", with_calls(_FOUND))
def _annotations(s: SparkSession, d: str) -> DataFrame:
    return _annotate(s, d).select(*C.RECORD_KEY, V.cell("annotations:gene_name").alias("gene_name"), V.cell("annotations:transcript").alias("transcript"))


_KEY_IS = " AND ".join(f"r.{c} IS NOT DISTINCT FROM f.{c}" for c in C.RECORD_KEY)


@_add("annotate_calls", with_calls(f"SELECT l_orderkey, l_partkey, l_suppkey, f.gene_name, f.transcript FROM calls r LEFT JOIN ({_FOUND}) f ON {_KEY_IS} WHERE r.vcf_id = 1"))
def _annotated(s: SparkSession, d: str) -> DataFrame:
    none = C.run_calls(calls(s, d), RUN).withColumns({c: F.lit(None).cast("string") for c in ANNOTATIONS})
    return annotate.annotated(none, _annotate(s, d)).select(*_UNIQUE.split(", "), V.cell("annotations:gene_name").alias("gene_name"), V.cell("annotations:transcript").alias("transcript"))


# scalar functions

_add("epoch_ts", "SELECT event_id, epoch_us(ts) / 1e6 AS seconds FROM events")(lambda s, d: table(s, d, "events").select("event_id", V.epoch_seconds(F.col("ts")).alias("seconds")))
_add("effect_type_humanize", "SELECT p_partkey, regexp_replace(concat('Frame', 'Shift', replace(p_name, ' ', '')), '([a-z])([A-Z])', '\\1 \\2', 'g') AS effect FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", V.effect_words(F.concat(F.lit("FrameShift"), F.replace("p_name", F.lit(" "), F.lit("")))).alias("effect"))
)
_add("row_key", with_calls(f"SELECT {_UNIQUE}, concat(contig, ':', position, '::', reference, '->', alternates) AS row_key FROM calls"))(lambda s, d: calls(s, d).select(*_UNIQUE.split(", "), V.row_key().alias("row_key")))
_add("vcf_format_cells", with_calls(f"SELECT {_UNIQUE}, coalesce(\"info:DP\", '.') AS dp, concat(coalesce(\"info:DP\", '.'), ',', \"info:AF\") AS both FROM calls"))(
    lambda s, d: calls(s, d).select(*_UNIQUE.split(", "), V.vcf_cell(V.cell("info:DP")).alias("dp"), V.vcf_cell(F.concat(F.lit("["), F.coalesce(V.cell("info:DP"), F.lit(".")), F.lit(", "), V.cell("info:AF"), F.lit("]"))).alias("both"))
)
_add("comment_links", with_calls(f"SELECT {_UNIQUE}, concat(contig, ':', position, '-', position + 1) AS link, position - 25 AS low, position + 25 AS high FROM calls WHERE vcf_id = 1"))(
    lambda s, d: C.run_calls(calls(s, d), RUN).select(*_UNIQUE.split(", "), V.comment_link(F.col("contig"), F.col("position")).alias("link"), V.pileup_window(F.col("position")).start.alias("low"), V.pileup_window(F.col("position")).end.alias("high"))
)
_add("reads_overlap", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey < 600 AND l_partkey + l_quantity > 500 AND l_linestatus = 'F'")(
    lambda s, d: C.overlapping(table(s, d, "lineitem").withColumns({"contig": F.col("l_linestatus"), "start": F.col("l_partkey"), "end": F.col("l_partkey") + F.col("l_quantity")}), "F", 500, 600).select("l_orderkey", "l_linenumber", "l_partkey")
)

_add("ascii_text", "SELECT p_partkey, regexp_replace(concat(p_name, 'é', p_type), '[^\x00-\x7F]', '', 'g') AS t FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", V.ascii_only(F.concat("p_name", F.lit("é"), "p_type")).alias("t")))
_add("comment_preview", "SELECT p_partkey, substr(repeat(p_name, 6), 1, 45) AS t FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", V.preview(F.repeat("p_name", F.lit(6))).alias("t")))
_add("number_texts", "SELECT o_orderkey, format('{:,}', o_custkey * 1000) AS n, format('{:.4f}', o_custkey / 7.0::DOUBLE) AS r FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", V.count_text(F.col("o_custkey") * 1000).alias("n"), V.ratio_text(F.col("o_custkey") / F.lit(7.0)).alias("r"))
)
_add("path_in_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", V.at_path(F.col("props"), "k").alias("k"), V.at_path(F.col("props"), "no", "such").alias("none"))
)
_add("camel_case_keys", "SELECT s_suppkey AS \"sSuppkey\", s_name AS \"sName\" FROM supplier")(lambda s, d: V.rename_keys(table(s, d, "supplier").select("s_suppkey", "s_name")))
_add("igv_links", with_calls(f"SELECT {_UNIQUE}, concat('http://v/load?g=1&file=http://x/', sample_name, '.vcf&name=Run&format=vcf&locus=', contig, ':', position) AS link FROM calls WHERE vcf_id = 1"))(
    lambda s, d: C.run_calls(calls(s, d), RUN).select(*_UNIQUE.split(", "), V.igv_link("http://v/load?g=1", [(F.concat(F.lit("http://x/"), "sample_name", F.lit(".vcf")), "Run", "vcf"), (F.lit("file:///b.bam"), "Normal", "bam")], F.concat("contig", F.lit(":"), F.col("position").cast("string"))).alias("link"))
)

# the small tables through the library: customer are projects and users, orders runs, supplier BAMs, lineitem comments and stars


def projects(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def bams(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 3).alias("project_id"))


def full_runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_custkey").alias("tumor_bam_id"), (F.col("o_custkey") * 2).alias("normal_bam_id"))


_SEQ = "(l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey"


def _remarks(s: SparkSession, d: str) -> DataFrame:
    """Comments and stars on calls."""
    more = table(s, d, "lineitem").select(*_UNIQUE.split(", "), F.col("l_shipdate").cast("timestamp").alias("at"), F.expr(_SEQ).alias("seq"), F.expr("l_quantity > 25").alias("starred"), "l_linenumber")
    rows = calls(s, d).join(more, _UNIQUE.split(", "))
    return rows.withColumns({"id": F.col("seq"), "created": F.col("at"), "comment_text": F.concat("reference", F.col("l_suppkey").cast("string")), "user_id": F.col("l_suppkey")})


_REMARKS = f"""remarks AS (SELECT c.*, m.moment, m.seq, m.starred, m.l_linenumber, concat(reference, c.l_suppkey) AS comment_text FROM calls c
  JOIN (SELECT {_UNIQUE}, l_shipdate AS moment, {_SEQ} AS seq, l_quantity > 25 AS starred, l_linenumber FROM lineitem) m USING ({_UNIQUE}))"""


def _with_remarks(sql: str) -> str:
    return f"WITH {_CALLS}, {_REMARKS} {sql}"


_CALL_IS = " AND ".join(f"r.{c} IS NOT DISTINCT FROM f.{c}" for c in ("vcf_id", *C.CALL_KEY))
_CALL = ", ".join(("vcf_id", *C.CALL_KEY))
_add("star_calls", _with_remarks(f'SELECT {_RALL}, coalesce(f.s, false) AS "{STARRED}" FROM calls r LEFT JOIN (SELECT {_CALL}, arg_max(starred, (moment, seq)) AS s FROM remarks WHERE l_linenumber <= 3 GROUP BY ALL) f ON {_CALL_IS}'))(
    lambda s, d: K.starred(calls(s, d), _remarks(s, d).where("l_linenumber <= 3"))
)
_add("comments_by_row", _with_remarks("SELECT concat(contig, ':', position, '::', reference, '->', alternates) AS row_key, string_agg(comment_text, ',' ORDER BY moment, seq) AS texts FROM remarks WHERE vcf_id = 1 GROUP BY 1"))(
    lambda s, d: K.comments_by_row(_remarks(s, d), RUN).select("row_key", F.array_join(F.transform("comments", lambda c: c["comment_text"]), ",").alias("texts"))
)
_add("calls_with_comments", _with_remarks(f"SELECT {', '.join('r.' + c for c in _UNIQUE.split(', '))}, f.t AS texts FROM calls r LEFT JOIN (SELECT {_CALL}, string_agg(comment_text, ',' ORDER BY moment, seq) AS t FROM remarks WHERE l_linenumber = 1 GROUP BY ALL) f ON {_CALL_IS}"))(
    lambda s, d: K.calls_with_comments(calls(s, d), _remarks(s, d).where("l_linenumber = 1")).select(*_UNIQUE.split(", "), F.array_join(F.transform("comments", lambda c: c["comment_text"]), ",").alias("texts"))
)
_add("comments_with_users", "SELECT event_id AS id, c_name AS username, epoch_us(ts) / 1e6 AS created FROM events LEFT JOIN customer ON c_custkey = user_id")(
    lambda s, d: K.with_users(table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created"), F.col("ts").alias("last_modified")), projects(s, d).withColumnRenamed("name", "username")).select("id", "user.username", "created")
)
_add("attach_bams", "SELECT o_orderkey AS id, t.s_name AS tumor, n.s_name AS normal FROM orders LEFT JOIN supplier t ON t.s_suppkey = o_custkey LEFT JOIN supplier n ON n.s_suppkey = o_custkey * 2")(
    lambda s, d: K.with_bams(full_runs(s, d), bams(s, d)).select("id", F.col("tumor_bam.name").alias("tumor"), F.col("normal_bam.name").alias("normal"))
)
_add("attach_projects", "SELECT o_orderkey AS id, c_name AS project FROM orders LEFT JOIN customer ON c_custkey = o_custkey")(
    lambda s, d: K.with_projects(full_runs(s, d), projects(s, d)).select("id", F.col("project.name").alias("project"))
)
_add("project_tree", f"""WITH r AS (SELECT o_custkey AS p, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS run_ids, max(o_orderkey) AS newest,
    CAST(sum(coalesce(n, 0)) AS BIGINT) AS num_comments, string_agg(coalesce(s, ''), ';' ORDER BY o_orderkey DESC) AS states
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT user_id, string_agg(DISTINCT {STATE_SQL}, ',' ORDER BY {STATE_SQL}) AS s FROM events GROUP BY 1) ON user_id = o_orderkey GROUP BY 1)
SELECT c_custkey AS id, run_ids, newest, num_comments, states, (SELECT CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey * 3 = c_custkey) AS num_bams FROM customer LEFT JOIN r ON p = c_custkey""")(
    lambda s, d: K.project_tree(projects(s, d), full_runs(s, d), bams(s, d), comments(s, d), tasks(s, d)).select(
        "id",
        F.array_join(F.transform("vcfs", lambda v: v["id"].cast("string")), ",").alias("run_ids"),
        "newest",
        F.aggregate(F.transform("vcfs", lambda v: v["num_comments"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("num_comments"),
        F.array_join(F.transform("vcfs", lambda v: F.array_join(v["task_states"], ",")), ";").alias("states"),
        F.when(F.col("bams").isNull(), 0).otherwise(F.size("bams")).cast("long").alias("num_bams"),
    )
)
_add("related_runs", "SELECT o_orderkey AS id, o_custkey AS project_id FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) AND o_orderkey <> 7")(lambda s, d: K.related_runs(runs(s, d), 7))
_add("runs_of_project", "SELECT o_orderkey AS id, o_custkey AS project_id FROM orders WHERE o_custkey = 7")(lambda s, d: K.newest_first(K.matching(runs(s, d), project_id=7)))
_add("project_by_id", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")(lambda s, d: K.by_id(projects(s, d), 7))
_add("projects_view", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS notes FROM customer")(lambda s, d: K.view(projects(s, d).withColumn("inside", F.lit(1)), "projects"))
_add("tasks_visible", f"SELECT event_id AS id, user_id AS vcf_id, {STATE_SQL} AS state, concat('workers.genotype.', event_type, '.run') AS type FROM events WHERE user_id = 7 AND {STATE_SQL} <> 'SUCCESS'")(lambda s, d: K.visible_tasks(tasks(s, d), 7))
_add("task_states_of_run", f"SELECT concat('genotype.', event_type) AS label, arg_max({STATE_SQL}, event_id) AS state FROM events WHERE user_id = 7 GROUP BY event_type")(lambda s, d: K.task_states(tasks(s, d), 7))
_add("tasks_of_other_runs", f"SELECT event_id AS id, {STATE_SQL} AS state FROM events WHERE user_id IS DISTINCT FROM 7")(lambda s, d: K.without_tasks(tasks(s, d), 7).select("id", "state"))
_add("tasks_refreshed", f"SELECT event_id AS id, CASE WHEN {STATE_SQL} = 'STARTED' AND event_id % 3 = 0 THEN 'SUCCESS' ELSE {STATE_SQL} END AS state FROM events")(
    lambda s, d: K.refreshed(tasks(s, d).withColumn("task_id", F.col("id")), table(s, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("task_id"), F.lit("SUCCESS").alias("state"))).select("id", "state")
)
_STEP = "CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'annotate' END"
_add("runs_to_restart", f"""SELECT user_id AS vcf_id, CASE WHEN bool_or(step = 'extract') THEN 'extract,annotate' ELSE 'annotate' END AS steps
  FROM (SELECT user_id, {_STEP} AS step, arg_max({STATE_SQL}, event_id) AS state FROM events GROUP BY ALL) WHERE state = 'FAILURE' GROUP BY 1""")(
    lambda s, d: K.to_restart(tasks(s, d).withColumn("type", F.expr("concat('workers.', case when id % 2 = 0 then 'extract' else 'annotate' end, '.run')"))).select("vcf_id", F.array_join("steps", ",").alias("steps"))
)


@_add("default_page", with_calls(f"SELECT {_ALL} FROM calls WHERE vcf_id = 1 ORDER BY {_NATURAL}, {_TIES}, {_UNIQUE} LIMIT 250"))
def _default(s: SparkSession, d: str) -> DataFrame:
    q = Query.from_json(query().with_defaults().to_json())
    return C.page(C.filtered(calls(s, d), RUN, q).orderBy(*C.order_columns(q), *_UNIQUE.split(", ")), q)


# VCF text of orders, read and written: a record for each order, with repeated INFO keys, lists, flags and short cells

HEADER = [
    "##fileformat=VCFv4.1",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=SOMATIC,Number=0,Type=Flag,Description="Somatic">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##FORMAT=<ID=DP4,Number=4,Type=Integer,Description="Strands">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNORMAL\tTUMOR",
]
EXTANT = ["info:DP", "info:SOMATIC", "sample:GT", "sample:DP", "sample:DP4"]
VCF_RUN = 7
#: Parts of a record, in SQL of both engines.
_PARTS = {
    "contig": "concat('chr', CAST(o_custkey % 22 + 1 AS {s}))",
    "pos": "CAST(o_orderkey AS {s})",
    "id": "CASE WHEN o_custkey % 3 = 0 THEN concat('rs', CAST(o_orderkey AS {s})) ELSE '.' END",
    "ref": "CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'C' END",
    "alt": "CASE WHEN o_orderkey % 5 = 0 THEN 'G,T' WHEN o_orderkey % 7 = 0 THEN '.' ELSE 'G' END",
    "qual": "CASE WHEN o_custkey % 4 = 0 THEN '.' ELSE CAST(o_custkey % 90 AS {s}) END",
    "filter": "CASE o_orderstatus WHEN 'F' THEN 'q10;s50' WHEN 'O' THEN 'PASS' ELSE '.' END",
    "first_dp": "CAST(o_custkey % 50 AS {s})",
    "dp": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 60 AS {s}) ELSE CAST(o_custkey % 50 AS {s}) END",
    "normal_dp": "CAST(o_custkey % 40 AS {s})",
    "normal_dp4": "concat('1,', CAST(o_custkey % 9 AS {s}), ',3,4')",
    "tumor_dp4": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('5,6,7,', CAST(o_orderkey % 9 AS {s})) END",
}
VCF_SQL = "p AS (SELECT o_orderkey, " + ", ".join(f'{x.format(s="VARCHAR")} AS "{n}"' for n, x in _PARTS.items()) + " FROM orders)"


def vcf_lines(s: SparkSession, d: str) -> DataFrame:
    """The records' lines: (part, at, value), in the order of orders."""
    p = table(s, d, "orders").select("o_orderkey", *[F.expr(x.format(s="string")).alias(n) for n, x in _PARTS.items()])
    info = F.concat(F.lit("DP="), "first_dp", F.when(F.col("o_orderkey") % 3 == 0, ";SOMATIC").otherwise(""), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(";DP="), "dp")).otherwise(""), F.lit(";ZZ=x"))
    line = F.concat_ws("\t", "contig", "pos", "id", "ref", "alt", "qual", "filter", info, F.lit("GT:DP:DP4"), F.concat(F.lit("0/0:"), "normal_dp", F.lit(":"), "normal_dp4"), F.coalesce(F.concat(F.lit("0/1:.:"), "tumor_dp4"), F.lit("0/1")))
    return p.select(F.lit(1).alias("part"), F.col("o_orderkey").cast("long").alias("at"), line.alias("value"))


def vcf_text(s: SparkSession, d: str) -> str:
    """Writes the records as text files into a shared folder, without the header."""
    path = shared_folder(s, "catalog-vcf")
    vcf_lines(s, d).select("value").write.text(path)
    return path


_NONE = "CAST(NULL AS VARCHAR)"
_dot = lambda c: f"nullif({c}, '.')"


@_add("vcf_read", f"""WITH {VCF_SQL} SELECT contig, CAST(pos AS INTEGER) AS position, {_dot('id')} AS id, ref AS reference, {_dot('alt')} AS alternates, {_dot('qual')} AS quality,
  CASE WHEN filter = 'q10;s50' THEN 'q10,s50' END AS filters, sample_name, dp AS "info:DP", CASE WHEN o_orderkey % 3 = 0 THEN 'True' END AS "info:SOMATIC",
  CASE sample_name WHEN 'NORMAL' THEN '0/0' ELSE '0/1' END AS "sample:GT", CASE sample_name WHEN 'NORMAL' THEN normal_dp END AS "sample:DP",
  concat('[', replace(CASE sample_name WHEN 'NORMAL' THEN normal_dp4 ELSE tumor_dp4 END, ',', ', ')) || ']' AS "sample:DP4"
FROM p, (VALUES ('NORMAL'), ('TUMOR')) v(sample_name)""".replace("concat('[', replace(CASE", "'[' || replace(CASE").replace("END, ',', ', ')) || ']'", "END, ',', ', ') || ']'"))
def _read(s: SparkSession, d: str) -> DataFrame:
    rows = vcf.read_vcf(s, vcf_text(s, d), VCF_RUN, HEADER)
    return rows.select("contig", "position", "id", "reference", "alternates", "quality", "filters", "sample_name", *[V.cell(c) for c in EXTANT])


@_add("vcf_ingest", f"SELECT {VCF_RUN} AS vcf_id, '{','.join(EXTANT)}' AS extant, 75 AS vcf_release, CAST(2 * count(*) AS BIGINT) AS genotype_count FROM orders")
def _ingest(s: SparkSession, d: str) -> DataFrame:
    found = vcf.ingest(s, vcf_text(s, d), VCF_RUN, shared_folder(s, "catalog-calls"), HEADER)
    return s.createDataFrame([(VCF_RUN, ",".join(found["extant_columns"]), found["vcf_release"], found["genotype_count"])], "vcf_id int, extant string, vcf_release int, genotype_count long")


LINES_SQL = f"""SELECT concat_ws(chr(9), contig, pos, id, ref, alt, qual, CASE filter WHEN '.' THEN 'PASS' ELSE filter END,
  concat('DP=', dp, CASE WHEN o_orderkey % 3 = 0 THEN ';SOMATIC' ELSE '' END), 'GT:DP:DP4', concat('0/0:', normal_dp, ':', normal_dp4), concat('0/1:.:', coalesce(tumor_dp4, '.'))) AS value FROM p"""
_TOP = "SELECT unnest([" + ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in HEADER) + "]) AS value"


@_add("vcf_export", f"WITH {VCF_SQL} {_TOP} UNION ALL {LINES_SQL}")
def _export_all(s: SparkSession, d: str) -> DataFrame:
    return vcf_writer.export_lines(vcf.read_vcf(s, vcf_text(s, d), VCF_RUN, HEADER), HEADER, EXTANT)


@_add("vcf_export_closure", f"WITH {VCF_SQL} {_TOP} UNION ALL {LINES_SQL} WHERE CAST(normal_dp AS INTEGER) > 35 AND contig = 'chr3'")
def _export_some(s: SparkSession, d: str) -> DataFrame:
    """All samples of the records of which one call matches, from an ingested table."""
    folder = shared_folder(s, "catalog-calls")
    vcf.ingest(s, vcf_text(s, d), VCF_RUN, folder, HEADER)
    q = Query((Filter("sample:DP", ">", "35"),), Range("chr3"), types={"sample:DP": "integer"})
    return vcf_writer.export_lines(C.record_closure(vcf.read_table(s, folder), VCF_RUN, q), HEADER, EXTANT)
