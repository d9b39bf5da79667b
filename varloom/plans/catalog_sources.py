"""Queries of the sources, the file writer, the bucketed table and predicted effects on the shared tables, with their SQL."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.folders import shared_folder
from varloom.functions import cell, json_rows
from varloom.operators import calls as C, catalog as K, effects, search
from varloom.plans import catalog as P
from varloom.schema import CALL_KEY, RECORD_KEY
from varloom.sources import bam, call_table, header, transcripts as transcript_files, vcf, vcf_format, vcf_writer

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(f):
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# reads in block-compressed files with an index


@_add("reads_file_search", P.oracle_sql()["reads_overlap"])
def _reads(s: SparkSession, d: str) -> DataFrame:
    """Line items as reads, written, indexed, and searched by interval."""
    rows = P.table(s, d, "lineitem").select(
        F.col("l_linestatus").alias("contig"), F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("int").alias("end"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"),
    )
    folder = shared_folder(s, "catalog-reads")
    bam.write_reads(rows, folder)
    found = C.overlapping(bam.read_reads(s, folder), "F", 500, 600)
    part = lambda i: F.split("name", "\\.")[i].cast("long")
    return found.select(part(0).alias("l_orderkey"), part(1).alias("l_linenumber"), F.col("start").cast("long").alias("l_partkey"))


# VCF files with their own header


def _vcf_file(s: SparkSession, d: str) -> str:
    """One file of the records of all orders, with its header."""
    top = s.createDataFrame([(0, i, h) for i, h in enumerate(P.HEADER)], "part int, at long, value string")
    path = shared_folder(s, "catalog-file") + ".vcf"
    vcf_writer.write_one(top.unionByName(P.vcf_lines(s, d)).orderBy("part", "at"), path)
    return path


@_add("vcf_source", f"SELECT * FROM ({P.oracle_sql()['vcf_read']}) WHERE contig IN ('chr3', 'chr11') AND position >= 100 AND position < 40000 AND sample_name = 'TUMOR'")
def _source(s: SparkSession, d: str) -> DataFrame:
    """Only what filters on contig and position let through leaves the source, which reads the header from the file."""
    vcf_format.register(s)
    rows = s.read.format("vcf").option("vcf_id", P.VCF_RUN).load(_vcf_file(s, d))
    rows = rows.where("contig in ('chr3', 'chr11') and position >= 100 and position < 40000 and sample_name = 'TUMOR'")
    return rows.select("contig", "position", "id", "reference", "alternates", "quality", "filters", "sample_name", *[cell(c) for c in P.EXTANT])


@_add("vcf_read_file", P.oracle_sql()["vcf_read"])
def _read(s: SparkSession, d: str) -> DataFrame:
    """The native reader with the header that it finds in the file."""
    rows = vcf.read_vcf(s, _vcf_file(s, d), P.VCF_RUN)
    return rows.select("contig", "position", "id", "reference", "alternates", "quality", "filters", "sample_name", *[cell(c) for c in P.EXTANT])


_TOP = ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in P.HEADER)


@_add("vcf_export_file", f"""WITH {P.VCF_SQL}, lines AS ({P.LINES_SQL.replace('SELECT concat_ws', 'SELECT contig, pos, ref, alt, concat_ws')})
SELECT unnest(range(1, {len(P.HEADER) + 1})) AS line, unnest([{_TOP}]) AS value
UNION ALL SELECT {len(P.HEADER)} + row_number() OVER (ORDER BY length(contig), contig, CAST(pos AS INTEGER), ref, nullif(alt, '.') NULLS LAST) AS line, value FROM lines""")
def _export(s: SparkSession, d: str) -> DataFrame:
    """The run written as one file, and its lines by number."""
    path = shared_folder(s, "catalog-export") + ".vcf"
    vcf_writer.export_file(vcf.read_vcf(s, P.vcf_text(s, d), P.VCF_RUN, P.HEADER), P.HEADER, P.EXTANT, path)
    lines = s.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return C.with_places(lines.orderBy("block", "nth")).select(F.col("place").alias("line"), "value")


# comparison of runs that lie in buckets

_CELLS = ["info:DP", "info:AF"]
_SOME = ", ".join(f'r."{c}"' for c in ("vcf_id", *CALL_KEY, *_CELLS))


def bucketed(s: SparkSession, d: str, least: int = 8) -> DataFrame:
    """The shared call table in buckets, the more the larger it is."""
    name, rows = f"calls_{uuid.uuid4().hex}", P.calls(s, d)
    call_table.create(s, name, _CELLS, call_table.buckets_for(rows.count(), least), shared_folder(s, "catalog-buckets"))
    call_table.write(rows, name)
    return s.table(name)


@_add("compare_bucketed_tag", P.with_calls(f'SELECT {_SOME}, t.contig IS NOT NULL AS "tag:true-positive" FROM calls r LEFT JOIN (SELECT * FROM calls WHERE vcf_id = 2) t ON {P.SAME_SQL} WHERE r.vcf_id = 1'))
def _tagged(s: SparkSession, d: str) -> DataFrame:
    return C.compared(bucketed(s, d), P.RUN, P.query(truth=P.TRUTH)).drop("call_id")


@_add("compare_bucketed_stats", P.oracle_sql()["stats_filtered"])
def _stats(s: SparkSession, d: str) -> DataFrame:
    q = P.query(P.Filter("sample_name", "=", "TUMOR"), P.Filter("info:DP", ">", "10"), truth=P.TRUTH)
    return C.statistics(bucketed(s, d), P.RUN, q)


# orders that are the operator: the place is part of the rows


@_add("contig_order", P.with_calls("SELECT contig, row_number() OVER (ORDER BY length(contig), contig) AS place FROM (SELECT DISTINCT contig FROM calls WHERE vcf_id = 1)"))
def _contigs(s: SparkSession, d: str) -> DataFrame:
    return C.with_places(C.contigs(P.calls(s, d), P.RUN))


@_add("newest_first", "SELECT o_orderkey AS id, o_custkey AS project_id, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders")
def _newest(s: SparkSession, d: str) -> DataFrame:
    return C.with_places(K.newest_first(P.runs(s, d)))


@_add("projects_by_newest_run", "SELECT c_custkey AS id, row_number() OVER (ORDER BY max(o_orderkey) DESC NULLS LAST, c_custkey DESC) AS place FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _projects(s: SparkSession, d: str) -> DataFrame:
    tree = K.project_tree(P.projects(s, d), P.full_runs(s, d), P.bams(s, d), P.comments(s, d), P.tasks(s, d))
    return C.with_places(tree.select("id", "newest")).select("id", "place")


# what variants do: parts are transcripts of two exons with 36 coding bases, line items are variants

_AA = lambda codon: f"substr('{effects.AMINO_ACIDS}', CAST(16 * (strpos('TCAG', substr({codon}, 1, 1)) - 1) + 4 * (strpos('TCAG', substr({codon}, 2, 1)) - 1) + strpos('TCAG', substr({codon}, 3, 1)) AS INT), 1)"
_CDS = "concat('ATG', substr(translate(md5(p_name), '0123456789abcdef', 'ACGACGACGACGACGA'), 1, 30), 'TAA')"


def transcripts(s: SparkSession, d: str) -> DataFrame:
    """For each part one that codes for a protein and one, over both exons and what lies between, that does not."""
    part = P.table(s, d, "part").withColumns({"contig": F.expr("concat('chr', cast(p_partkey % 22 + 1 as string))"), "s": F.expr("p_partkey * 100L")})
    part = part.withColumns({"gene_name": F.concat(F.lit("g"), F.col("p_partkey").cast("string")), "strand": F.expr("if(p_size % 2 = 0, '+', '-')")})
    coding = part.select("contig", "gene_name", F.col("p_brand").alias("transcript"), "strand", F.expr("array(struct(s as start, s + 19 as end), struct(s + 35 as start, s + 64 as end))").alias("exons"), (F.col("s") + 5).alias("cds_start"), (F.col("s") + 55).alias("cds_end"), F.expr(_CDS).alias("sequence"))
    other = part.select("contig", "gene_name", F.lit("other").alias("transcript"), "strand", F.expr("array(struct(s as start, s + 64 as end))").alias("exons"), F.lit(None).cast("long").alias("cds_start"), F.lit(None).cast("long").alias("cds_end"), F.lit(None).cast("string").alias("sequence"))
    return coding.unionByName(other)


#: Reference and alternates by line number: exchanges, a deletion, an insertion, none.
_REF = "CASE l_linenumber WHEN 3 THEN 'CA' ELSE 'A' END"
_ALT = "CASE WHEN l_linenumber IN (1, 4) THEN 'T' WHEN l_linenumber IN (2, 5) THEN 'G' WHEN l_linenumber = 3 THEN 'C' WHEN l_linenumber = 6 THEN 'ACGT' END"


@_add("effect_prediction", f"""WITH v AS (
  SELECT DISTINCT l_partkey AS g, l_partkey * 100 + l_orderkey % 70 AS position, {_REF} AS reference, {_ALT} AS alternates FROM lineitem WHERE {_ALT} IS NOT NULL),
w AS (SELECT *, CASE WHEN alternates IN ('C', 'ACGT') THEN position + 1 ELSE position END - 100 * g AS lo, CASE WHEN alternates = 'C' THEN position + 1 ELSE position END - 100 * g AS hi,
    CASE alternates WHEN 'C' THEN '' WHEN 'ACGT' THEN 'CGT' ELSE alternates END AS after FROM v),
t AS (SELECT w.*, p_brand, p_size % 2 = 0 AS fwd, {_CDS} AS cds, length(after) > 1 AS ins, after = '' AS del FROM w JOIN part ON p_partkey = g WHERE lo <= 64 AND hi >= 0),
b AS (SELECT *, CASE WHEN fwd THEN after ELSE CASE after WHEN 'T' THEN 'A' WHEN 'G' THEN 'C' WHEN 'CGT' THEN 'ACG' ELSE '' END END AS bases,
    (lo <= 19 AND hi >= 0) OR (lo <= 64 AND hi >= 35) AS exonic,
    CASE WHEN hi >= 5 AND lo <= 19 AND lo >= 5 AND hi <= 19 THEN CASE WHEN fwd THEN lo - 5 ELSE 40 - hi END WHEN hi >= 35 AND lo <= 55 AND lo >= 35 AND hi <= 55 THEN CASE WHEN fwd THEN lo - 20 ELSE 55 - hi END END AS c,
    lo - 19 AS left_gap, 35 - hi AS right_gap FROM t),
k AS (SELECT *, c // 3 AS k, c % 3 AS r, substr(cds, CAST(3 * (c // 3) + 1 AS INT), 3) AS codon FROM b),
o AS (SELECT *, CASE WHEN ins AND r = 0 THEN '' ELSE codon END AS old FROM k),
n AS (SELECT *, concat(substr(old, 1, CAST(r AS INT)), bases, substr(old, CAST(r + CASE WHEN ins THEN 0 ELSE 1 END + 1 AS INT))) AS new FROM o),
q AS (SELECT *, {_AA('codon')} AS aa, CASE WHEN old = '' THEN '' ELSE {_AA('old')} END AS p, concat({_AA('new')}, CASE WHEN length(new) = 6 THEN {_AA('substr(new, 4, 3)')} ELSE '' END) AS q FROM n),
e AS (SELECT *, CASE
    WHEN NOT exonic THEN CASE WHEN CASE WHEN fwd THEN left_gap ELSE right_gap END <= 2 THEN 'SpliceDonor' WHEN CASE WHEN fwd THEN right_gap ELSE left_gap END <= 2 THEN 'SpliceAcceptor'
      WHEN CASE WHEN fwd THEN left_gap ELSE right_gap END <= 6 OR CASE WHEN fwd THEN right_gap ELSE left_gap END <= 3 THEN 'IntronicSpliceSite' ELSE 'Intronic' END
    WHEN c IS NULL THEN CASE WHEN CASE WHEN fwd THEN least(lo, hi) < 5 ELSE greatest(lo, hi) > 55 END THEN 'FivePrimeUTR' ELSE 'ThreePrimeUTR' END
    WHEN del THEN 'FrameShift'
    WHEN p = q THEN CASE WHEN k = 0 AND old <> new THEN 'AlternateStartCodon' ELSE 'Silent' END
    WHEN k = 0 AND substr(p, 1, 1) <> substr(q, 1, 1) THEN 'StartLoss'
    WHEN contains(q, '*') AND NOT contains(p, '*') THEN 'PrematureStop' WHEN contains(p, '*') AND NOT contains(q, '*') THEN 'StopLoss'
    WHEN NOT ins THEN 'Substitution' WHEN starts_with(q, p) OR ends_with(q, p) THEN 'Insertion' ELSE 'ComplexSubstitution' END AS effect FROM q)
SELECT concat('chr', g % 22 + 1) AS contig, CAST(position AS INT) AS position, reference, alternates, concat('g', g) AS gene_name, p_brand AS transcript, regexp_replace(effect, '([a-z])([A-Z])', '\\1 \\2', 'g') AS effect,
  CASE effect WHEN 'FrameShift' THEN concat('p.', aa, k + 1, 'fs') WHEN 'Substitution' THEN concat('p.', p, k + 1, q) WHEN 'PrematureStop' THEN concat('p.', p, k + 1, split_part(q, '*', 1), '*')
    WHEN 'StartLoss' THEN concat('p.', p, k + 1, '?') WHEN 'StopLoss' THEN concat('p.', p, k + 1, q, 'ext') WHEN 'Silent' THEN 'silent' WHEN 'AlternateStartCodon' THEN 'alternate-start-codon'
    WHEN 'Insertion' THEN concat('p.', k + 1, 'ins', CASE WHEN starts_with(q, p) THEN substr(q, length(p) + 1) ELSE substr(q, 1, length(q) - length(p)) END) WHEN 'ComplexSubstitution' THEN concat('p.', p, k + 1, q)
    WHEN 'SpliceDonor' THEN 'splice-donor' WHEN 'SpliceAcceptor' THEN 'splice-acceptor' WHEN 'IntronicSpliceSite' THEN 'intronic-splice-site'
    WHEN 'FivePrimeUTR' THEN '5'' UTR' WHEN 'ThreePrimeUTR' THEN '3'' UTR' ELSE 'intronic' END AS notation FROM e""")
def _effects(s: SparkSession, d: str) -> DataFrame:
    return _top_effects(s, d, transcripts(s, d))


def _top_effects(s: SparkSession, d: str, of: DataFrame) -> DataFrame:
    variants = P.table(s, d, "lineitem").select(
        F.expr("concat('chr', cast(l_partkey % 22 + 1 as string))").alias("contig"), F.expr("cast(l_partkey * 100 + l_orderkey % 70 as int)").alias("position"),
        F.expr(_REF).alias("reference"), F.expr(_ALT).alias("alternates"),
    )
    found = effects.top_effects(variants, of, 1 << 10)
    return found.select(*RECORD_KEY, *[cell(f"annotations:{c}").alias(n) for c, n in (("gene_name", "gene_name"), ("transcript", "transcript"), ("effect_type", "effect"), ("effect_notation", "notation"))])


def gene_files(s: SparkSession, d: str) -> tuple[str, str]:
    """The same transcripts as features and sequences in files; stop codons are apart from CDS there."""
    rows = transcripts(s, d).withColumn("forward", F.col("strand") == "+")
    stop = F.expr("if(forward, struct('stop_codon' as f, cds_end - 2 as a, cds_end as b), struct('stop_codon' as f, cds_start as a, cds_start + 2 as b))")
    low, high = F.expr("if(forward, cds_start, cds_start + 3)"), F.expr("if(forward, cds_end - 3, cds_end)")
    exons = F.transform("exons", lambda e: F.struct(F.lit("exon").alias("f"), e["start"].alias("a"), e["end"].alias("b")))
    parts = F.filter(F.transform("exons", lambda e: F.struct(F.lit("CDS").alias("f"), F.greatest(e["start"], low).alias("a"), F.least(e["end"], high).alias("b"))), lambda e: e["a"] <= e["b"])
    every = F.when(F.col("cds_start").isNull(), exons).otherwise(F.concat(exons, parts, F.array(stop)))
    name = F.concat("gene_name", F.lit("-"), "transcript")
    lines = rows.select("contig", "strand", F.explode(every).alias("e"), F.concat(F.lit('gene_id "x"; gene_name "'), "gene_name", F.lit('"; transcript_id "'), name, F.lit('"; level 2;')).alias("more"))
    gtf, cds = shared_folder(s, "catalog-gtf"), shared_folder(s, "catalog-cds")
    lines.select(F.concat_ws("\t", "contig", F.lit("x"), "e.f", F.col("e.a").cast("string"), F.col("e.b").cast("string"), F.lit("."), "strand", F.lit("."), "more")).write.text(gtf)
    rows.where("sequence is not null").select(F.concat(F.lit(">"), name, F.lit(".7 cds\n"), F.expr("substr(sequence, 1, 20)"), F.lit("\n"), F.expr("lower(substr(sequence, 21))"))).write.text(cds)
    return gtf, cds


@_add("effects_from_files", _SQL["effect_prediction"])
def _effects_of_files(s: SparkSession, d: str) -> DataFrame:
    found = transcript_files.read_transcripts(s, *gene_files(s, d))
    return _top_effects(s, d, found.withColumn("transcript", F.substring_index("transcript", "-", -1)))


# small tables as clients get them, and tasks by their events

_MOMENT = f"SELECT user_id AS task_id, {P.STATE_SQL} AS state, ts AS moment FROM events"


@_add("tasks_ledger", f"""SELECT task_id, coalesce(arg_min(state, (moment, state)) FILTER (WHERE state IN ('SUCCESS', 'FAILURE')), arg_max(state, (moment, state))) AS state FROM ({_MOMENT}) GROUP BY 1""")
def _ledger(s: SparkSession, d: str) -> DataFrame:
    """The first terminal state of each task, else its latest."""
    events = P.tasks(s, d).join(P.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at")), "id")
    return K.ledger(events.select(F.col("vcf_id").alias("task_id"), "state", "at")).select("task_id", "state")


@_add("bams_json", """SELECT CAST(to_json(struct_pack(id := s_suppkey, "projectId" := s_suppkey * 3, name := s_name, normal := NULL, notes := NULL, tissues := NULL, "resectionDate" := NULL, uri := NULL)) AS VARCHAR) AS json FROM supplier""")
def _json(s: SparkSession, d: str) -> DataFrame:
    """The view of BAMs as one JSON text for each, without columns that are not of the view."""
    return json_rows(K.view(P.bams(s, d).withColumn("inside", F.lit(1)), "bams"))


@_add("runs_shown", "SELECT o_orderkey AS id, o_custkey AS project_id, coalesce(n, 0) AS num_comments, o_custkey AS tumor_bam_id, o_custkey * 2 AS normal_bam_id FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _runs_shown(s: SparkSession, d: str) -> DataFrame:
    rows = K.view(K.comment_counts(P.full_runs(s, d), P.comments(s, d)), "runs")
    return rows.select("id", "project_id", "num_comments", "tumor_bam_id", "normal_bam_id")


@_add("examine_bams", "SELECT o_orderkey AS id, t.s_name AS tumor, n.s_name AS normal, c_name AS project FROM orders LEFT JOIN supplier t ON t.s_suppkey = o_custkey LEFT JOIN supplier n ON n.s_suppkey = o_custkey * 2 LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7")
def _examined(s: SparkSession, d: str) -> DataFrame:
    """One run with its project and both BAMs."""
    row = K.with_projects(K.with_bams(K.by_id(P.full_runs(s, d), 7), P.bams(s, d)), P.projects(s, d))
    return row.select("id", F.col("tumor_bam.name").alias("tumor"), F.col("normal_bam.name").alias("normal"), F.col("project.name").alias("project"))


@_add("column_spec", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', {str(x).lower()}, {i})" for i, (c, t, x) in enumerate((("info:DP", "integer", True), ("info:SOMATIC", "flag", False), ("sample:GT", "string", False), ("sample:DP", "integer", True), ("sample:DP4", "integer", False), ("sample_name", "string", False)))) + ") v(column_name, type, sortable, ord)")
def _spec(s: SparkSession, d: str) -> DataFrame:
    """Columns to show of the run, by the header of its file and what its calls hold."""
    path = _vcf_file(s, d)
    found = vcf.ingest(s, path, P.VCF_RUN, shared_folder(s, "catalog-calls"))
    return header.spec(s, found["vcf_header"].split("\n"), found["extant_columns"]).select("column_name", "type", "sortable", "ord")


_TYPED = ("sml rg", "bl", "qzx", "e")


@_add("fuzzy_values", """WITH v AS (SELECT DISTINCT p_name AS value FROM part), t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{t}', '{'.*?'.join(t)}')" for t in _TYPED) + """) x(typed, pattern)),
f AS (SELECT typed, value, regexp_extract(lower(value), pattern, 0, 's') AS part FROM v, t WHERE regexp_matches(lower(value), pattern, 's')),
r AS (SELECT typed, value, CAST(length(part) - length(typed) AS INT) AS gaps, instr(lower(value), part) AS place FROM f)
SELECT typed, value, gaps, CAST(row_number() OVER (PARTITION BY typed ORDER BY gaps, place, length(value), value) AS INT) AS rank FROM r QUALIFY rank <= 12""")
def _fuzzy(s: SparkSession, d: str) -> DataFrame:
    """Names of parts that hold the typed letters in order."""
    return search.fuzzy_values(P.table(s, d, "part"), "p_name", list(_TYPED), 12)
