import pytest
from pyspark.sql import functions as F

from varloom import functions as V
from varloom.operators import calls as C
from varloom.plans.query import Filter, Query, Range, Sort, UnknownColumn
from varloom.sources import header as H
from varloom.sources.vcf import ingest, read_table, read_vcf, write_csv
from varloom.sources.vcf_writer import export_lines, export_vcf

HEADER = [
    "##fileformat=VCFv4.1",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=SOMATIC,Number=0,Type=Flag,Description="Somatic">',
    '##INFO=<ID=SPV,Number=1,Type=Float,Description="P">',
    '##INFO=<ID=ZZ,Number=.,Type=String,Description="Not kept">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##FORMAT=<ID=DP4,Number=4,Type=Integer,Description="Strands">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tnormal tumor",
]
RECORDS = [
    "20\t100\t.\tA\tG\t.\tPASS\tDP=93;SPV=2.5E-7\tGT:DP:DP4\t0/0:44:8,3,7,11\t0/1:37:1,2,3,4",
    "20\t250\trs1\tC\tT,G\t50.5\tq10;s50\tDP=9;SOMATIC\tGT:DP:DP4\t0/0:5:1,1,1,2\t0/1",
    "chr2\t7\t.\tG\tA\t.\tPASS\tDP=30\tGT:DP:DP4\t0/0:.:1,1,1,1\t1/1:12:2,2,2,2",
    "chr10\t7\t.\tG\tA\t.\tPASS\tDP=31\tGT:DP:DP4\t0/0:8:1,1,1,1\t1/1:13:2,2,2,2",
    "X\t9\t.\tT\tC\t.\tPASS\t.\tGT:DP:DP4\t0/0:21:1,1,1,1\t1/1:14:2,2,2,2",
    "KI270728\t3\t.\tT\t.\t.\t.\tDP=2\tGT:DP:DP4\t0/0:22:1,1,1,1\t1/1:15:2,2,2,2",
]
TRUTH = [RECORDS[0], RECORDS[2], "20\t999\t.\tA\tC\t.\tPASS\tDP=1\tGT:DP:DP4\t0/0:1:1,1,1,1\t0/1:1:1,1,1,1"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("calls")
    out = {"table": str(folder / "calls")}
    for i, records in ((1, RECORDS), (2, TRUTH)):
        path = folder / f"run{i}.vcf"
        path.write_text("\n".join([*HEADER, *records]) + "\n")
        out[i] = (str(path), ingest(spark, f"file://{path}", i, out["table"]))
    return out


@pytest.fixture
def calls(spark, store):
    return read_table(spark, store["table"])


def query(*filters, **more):
    return Query(tuple(filters), types=H.query_types(HEADER), **more)


def test_read(spark, store, calls):
    rows = {(r["contig"], r["position"], r["sample_name"]): r for r in C.run_calls(calls, 1).collect()}
    assert len(rows) == 12
    r = rows["20", 100, "normal"]
    assert (r["info:DP"], r["info:SPV"], r["sample:DP4"], r["filters"], r["id"], r["quality"]) == ("93", "2.5E-7", "[8, 3, 7, 11]", None, None, None)
    r = rows["20", 250, "tumor"]
    assert (r["alternates"], r["filters"], r["quality"], r["info:SOMATIC"], r["sample:GT"], r["sample:DP"], r["sample:DP4"]) == ("T,G", "q10,s50", "50.5", "True", "0/1", None, None)
    assert rows["KI270728", 3, "normal"]["alternates"] is None
    assert store[1][1]["genotype_count"] == 12
    assert set(store[1][1]["extant_columns"]) == {"info:DP", "info:SOMATIC", "info:SPV", "sample:GT", "sample:DP", "sample:DP4"}


def test_ingest_again_replaces(spark, store, calls):
    ingest(spark, f"file://{store[2][0]}", 2, store["table"])
    counts = {r["vcf_id"]: r["genotype_count"] for r in C.call_counts(read_table(spark, store["table"])).collect()}
    assert counts == {1: 12, 2: 6}


def test_typed_filters_and_order(calls):
    got = C.query_calls(calls, 1, query(Filter("sample_name", "=", "tumor"), Filter("info:DP", "<", "50"), sort=(Sort("contig"),), limit=250)).collect()
    assert [(r["contig"], r["position"]) for r in got] == [("chr2", 7), ("chr10", 7), ("20", 250), ("KI270728", 3)]
    got = C.query_calls(calls, 1, query(Filter("sample:DP", ">", "12"), sort=(Sort("sample:DP", True),))).collect()
    assert [r["sample:DP"] for r in got] == ["44", "37", "22", "21", "15", "14", "13"]
    with pytest.raises(ValueError):
        C.condition(Filter("info:DP", "<", "x"), "integer")
    with pytest.raises(ValueError):
        C.condition(Filter("info:DP", "~", "1"))
    with pytest.raises(UnknownColumn):
        query(Filter("nope", "=", "1")).typed({}, ["A"])


def test_null_order_and_pages(calls):
    q = lambda desc, page: query(Filter("sample_name", "=", "normal"), sort=(Sort("sample:DP", desc),), limit=2, page=page)
    values = lambda desc: [r["sample:DP"] for p in range(4) for r in C.query_calls(calls, 1, q(desc, p)).collect()]
    assert values(False) == ["5", "8", "21", "22", "44", None]
    assert values(True) == [None, "44", "22", "21", "8", "5"]


def test_contigs_samples_range(calls):
    assert [r[0] for r in C.contigs(calls, 1).collect()] == ["X", "20", "chr2", "chr10", "KI270728"]
    assert [r[0] for r in C.samples(calls, 1).collect()] == ["normal", "tumor"]
    assert C.filtered(calls, 1, query(range=Range("20", 100, 250))).count() == 2
    down = calls.where("vcf_id = 1 and sample_name = 'normal'").orderBy(*V.contig_order("contig", True)).select("contig").collect()
    assert [r[0] for r in down] == ["chr2", "chr10", "20", "20", "KI270728", "X"]


def test_statistics(calls):
    row = C.statistics(calls, 1, query(truth=2)).first().asDict()
    assert (row["number_of_records"], row["total_truth_records"], row["true_positives"], row["false_positives"], row["false_negatives"]) == (12, 6, 4, 8, 2)
    assert row["precision"] == pytest.approx(4 / 12) and row["recall"] == pytest.approx(4 / 6) and row["f1score"] == pytest.approx(4 / 9)
    row = C.statistics(calls, 1, query(Filter("sample_name", "=", "tumor"), Filter("info:DP", ">", "40"), truth=2)).first().asDict()
    assert (row["number_of_records"], row["total_truth_records"], row["true_positives"]) == (1, 3, 1)
    row = C.statistics(calls, 1, query(range=Range("nowhere"), truth=2)).first().asDict()
    assert (row["number_of_records"], row["precision"], row["recall"], row["f1score"]) == (0, 0.0, 0.0, 0.0)
    tags = C.query_calls(calls, 1, query(truth=2)).groupBy(C.TRUE_POSITIVE).count().collect()
    assert {r[0]: r[1] for r in tags} == {True: 4, False: 8}


def test_closure_and_export(spark, store, calls):
    header, extant = HEADER, store[1][1]["extant_columns"]
    some = C.record_closure(calls, 1, query(Filter("sample:DP", "=", "37")))
    assert some.count() == 2
    # a record without an alternate is found again: null parts of the key are equal
    assert C.record_closure(calls, 1, query(Filter("contig", "=", "KI270728"))).count() == 2
    lines = [r[0] for r in export_lines(C.run_calls(calls, 1), header, extant).collect()]
    assert lines[: len(header)] == header
    assert [x.split("\t")[0] for x in lines[len(header) :]] == ["X", "20", "20", "chr2", "chr10", "KI270728"]
    line = next(x for x in lines if "\t250\t" in x).split("\t")
    assert line[:7] == ["20", "250", "rs1", "C", "T,G", "50.5", "q10;s50"] and line[7] == "DP=9;SOMATIC" and line[9:] == ["0/0:5:1,1,1,2", "0/1:.:."]


def test_round_trip(spark, store, calls, tmp_path):
    extant = store[1][1]["extant_columns"]
    path = tmp_path / "again.vcf"
    path.write_text("\n".join(r[0] for r in export_lines(C.run_calls(calls, 1), HEADER, extant).collect()))
    again = read_vcf(spark, f"file://{path}", 1)
    a, b = (df.select(*[V.cell(c) for c in calls.columns]) for df in (C.run_calls(calls, 1), again))
    # a missing FILTER comes back as PASS; both are null
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_spec(spark, store):
    rows = H.spec(spark, HEADER, store[1][1]["extant_columns"]).collect()
    assert [r["column_name"] for r in rows] == ["info:DP", "info:SOMATIC", "info:SPV", "sample:GT", "sample:DP", "sample:DP4", "sample_name"]
    assert H.query_columns(HEADER, ["info:DP"]) == ["reference", "alternates", "contig", "position", "info:DP", "sample_name"]


def test_csv(spark, calls, tmp_path):
    write_csv(C.run_calls(calls, 1).limit(1), ["contig", "id", "sample:GQ"], f"file://{tmp_path}/csv", {"sample:GQ": "none"})
    assert spark.read.text(f"file://{tmp_path}/csv").first()[0].endswith(",,none")


def test_scalar_functions(spark):
    cells = spark.createDataFrame([(None,), ("",), ("[1, 2]",), ("['a', 'b']",), ("[5]",), ("x, y",)], "v string")
    assert [r[0] for r in cells.select(V.vcf_cell(F.col("v"))).collect()] == [".", ".", "1,2", "a,b", "5", "x, y"]
    one = spark.range(1)
    assert one.select(V.effect_words(F.lit("FrameShiftTruncation"))).first()[0] == "Frame Shift Truncation"
    assert one.select(V.task_label(F.lit("workers.genotype_extractor.extract"))).first()[0] == "genotype_extractor"
    assert one.select(V.ascii_only(F.lit("aéb"))).first()[0] == "ab"
    link = V.igv_link("http://h/load?g=1", [(F.lit("http://x/a.vcf"), "Run", "vcf"), (F.lit("file:///b.bam"), "Normal", "bam"), (F.lit(None).cast("string"), "Tumor", "bam")], F.lit("20:5"))
    assert one.select(link).first()[0] == "http://h/load?g=1&file=http://x/a.vcf&name=Run&format=vcf&locus=20:5"


@pytest.mark.parametrize("camel, snake", [("tumorBamId", "tumor_bam_id"), ("VCFHeader", "vcf_header"), ("runOf2Files", "run_of2_files"), ("lastX", "last_x"), ("uri", "uri")])
def test_snake_case(camel, snake):
    assert V.snake_case(camel) == snake


def test_camel_case(spark):
    assert [V.camel_case(x) for x in ("tumor_bam_id", "vcf_header", "run_2_files", "uri")] == ["tumorBamId", "vcfHeader", "run2Files", "uri"]
    df = spark.sql("select 1 as run_id, array(named_struct('task_state', 'x', 'at_time', named_struct('in_hours', 2))) as task_list")
    row = V.rename_keys(df).first().asDict(True)
    assert row == {"runId": 1, "taskList": [{"taskState": "x", "atTime": {"inHours": 2}}]}
    assert V.rename_keys(V.rename_keys(df), V.snake_case).schema == df.schema


def test_number_texts_and_paths(spark):
    one = spark.range(1)
    assert tuple(one.select(V.count_text(F.lit(1234567)), V.ratio_text(F.lit(2 / 3)), V.preview(F.lit("x" * 50))).first()) == ("1,234,567", "0.6667", "x" * 45)
    json = F.lit('{"a": {"b": 5}}')
    assert tuple(one.select(V.at_path(json, "a", "b"), V.at_path(json, "a", "z", "b"), V.at_path(F.lit(None).cast("string"), "a")).first()) == ("5", None, None)


def test_repeated_info_keys_take_the_last(spark, tmp_path):
    path = tmp_path / "again.vcf"
    path.write_text("\n".join([*HEADER, "7\t1\t.\tA\tC\t.\tPASS\tDP=3;SOMATIC;DP=4;SOMATIC\tGT\t0/1\t0/0", "7\t2\t.\tA\tC\t.\tPASS\tDPX=1;DP\tGT\t0/1\t0/0"]))
    rows = {(r["position"], r["sample_name"]): (r["info:DP"], r["info:SOMATIC"]) for r in read_vcf(spark, f"file://{path}", 1).collect()}
    assert rows == {(1, "normal"): ("4", "True"), (1, "tumor"): ("4", "True"), (2, "normal"): (None, None), (2, "tumor"): (None, None)}


def test_a_file_without_records_empties_its_run(spark, tmp_path):
    path, table = tmp_path / "run.vcf", f"file://{tmp_path}/calls"
    path.write_text("\n".join([*HEADER, *RECORDS]) + "\n")
    assert ingest(spark, f"file://{path}", 1, table)["genotype_count"] == 12 and ingest(spark, f"file://{path}", 2, table)["genotype_count"] == 12
    path.write_text("\n".join(HEADER) + "\n")
    facts = ingest(spark, f"file://{path}", 1, table)
    assert facts["genotype_count"] == 0 and facts["extant_columns"] == []
    assert {r["vcf_id"]: r["genotype_count"] for r in C.call_counts(read_table(spark, table)).collect()} == {2: 12}


def test_header(spark, tmp_path):
    path = tmp_path / "long.vcf"
    path.write_text("\n".join(["##fileformat=VCFv4.1", *[f"##contig=<ID={i}>" for i in range(2500)], *HEADER[1:], RECORDS[0], "# not of the header"]))
    header = H.read_header(spark, f"file://{path}")
    assert len(header) == 2500 + len(HEADER) and header[-1] == HEADER[-1]
    path.write_text("##only\n")
    assert H.read_header(spark, f"file://{path}") == ["##only"]
    assert H.release_of(HEADER) == 75 and H.release_of(["##reference=file:///ensembl-release-81/x.fa"]) == 81
    of = {f.column: f for f in H.fields(HEADER)}
    assert H.sortable(of["info:DP"], True) and not H.sortable(of["info:DP"], False) and not H.sortable(of["sample:DP4"], True) and not H.sortable(of["sample:GT"], True)


def test_samples_that_the_header_lacks_are_an_error(spark, store, calls):
    with pytest.raises(Exception, match="a sample is not in the header"):
        export_lines(C.run_calls(calls, 1), HEADER[:-1] + [HEADER[-1].replace("tumor", "other")], store[1][1]["extant_columns"]).collect()


def test_export_fails_where_a_file_is(spark, store, calls, tmp_path):
    path = f"file://{tmp_path}/out"
    export_vcf(C.run_calls(calls, 1), HEADER, store[1][1]["extant_columns"], path)
    assert spark.read.text(path).count() == len(HEADER) + len(RECORDS)
    with pytest.raises(Exception, match="(?i)exist"):
        export_vcf(C.run_calls(calls, 1), HEADER, store[1][1]["extant_columns"], path)


def test_query_objects(spark):
    q = Query((Filter("A", "=", "1"),), Range("X", 5), (Sort("B", True),), 2, 50, 9)
    assert Query.from_json(q.to_json()) == q
    assert Query().with_defaults() == Query(sort=(Sort("contig"), Sort("position")), limit=250)
    assert Query(sort=(Sort("position", True),)).with_defaults().sort == (Sort("contig", True), Sort("position", True)) and Query(sort=(Sort("B"),)).with_defaults().sort == (Sort("B"),)


def test_orders_return_the_whole_run(spark):
    from varloom.plans import catalog

    d = "/root/testdata/sf0.001"
    run = C.run_calls(catalog.calls(spark, d), catalog.RUN).collect()
    key = lambda r: (r["l_orderkey"], r["l_partkey"], r["l_suppkey"])
    none = lambda x: (x is None, 0 if x is None else x)
    rest = lambda r: (*[none(r[c]) for c in ("contig", "position", "reference", "alternates", "sample_name")], *key(r))
    got = sorted(catalog.queries()["export_order_all"](spark, d).collect(), key=lambda r: r["place"])
    assert len(run) > 500 and [r["place"] for r in got] == list(range(1, len(run) + 1))
    assert [key(r) for r in got] == [key(r) for r in sorted(run, key=lambda r: (len(r["contig"]), *rest(r)))]
    got = sorted(catalog.queries()["sort_typed_all"](spark, d).collect(), key=lambda r: r["place"])
    nulls = sum(r["info:DP"] is None for r in run)
    assert len(got) == len(run) and nulls and all((r["info:DP"] is None) == (i >= len(run) - nulls) for i, r in enumerate(got))


def test_places_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    placed = C.with_places(rows.orderBy("v"))
    spark.conf.set("spark.sql.adaptive.enabled", before)
    assert placed.rdd.getNumPartitions() > 1 and placed.where("place != v + 1").count() == 0 and placed.count() == 5000
    assert C.with_places(rows.limit(0).orderBy("v")).count() == 0
