"""Files of reads, VCF files as a data source, single files, buckets, and null parts of keys."""
import os
import random
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan
from pyspark.sql.pandas.types import to_arrow_schema

from tests.test_calls import HEADER, RECORDS, TRUTH, query
from varloom.operators import annotate, calls as C, catalog as K
from varloom.plans.catalog_sources import bucketed
from varloom.plans.query import Filter
from varloom.schema import ANNOTATIONS, CALL_ID
from varloom.sources import bam, bgzf, call_table, vcf_format, vcf_writer
from varloom.sources import header as H
from varloom.sources.vcf import ingest, read_table, read_vcf


def reads_of(seed, n):
    """Reads of all lengths on three contigs, some across many bins, some not placed."""
    r, out = random.Random(seed), []
    for i in range(n):
        start, length = r.choice([r.randrange(100_000), r.randrange(40_000_000)]), r.choice([1, 30, 150, 20_000, 3_000_000])
        seq = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 7, 30])))
        placed = r.random() > 0.05
        out.append((r.choice(["chr2", "chr10", "X"]) if placed else None, start if placed else None, start + length if placed else None, f"r{i}", 0 if placed else 4, r.randrange(60), seq, "".join(chr(33 + r.randrange(40)) for _ in seq)))
    return out


READ = "contig string, start int, end int, name string, flag int, mapping_quality int, sequence string, quality string"


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("reads") / "7"), reads_of(1, 3000)
    bam.write_reads(spark.createDataFrame(rows, READ).repartition(5), f"file://{path}")
    return path, rows


def test_reads_come_back(spark, reads):
    path, rows = reads
    got = bam.read_reads(spark, f"file://{path}").select(*[c.split()[0] for c in READ.split(", ")]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert all(f.endswith((".bam", ".bai", ".crc")) for f in os.listdir(path))


@pytest.mark.parametrize("contig, start, end", [("chr2", 0, 100), ("chr10", 50_000, 50_001), ("X", 0, 1 << 29), ("chr2", 39_000_000, 45_000_000), ("none", 0, 10), ("X", 16_383, 16_385)])
def test_search_gives_what_overlaps(spark, reads, contig, start, end):
    path, rows = reads
    got = C.overlapping(bam.read_reads(spark, path), contig, start, end)
    assert sorted(r["name"] for r in got.collect()) == sorted(r[3] for r in rows if r[0] == contig and r[1] < end and r[2] > start)


def test_search_reads_only_blocks_that_match(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("1").alias("contig"), (F.col("id") * 100).cast("int").alias("start"), (F.col("id") * 100 + 90).cast("int").alias("end"), F.col("id").cast("string").alias("name"))
    bam.write_reads(rows.coalesce(1), str(tmp_path))
    from pyarrow import fs

    system, found = fs.LocalFileSystem(), []
    for name in sorted(f for f in os.listdir(tmp_path) if f.endswith(".bam")):
        counts = {}
        with open(tmp_path / name, "rb") as f:
            total = len(list(bgzf.members(f)))
        got = list(bam.read_file(system, str(tmp_path / name), bam.Region("1", 1_000_000, 1_000_500), counts=counts))
        found += got
        print(name, total, counts, len(got))
        assert counts["blocks"] <= 4 and (counts["blocks"] < total or total < 5)
    assert [r[3] for r in found] == [str(i) for i in range(10_000, 10_005)]


def test_filters_go_into_the_source(spark, reads):
    reader = bam.ReadsReader(reads[0])
    one, two, three = EqualTo(("contig",), "X"), LessThan(("start",), 9), GreaterThan(("end",), 5)
    assert list(reader.pushFilters([two, one, three, EqualTo(("name",), "a")])) == [EqualTo(("name",), "a")]
    assert (reader.region.contig, reader.region.start, reader.region.end) == ("X", 5, 9)
    reader = bam.ReadsReader(reads[0])
    assert list(reader.pushFilters([two, three])) == [two, three] and reader.region.whole
    plan = C.overlapping(bam.read_reads(spark, reads[0]), "X", 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "(start" not in plan.split("BatchScan")[0]


def test_long_files_are_divided(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("1").alias("contig"), (F.col("id") * 50).cast("int").alias("start"), (F.col("id") * 50 + 90).cast("int").alias("end"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    bam.write_reads(rows.coalesce(1), str(tmp_path))
    bam.register(spark)
    got = spark.read.format("reads").option("split_bytes", 50_000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 8 and got.select("name").distinct().count() == got.count() == 40_000


def plainly(row, place):
    """One read as bytes, by the format's description, with its interval."""
    contig, start, end, name, flag, mapq, cigar, seq, quality = row
    ref = place[contig] if contig is not None else -1
    placed = ref >= 0 and start is not None
    ops = bam.parsed_cigar(cigar) or ([(end - start, "M")] if placed and end is not None and end > start else [])
    start, end = (start, start + max(1, bam.covered(ops))) if placed else (-1, 0)
    seq, name = (seq or "").upper().replace("*", ""), (name or "*").encode()
    codes = [bam.BASES.index(b) if b in bam.BASES else 15 for b in seq] + [0] * (len(seq) % 2)
    marks = bytes(ord(c) - 33 for c in quality) if quality and (quality != "*" or len(seq) == 1) else b"\xff" * len(seq)
    flag = flag if flag is not None else 0 if placed else 4
    body = struct.pack("<iiBBHHHIiii", ref if placed else -1, start, len(name) + 1, mapq or 0, bam.bin_of(start, end) if placed else 4680, len(ops), flag, len(seq), -1, -1, 0)
    body += name + b"\0" + b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(op)) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + marks
    return struct.pack("<i", len(body)) + body, start, end


def test_reads_of_a_batch_are_encoded_at_once(tmp_path):
    """Bytes, blocks and index of whole batches are those of one read after the other; a hundred thousand take moments."""
    r, rows = random.Random(8), []
    for i in range(3000):
        contig, start, seq = r.choice(["a", "b", "b", None]), r.choice([None, r.randrange(1 << 28)]), "".join(r.choice("ACGTnR-*\u00e9") for _ in range(r.choice([0, 1, 6, 90_000 if i % 500 == 7 else 3])))
        n = len(seq.upper().replace("*", ""))
        cigar = r.choice([None, None, "*", "3S10M2D", "5M1000N7M", "7=1X"])
        rows.append((contig, start, r.choice([None, start and start + r.choice([0, 1, 90, 2_000_000])]), r.choice([None, "", f"r{i}", "\u00e9" * 99]), r.choice([None, 4, 65_535]), r.choice([None, 0, 255]), cigar, r.choice([seq, seq or None]), r.choice([None, "*" if n != 1 else "I", "J" * n])))
    place = {"a": 0, "b": 1}
    rows.sort(key=lambda x: (x[0] is None or x[1] is None, x[0] or "", x[1] or 0))
    batch = pa.RecordBatch.from_pylist([dict(zip(bam.READS.names, x)) for x in rows], schema=to_arrow_schema(bam.READS))
    out, want = (bgzf.Writer(open(tmp_path / n, "wb")) for n in "ab")
    index, bins, windows = bam.Index([{}, {}], [{}, {}]), [{}, {}], [{}, {}]
    for i in (0, 1000):
        got = bam.encoded(batch.slice(i, 1000 if i == 0 else 2000), place)
        at, after = out.write_pieces(got.data, got.offsets)
        index.add(*[x[got.start >= 0] for x in (got.ref, got.start, got.end, at, after)])
    for row in rows:
        data, start, end = plainly(row, place)
        if want.held and len(want.held) + len(data) > bgzf.BLOCK:
            want.flush()
        begin = want.tell()
        want.write(data)
        if start >= 0:
            of = bins[place[row[0]]].setdefault(bam.bin_of(start, end), [])
            if of and of[-1][1] == begin:
                of[-1][1] = want.tell()
            else:
                of.append([begin, want.tell()])
            for w in range(start >> bam.SMALLEST, (max(start, end - 1) >> bam.SMALLEST) + 1):
                windows[place[row[0]]].setdefault(w, begin)
    out.close(), want.close()
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    assert index.bins == bins and index.windows == windows
    many = pa.RecordBatch.from_pydict({"contig": ["a"] * 100_000, "start": pa.array(range(100_000), pa.int32()), "end": pa.array(range(50, 100_050), pa.int32()), "name": [f"{i}.1" for i in range(100_000)]})
    began = time.process_time()
    for i in range(0, 100_000, bam.PIECE):
        bam.encoded(many.slice(i, bam.PIECE), place)
    assert time.process_time() - began < 0.8  # one after the other they took 1.5 s


def test_reads_of_a_bam(spark, reads):
    bams = spark.createDataFrame([(4, os.path.basename(reads[0]))], "id long, uri string")
    got = bam.search_reads(bams, 4, "chr2", 0, 1000, os.path.dirname(reads[0]) + "/")
    assert got.count() == sum(r[0] == "chr2" and r[1] < 1000 for r in reads[1])
    with pytest.raises(K.NotFound):
        bam.search_reads(bams, 5, "chr2", 0, 1000)


def test_bins_hold_their_intervals():
    r = random.Random(3)
    for _ in range(2000):
        a, n, b, m = r.randrange(1 << 28), r.choice([1, 10, 20_000, 1 << 24]), r.randrange(1 << 28), r.choice([1, 10, 20_000, 1 << 24])
        if a < b + m and b < a + n:
            assert bam.bin_of(a, a + n) in bam.bins_of(b, b + m)
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(0, 1 << 29) == 0


def test_bad_reads_are_refused(spark, tmp_path):
    for row in (("1", 5, 9, "x" * 300), ("1", 1 << 29, (1 << 29) + 5, "x")):
        with pytest.raises(Exception, match="254|positions"):
            bam.write_reads(spark.createDataFrame([row], "contig string, start int, end int, name string"), str(tmp_path / row[3][:1]))
    empty = spark.createDataFrame([], "contig string, start int, end int")
    bam.write_reads(empty, str(tmp_path / "none"))
    assert bam.read_reads(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="cigar"):
        bam.parsed_cigar("5Q")
    assert bam.covered(bam.parsed_cigar("5S10M2I3D7N1M")) == 21


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("vcf")
    for i, records in ((1, RECORDS), (2, TRUTH)):
        (folder / f"{i}.vcf").write_text("\n".join([*HEADER, *records]) + "\n")
    return folder


@pytest.mark.parametrize("split", [1, 40, 200, 1 << 20])
def test_source_gives_the_rows_of_the_native_reader(spark, files, split):
    vcf_format.register(spark)
    got = spark.read.format("vcf").option("vcf_id", 1).option("split_bytes", split).load(f"file://{files}/1.vcf")
    want = read_vcf(spark, f"file://{files}/1.vcf", 1).select(*[f"`{c}`" for c in got.columns])
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_source_pushes_contig_and_position(spark, files):
    vcf_format.register(spark)
    rows = spark.read.format("vcf").load(str(files / "1.vcf"))
    got = rows.where("contig in ('20', 'chr2') and position > 7 and position <= 250 and sample_name = 'tumor'")
    assert sorted((r["contig"], r["position"]) for r in got.collect()) == [("20", 100), ("20", 250)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert "position" not in plan.split("Filter", 1)[-1].split("\n")[0] and "sample_name" in plan
    reader = vcf_format.VcfReader(str(files / "1.vcf"), rows.schema)
    assert list(reader.pushFilters([EqualTo(("contig",), "20"), LessThan(("position",), 200)])) == []
    assert [reader.wanted(x) for x in (RECORDS[0], RECORDS[1], RECORDS[2], "# x", "")] == [True, False, False, False, False]
    with pytest.raises(Exception, match="no #CHROM"):
        (files / "bad.vcf").write_text("##only\n")
        spark.read.format("vcf").load(str(files / "bad.vcf"))


def test_one_file(spark, files, tmp_path):
    calls = read_vcf(spark, f"file://{files}/1.vcf", 1)
    path = f"file://{tmp_path}/out.vcf"
    vcf_writer.export_file(calls.repartition(3), HEADER, ["info:DP", "sample:GT"], path)
    lines = (tmp_path / "out.vcf").read_text().splitlines()
    assert lines[: len(HEADER)] == HEADER and [x.split("\t")[0] for x in lines[len(HEADER) :]] == ["X", "20", "20", "chr2", "chr10", "KI270728"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out.vcf"]
    with pytest.raises(FileExistsError):
        vcf_writer.export_file(calls, HEADER, [], path)


def test_ingest_reads_the_file_once(spark, files, tmp_path):
    store = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("once", "once")
    facts = ingest(spark, f"file://{files}/1.vcf", 1, f"file://{tmp_path}/calls", HEADER)
    jobs = store.getJobIdsForGroup("once")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and facts["genotype_count"] == 12 and "info:DP" in facts["extant_columns"]


@pytest.fixture(scope="module")
def buckets(spark, files, tmp_path_factory):
    name, folder = "calls_in_buckets", tmp_path_factory.mktemp("buckets")
    call_table.create(spark, name, buckets=4, location=f"file://{folder}/t")
    facts = [call_table.ingest(spark, f"file://{files}/{i}.vcf", i, name) for i in (1, 2)]
    yield name, facts
    spark.sql(f"DROP TABLE {name}")


def test_runs_in_buckets_are_compared_without_an_exchange(spark, buckets):
    name, facts = buckets
    assert [f["genotype_count"] for f in facts] == [12, 6]
    calls, q = spark.table(name), query(Filter("sample_name", "=", "tumor"), truth=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (C.compared(calls, 1, q), C.true_positives(calls, 1, q)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan and rows.count() in (6, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert CALL_ID in calls.columns and call_table.buckets_of(spark, name) == 4


def test_buckets_grow_with_the_table(spark, monkeypatch):
    """A task reads one bucket, which has no more calls in a larger table."""
    assert [call_table.buckets_for(n, 8) for n in (0, 4_000_000, 4_000_001, 216_000_000)] == [8, 8, 9, 432]
    monkeypatch.setattr(call_table, "BUCKET_ROWS", 500)
    calls = bucketed(spark, "/root/testdata/sf0.001", 2)
    assert len(calls.inputFiles()) > 12  # files of 12 buckets and two runs, not of two buckets


def test_ingest_sorts_lines_and_not_calls(spark, files, tmp_path):
    """Calls of a hundred columns are not held for a sort, and lie in order within files."""
    ingest(spark, f"file://{files}/1.vcf", 1, f"file://{tmp_path}/calls")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for i in reversed(range(runs.size())) if "InsertIntoHadoopFs" in (p := runs.apply(i).physicalPlanDescription()))
    tree = plan.split("(1)")[0]
    assert tree.count("Sort") == 1 and tree.index("Sort") > tree.index("Generate")
    for name in os.listdir(tmp_path / "calls" / "vcf_id=1"):
        if name.endswith(".parquet"):
            at = [(r["contig"], r["position"]) for r in spark.read.parquet(f"file://{tmp_path}/calls/vcf_id=1/{name}").collect()]
            assert at == sorted(at)


def test_buckets_replace_runs(spark, buckets, files, tmp_path):
    name, _ = buckets
    call_table.ingest(spark, f"file://{files}/2.vcf", 2, name)
    assert {r["vcf_id"]: r["genotype_count"] for r in C.call_counts(spark.table(name)).collect()} == {1: 12, 2: 6}
    (tmp_path / "none.vcf").write_text("\n".join(HEADER) + "\n")
    call_table.ingest(spark, f"file://{files}/1.vcf", 9, name)
    assert call_table.ingest(spark, f"file://{tmp_path}/none.vcf", 9, name)["genotype_count"] == 0
    assert C.call_counts(spark.table(name)).count() == 2


def test_missing_alternates_are_equal(spark, tmp_path):
    """A run and its copy as truth: every call is a true positive, also where ALT is missing."""
    for i in (1, 2):
        (tmp_path / f"{i}.vcf").write_text("\n".join([*HEADER, RECORDS[0], RECORDS[5]]) + "\n")
        ingest(spark, f"file://{tmp_path}/{i}.vcf", i, f"file://{tmp_path}/calls")
    calls = read_table(spark, f"file://{tmp_path}/calls")
    row = C.statistics(calls, 1, query(truth=2)).first()
    assert (row["true_positives"], row["precision"], row["recall"]) == (4, 1.0, 1.0)
    assert all(r[C.TRUE_POSITIVE] for r in C.compared(calls, 1, query(truth=2)).collect())
    genes = spark.createDataFrame([("KI270728", 1, 9, 1, "G", "T", "n", "e")], "contig string, start int, end int, priority int, " + ", ".join(f"`{c}` string" for c in ANNOTATIONS))
    own = C.run_calls(calls, 1)
    assert [r[ANNOTATIONS[0]] for r in annotate.annotated(own, annotate.annotations(own, genes)).where("contig = 'KI270728'").collect()] == ["G", "G"]
    comments = spark.createDataFrame([(1, 1, "tumor", "KI270728", 3, "T", None, "seen", None)], "id long, vcf_id long, sample_name string, contig string, position int, reference string, alternates string, comment_text string, created timestamp")
    got = K.calls_with_comments(own, comments)
    assert got.columns == [*own.columns, "comments"] and [r["comments"][0]["comment_text"] for r in got.where("comments is not null").collect()] == ["seen"]
    assert C.record_closure(calls, 1, query(Filter("contig", "=", "KI270728"))).count() == 2
