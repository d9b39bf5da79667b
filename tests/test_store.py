import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_calls import HEADER, RECORDS, TRUTH
from varloom.folders import path_of, shared_folder
from varloom.operators import calls as C, catalog as K
from varloom.operators.catalog import Conflict, NotFound
from varloom.plans.cql import QueryError
from varloom.store import Store
from varloom.streaming import follow_tasks


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for i, records in ((1, RECORDS), (2, TRUTH)):
        (tmp_path / f"{i}.vcf").write_text("\n".join([*HEADER, *records]) + "\n")
    project = store.create("projects", {"name": "p"})
    with pytest.raises(Conflict):
        store.create("projects", {"name": "p"})
    bam = store.create("bams", {"project_name": "p", "uri": "b.bam"})
    genes = spark.createDataFrame([("20", 50, 300, 1, "G1", "T1", "n", "e")], "contig string, start int, end int, priority int, `annotations:gene_name` string, `annotations:transcript` string, `annotations:effect_notation` string, `annotations:effect_type` string")
    run = store.create_run({"project_id": project, "uri": f"file://{tmp_path}/1.vcf", "tumor_bam_id": bam}, genes)
    truth = store.create_run({"project_id": project, "uri": f"file://{tmp_path}/2.vcf"})
    with pytest.raises(Conflict):
        store.create_run({"project_id": project, "uri": f"file://{tmp_path}/2.vcf"})
    with pytest.raises(Exception):
        store.create_run({"project_id": project, "uri": f"file://{tmp_path}/none.vcf"})
    assert [r["state"] for r in store.list("tasks").collect()] == ["FAILURE", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS"]
    assert store.get("runs", run).first()["tumor_bam"]["uri"] == "b.bam" and store.get("runs", run).first()["genotype_count"] == 12

    key = {"vcf_id": run, "contig": "20", "position": 100, "reference": "A", "alternates": "G", "sample_name": "tumor"}
    store.star({**key, "starred": True})
    with pytest.raises(NotFound):
        store.star({**key, "position": 101, "starred": True})
    rows, stats = store.calls(run, "20: AND annotations:gene_name = G1 ORDER BY sample:DP DESC")
    got = rows.collect()
    assert [(r["position"], r["sample:DP"]) for r in got] == [(250, None), (100, "44"), (100, "37"), (250, "5")]
    assert [r["annotations:starred"] for r in got] == [False, False, True, False] and stats.first()["number_of_records"] == 4
    _, stats = store.calls(run, {"filters": [], "compareToVcfId": truth, "page": 0, "limit": 10})
    assert stats.first()["true_positives"] == 4
    with pytest.raises(QueryError):
        store.calls(run, "nope = 1")
    lines = [r[0] for r in store.export(run, "sample:DP = 37").collect()]
    assert lines[: len(HEADER)] == HEADER and len(lines) == len(HEADER) + 1

    by_uri = store.create_run({"project_id": project, "uri": f"file://{tmp_path}/3.vcf", "normal_bam_uri": "b.bam"}) if (tmp_path / "3.vcf").write_text("\n".join([*HEADER, *TRUTH])) else None
    row = store.get("runs", by_uri).first()
    assert row["normal_bam"]["uri"] == "b.bam" and row["project"]["name"] == "p" and row["vcf_release"] == 75
    with pytest.raises(NotFound):
        store.create_run({"project_id": project, "uri": "x.vcf", "tumor_bam_uri": "nowhere"})
    store.delete_tasks(by_uri)
    store.delete("runs", by_uri)
    assert store.table("tasks").where(F.col("vcf_id") == by_uri).isEmpty()
    # a version that was not written to its end does not count
    (tmp_path / "store" / "projects" / "v999999999").mkdir()
    assert store.list("projects").count() == 1

    comment = store.create("comments", {**{k: v for k, v in key.items()}, "comment_text": "hm"})
    seen = store.table("comments").first()["last_modified"]
    store.edit_comment(comment, "better", seen)
    with pytest.raises(Conflict):
        store.edit_comment(comment, "late", seen)
    assert store.comments_by_row(run).first()["comments"][0]["comment_text"] == "better"
    tree = store.tree().first()
    assert [v["num_comments"] for v in tree["vcfs"] if v["id"] == run] == [1] and len(tree["bams"]) == 1
    view = store.examine(run)
    assert view["contigs"].count() == 5 and view["related"].count() == 2 and view["tasks"].isEmpty()
    assert "annotations:gene_name" in [r["column_name"] for r in view["spec"].collect()]
    store.delete("comments", comment)
    assert store.latest_comments().isEmpty() and store.table("calls").where(F.col("vcf_id") == truth).count() == 6


def test_of_two_writers_one_begins_again(spark, tmp_path):
    """Both read one version; the slower one finds the next version taken and works on what the other wrote."""
    folder = f"file://{tmp_path}/store"
    one, two = Store(spark, folder), Store(spark, folder)
    one.create("projects", {"name": "a"})
    seen = []

    def slow(table):
        seen.append(table.count())
        if len(seen) == 1:
            two.create("projects", {"name": "b"})
        return table.where("name <> 'a'")

    one.change("projects", slow)
    assert seen == [1, 2] and [r["name"] for r in one.table("projects").collect()] == ["b"]
    comment = one.create("comments", {"vcf_id": 1, "comment_text": "first"})
    at = one.table("comments").first()["last_modified"]
    asked = []

    def late(table):
        if not asked:
            asked.append(1)
            two.edit_comment(comment, "theirs", at)
        return K.comment_updated(table, comment, "mine", at, one.now())

    with pytest.raises(Conflict):
        one.change("comments", late)
    assert one.table("comments").first()["comment_text"] == "theirs"


def test_a_claim_of_a_dead_writer_ends(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store._claimed("projects", 0) and not store._claimed("projects", 0)
    monkeypatch.setattr("varloom.store.TRIES", 2)
    with pytest.raises(Conflict):
        store.create("projects", {"name": "a"})
    monkeypatch.setattr("varloom.store.LEASE_S", 0)
    assert store.create("projects", {"name": "a"}) == 1


def test_one_star_is_one_row(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "1.vcf").write_text("\n".join([*HEADER, *RECORDS]) + "\n")
    store.create("projects", {"name": "p"})
    run = store.create_run({"project_name": "p", "uri": f"file://{tmp_path}/1.vcf"})
    key = {"vcf_id": run, "contig": "20", "position": 100, "reference": "A", "alternates": "G", "sample_name": "tumor"}
    none = {**key, "contig": "KI270728", "position": 3, "reference": "T", "alternates": None}
    written = lambda: [p for p in (tmp_path / "store").rglob("stars*/**/*.parquet") if spark.read.parquet(f"file://{p}").count()]
    for i, (k, starred) in enumerate(((key, True), (none, True), (key, False), (key, True))):
        store.star({**k, "starred": starred})
        assert len(written()) == i + 1 and all(spark.read.parquet(f"file://{p}").count() == 1 for p in written())
    on = lambda: sorted(r["contig"] for r in K.starred(store.table("calls"), store.table("stars")).where("`annotations:starred`").collect())
    assert on() == ["20", "KI270728"]
    store.compact_stars()
    assert on() == ["20", "KI270728"] and store._version("stars").count() == 2
    store.star({**none, "starred": False})
    assert on() == ["20"]
    store.compact_stars()
    store.compact_stars()
    assert on() == ["20"] and [n for n, _ in store._star_logs()] == []


def test_clients_get_views(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("users", {"username": "u", "email": "e"})
    store.create("projects", {"name": "p"})
    store.create("bams", {"project_name": "p", "uri": "b.bam", "resection_date": "2014"})
    store.create("comments", {"vcf_id": 1, "comment_text": "x", "user_id": 1, "position": 4})
    assert store.json("bams").first()["json"] == '{"id":1,"projectId":1,"name":null,"normal":null,"notes":null,"tissues":null,"resectionDate":"2014","uri":"b.bam"}'
    assert '"user":{"id":1,"username":"u"}' in store.json("comments").first()["json"] and "email" not in store.json("comments").first()["json"]
    assert store.shown("runs").columns[:3] == ["id", "project_id", "caller_name"] and "vcf_header" not in store.shown("runs").columns


def test_task_events_in_any_order(spark, tmp_path):
    """Batches of shuffled events, with a restart in between and one batch that comes twice."""
    r, events = random.Random(2), []
    for task in range(40):
        states = ["STARTED", "RETRY", *r.sample(["SUCCESS", "FAILURE", "STARTED", "RETRY"], 3)]
        events += [(str(task), s, datetime(2020, 1, 1) + timedelta(seconds=r.randrange(1000))) for s in states[: r.randint(1, 5)]]
    r.shuffle(events)
    schema, want = "task_id string, state string, at timestamp", {}
    for task, state, at in sorted(events, key=lambda e: (e[2], e[1])):
        if want.get(task) not in ("SUCCESS", "FAILURE"):
            want[task] = state
    cut = len(events) // 3
    for n in range(3):
        part = events[n * cut : (n + 1) * cut if n < 2 else None]
        spark.createDataFrame(part + (events[:5] if n else []), schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        follow_tasks(stream, f"file://{tmp_path}/ledger", f"file://{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.schema(schema).parquet(f"file://{tmp_path}/ledger")
    assert {x["task_id"]: x["state"] for x in K.ledger(rows.unionByName(rows)).collect()} == want
    assert {x["task_id"]: x["state"] for x in K.ledger(spark.createDataFrame(events, schema)).collect()} == want


def test_runs_are_annotated_with_effects(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "1.vcf").write_text("\n".join([*HEADER, *RECORDS]) + "\n")
    store.create("projects", {"name": "p"})
    transcripts = spark.createDataFrame([("20", "G1", "T1", "+", [(91, 111)], 94, 102, "ATGGCTTAA")], "contig string, gene_name string, transcript string, strand string, exons array<struct<start: long, end: long>>, cds_start long, cds_end long, sequence string")
    run = store.create_run({"project_name": "p", "uri": f"file://{tmp_path}/1.vcf"}, transcripts)
    rows, _ = store.calls(run, "annotations:gene_name = G1")
    got = rows.collect()
    assert {(r["position"], r["annotations:transcript"], r["annotations:effect_type"], r["annotations:effect_notation"]) for r in got} == {(100, "T1", "Stop Loss", "p.*3Eext")} and len(got) == 2
    assert "annotations:effect_type" in store.get("runs", run).first()["extant_columns"]


def test_files_of_a_session_go_with_it(spark):
    path, files = path_of(spark, shared_folder(spark, "gone"))
    assert files.exists(path.getParent()) and files.cancelDeleteOnExit(path.getParent()) and not files.cancelDeleteOnExit(path.getParent())


def test_a_store_in_buckets(spark, tmp_path):
    """The same answers, and runs are compared without moving their calls; another session finds the runs."""
    for i, records in ((1, RECORDS), (2, TRUTH)):
        (tmp_path / f"{i}.vcf").write_text("\n".join([*HEADER, *records]) + "\n")
    genes = spark.createDataFrame([("20", 50, 300, 1, "G1", "T1", "n", "e")], "contig string, start int, end int, priority int, `annotations:gene_name` string, `annotations:transcript` string, `annotations:effect_notation` string, `annotations:effect_type` string")
    plain, dealt = Store(spark, f"file://{tmp_path}/plain"), Store(spark, f"file://{tmp_path}/dealt", 4)
    for store in (plain, dealt):
        store.create("projects", {"name": "p"})
        run, truth = (store.create_run({"project_name": "p", "uri": f"file://{tmp_path}/{i}.vcf"}, genes) for i in (1, 2))
        store.star({"vcf_id": run, "contig": "20", "position": 100, "reference": "A", "alternates": "G", "sample_name": "tumor", "starred": True})
    asked = {"filters": [{"columnName": "sample_name", "type": "=", "filterValue": "tumor"}], "compareToVcfId": truth, "page": 0, "limit": 100}
    answers = []
    for store in (plain, dealt, Store(spark, f"file://{tmp_path}/dealt", 4)):
        rows, stats = store.calls(run, asked)
        assert "call_id" not in rows.columns
        names = sorted(rows.columns)
        answers.append(([tuple(r[c] for c in names) for r in rows.collect()], stats.first(), [r[0] for r in store.export(run, "sample:DP = 37").collect()], store.get("runs", run).first()["extant_columns"]))
        spark.sql(f"DROP TABLE IF EXISTS {store._name}") if store._name else None
    assert answers[0] == answers[1] == answers[2] and len(answers[0][0]) == 6 and answers[0][1]["true_positives"] == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.compared(dealt.table("calls"), run, dealt.typed(run, asked))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
