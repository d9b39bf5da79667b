from datetime import datetime

import pytest
from pyspark.sql import functions as F

from varloom import schema as S
from varloom.operators import annotate, catalog as K
from varloom.streaming import latest_stars, watch_folder

T0 = datetime(2020, 1, 1, 12, 0, 0, 250000)
T1 = datetime(2020, 1, 2)


@pytest.fixture(scope="module")
def t(spark):
    return {
        "projects": spark.createDataFrame([(1, "one", None), (2, "two", "n"), (3, "none", None)], S.PROJECTS),
        "bams": spark.createDataFrame([(1, 1, "b", True, None, None, "2001", "uri1"), (2, 2, "c", False, None, None, None, "uri2")], S.BAMS),
        "runs": spark.createDataFrame([(i, T0, b, None, p, "caller", None, f"u{i}", "", 75, ["info:DP"], 4) for i, b, p in ((1, 1, 1), (2, 9, 1), (3, None, 2))], S.RUNS),
        "comments": spark.createDataFrame([(1, 1, "s", "20", 5, "A", "G", "hello", 1, T0, T0), (2, 1, "s", "20", 5, "A", "G", "again", 7, T1, T1), (3, 3, "s", None, 5, "A", "G", "x", 1, T1, T1)], S.COMMENTS),
        "tasks": spark.createDataFrame([(1, 1, "workers.extract.run", "a", "FAILURE"), (2, 2, "workers.annotate.run", "b", "FAILURE"), (3, 2, "workers.annotate.run", "c", "SUCCESS"), (4, 3, "workers.annotate.run", "d", "FAILURE"), (5, 1, "workers.extract.run", "e", "FAILURE")], S.TASKS),
        "users": spark.createDataFrame([(1, "ann", "a@example.com")], S.USERS),
    }


def test_tree(t):
    rows = K.project_tree(t["projects"], t["runs"], t["bams"], t["comments"], t["tasks"]).collect()
    assert [r["id"] for r in rows] == [2, 1, 3]
    one = rows[1]
    assert [v["id"] for v in one["vcfs"]] == [2, 1] and [v["num_comments"] for v in one["vcfs"]] == [0, 2]
    assert one["vcfs"][1]["tumor_bam"]["uri"] == "uri1" and one["vcfs"][0]["tumor_bam"] is None
    assert one["vcfs"][0]["task_states"] == ["FAILURE", "SUCCESS"] and rows[2]["vcfs"] is None


def test_comments(t):
    rows = {r["id"]: r for r in K.with_users(t["comments"], t["users"]).collect()}
    assert rows[1]["user"]["username"] == "ann" and rows[2]["user"] is None and rows[1]["created"] == 1577880000.25
    rows = K.comments_by_row(t["comments"], 1).collect()
    assert [(r["row_key"], [c["comment_text"] for c in r["comments"]]) for r in rows] == [("20:5::A->G", ["hello", "again"])]
    assert K.comments_by_row(t["comments"], 3).first()["row_key"] == ":5::A->G"
    assert [r["id"] for r in K.latest(t["comments"], 2).collect()] == [3, 2]


def test_comment_update_needs_the_state_last_seen(t):
    new = K.comment_updated(t["comments"], 1, "changed", T0, T1)
    assert new.where("id = 1").first()["comment_text"] == "changed"
    with pytest.raises(K.Conflict):
        K.comment_updated(t["comments"], 1, "changed", T1, T1)
    with pytest.raises(ValueError):
        K.comment_updated(t["comments"], 1, "  ", T0, T1)
    with pytest.raises(K.NotFound):
        K.comment_updated(t["comments"], 99, "x", T0, T1)


def test_changes(t):
    new = K.created(t["projects"], {"name": "four"}, ("name",))
    assert new.orderBy(F.desc("id")).first().asDict() == {"id": 4, "name": "four", "notes": None}
    with pytest.raises(K.Conflict):
        K.created(t["projects"], {"name": "two"}, ("name",))
    with pytest.raises(ValueError):
        K.created(t["projects"], {"name": "x", "is_validation": True})
    assert K.deleted(t["projects"], 1).count() == 2
    assert K.project_of(t["projects"], project_name="two") == 2
    with pytest.raises(K.NotFound):
        K.project_of(t["projects"], project_id=8)
    with pytest.raises(K.Conflict):
        K.project_of(t["projects"])
    assert [r["id"] for r in K.related_runs(t["runs"], 1).collect()] == [2]


def test_tasks(t):
    assert {r["vcf_id"]: r["steps"] for r in K.to_restart(t["tasks"]).collect()} == {1: ["extract", "annotate"], 3: ["annotate"]}
    assert K.visible_tasks(t["tasks"], 2).count() == 1 and K.unfinished(t["tasks"]).isEmpty()


def test_task_changes(spark, t):
    states = spark.createDataFrame([("a", "SUCCESS"), ("f", "SUCCESS")], "task_id string, state string")
    running = K.created(t["tasks"], {"vcf_id": 3, "type": "workers.annotate.run", "task_id": "f", "state": "STARTED"})
    assert {r["task_id"]: r["state"] for r in K.refreshed(running, states).collect() if r["task_id"] in "af"} == {"a": "FAILURE", "f": "SUCCESS"}
    assert {r["label"]: r["state"] for r in K.task_states(t["tasks"], 2).collect()} == {"annotate": "SUCCESS"}
    assert {r["vcf_id"] for r in K.without_tasks(t["tasks"], 1).collect()} == {2, 3}


def test_views(t):
    assert {r["id"]: r["project"] and r["project"]["name"] for r in K.with_projects(t["runs"], t["projects"]).collect()} == {1: "one", 2: "one", 3: "two"}
    assert K.bam_of(t["bams"], 1, "uri1") == 1
    with pytest.raises(K.NotFound):
        K.bam_of(t["bams"], 2, "uri1")
    runs = K.view(t["runs"], "runs")
    assert "vcf_header" not in runs.columns and tuple(runs.columns) == K.VIEWS["runs"] and runs.first()["num_comments"] is None
    rows = K.calls_with_comments(t["comments"].select("vcf_id", "contig", "position", "reference", "alternates", "sample_name").distinct(), t["comments"]).collect()
    assert [c["comment_text"] for r in rows if r["contig"] == "20" for c in r["comments"]] == ["hello", "again"]


def test_stars(spark):
    calls = spark.createDataFrame([(1, "20", 5, "A", "G", "s"), (1, "20", 6, "A", None, "s")], "vcf_id long, contig string, position int, reference string, alternates string, sample_name string")
    stars = spark.createDataFrame([], S.STARS)
    key = {"vcf_id": 1, "contig": "20", "position": 6, "reference": "A", "alternates": None, "sample_name": "s"}
    stars = K.star_event(calls, stars, {**key, "starred": True}, T0)
    assert {r["position"]: r[S.STARRED] for r in K.starred(calls, stars).collect()} == {5: False, 6: True}
    stars = K.star_event(calls, stars, {**key, "starred": False}, T0)
    assert {r["position"]: r[S.STARRED] for r in K.starred(calls, stars).collect()} == {5: False, 6: False}
    assert latest_stars(stars).first()["starred"] is False
    with pytest.raises(K.NotFound):
        K.star_event(calls, stars, {**key, "position": 7, "starred": True}, T0)


def test_annotations(spark):
    a = [f"annotations:{x}" for x in ("gene_name", "transcript", "effect_notation", "effect_type")]
    calls = spark.createDataFrame([("1", 5, "A", "G", "s", None), ("1", 5, "A", "G", "t", None), ("1", 70000, "A", "G", "s", "old"), ("2", 5, "A", "G", "s", None)], "contig string, position int, reference string, alternates string, sample_name string, `annotations:gene_name` string")
    for c in a[1:]:
        calls = calls.withColumn(c, F.lit(None).cast("string"))
    genes = spark.createDataFrame([("1", 1, 70000, 1, "wide", "t", "n", "e"), ("1", 4, 6, 2, "best", "t", "n", "e"), ("1", 6, 9, 9, "off", "t", "n", "e")], "contig string, start int, end int, priority int, " + ", ".join(f"`{c}` string" for c in a))
    found = annotate.annotations(calls, genes)
    assert found.count() == 2
    rows = annotate.annotated(calls, found)
    assert sorted((r["contig"], r["position"], r[a[0]]) for r in rows.collect() if r[a[0]]) == [("1", 5, "best"), ("1", 5, "best"), ("1", 70000, "wide")]


def test_folder_stream(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\n1\t5\t.\tA\tG\t.\tPASS\t.\tGT\t0/1\n"
    (drop / "run7.vcf").write_text(text)
    watch_folder(spark, f"file://{drop}", f"file://{tmp_path}/calls", f"file://{tmp_path}/ck").awaitTermination()
    (drop / "run8.vcf").write_text(text)
    watch_folder(spark, f"file://{drop}", f"file://{tmp_path}/calls", f"file://{tmp_path}/ck").awaitTermination()
    assert {r["vcf_id"] for r in spark.read.parquet(f"file://{tmp_path}/calls").collect()} == {7, 8}


def test_a_batch_of_more_files_than_asked_for_is_ingested_whole(spark, tmp_path):
    """A batch that was logged with four files and is tried again by a stream of two."""
    drop = tmp_path / "drop"
    drop.mkdir()
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\n1\t5\t.\tA\tG\t.\tPASS\t.\tGT\t0/1\n"
    for i in range(1, 5):
        (drop / f"run{i}.vcf").write_text(text)

    def fails(path):
        raise RuntimeError("down")

    where = f"file://{drop}", f"file://{tmp_path}/calls", f"file://{tmp_path}/ck"
    with pytest.raises(Exception, match="down"):
        watch_folder(spark, *where, run_of=fails, files=4).awaitTermination()
    watch_folder(spark, *where, files=2).awaitTermination()
    assert {r["vcf_id"] for r in spark.read.parquet(where[1]).collect()} == {1, 2, 3, 4}


def test_fuzzy_values(spark):
    from varloom.operators.search import fuzzy_values

    table = spark.createDataFrame([("Lincoln",), ("lincoln",), ("Lemon, cold",), ("nothing",), (None,), ("a.b*c",), ("axbxc",), ("lncln",)], "v string")
    got = [(r["typed"], r["value"], r["gaps"]) for r in fuzzy_values(table, "v", ["Lncln", "a.b*", "", "zz"], 3).orderBy("typed", "rank").collect()]
    assert got == [("", "a.b*c", 0), ("", "axbxc", 0), ("", "lncln", 0), ("Lncln", "lncln", 0), ("Lncln", "Lincoln", 2), ("Lncln", "lincoln", 2), ("a.b*", "a.b*c", 0)]
    assert fuzzy_values(table, "v", []).count() == 0
    with pytest.raises(ValueError):
        fuzzy_values(table, "v", ["x" * 101])
