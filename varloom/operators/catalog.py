"""Runs, projects, BAMs, comments, tasks and stars: views and changes of the small tables around the calls.

Tables are DataFrames.  A change gives the new table (to be written by one writer), so a caller decides where it lives.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varloom.functions import epoch_seconds, row_key, task_label
from varloom.operators.calls import same
from varloom.schema import CALL_KEY, STARRED, STARS


class NotFound(LookupError):
    pass


class Conflict(ValueError):
    pass


# lookups


def newest_first(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("id"))


def matching(table: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def by_id(table: DataFrame, key: int) -> DataFrame:
    row = table.where(F.col("id") == key).limit(1)
    if row.isEmpty():
        raise NotFound(f"no row {key}")
    return row


# views


def comment_counts(runs: DataFrame, comments: DataFrame) -> DataFrame:
    """Runs with their number of comments, 0 where there is none."""
    n = comments.groupBy("vcf_id").agg(F.count("*").alias("num_comments"))
    return runs.join(n, runs["id"] == n["vcf_id"], "left").drop("vcf_id").withColumn("num_comments", F.coalesce("num_comments", F.lit(0)))


def with_bams(runs: DataFrame, bams: DataFrame) -> DataFrame:
    """Runs with their tumor and normal BAM as structs, null where unknown."""
    for side in ("tumor", "normal"):
        b = bams.select(F.col("id").alias("_bam"), F.struct("*").alias(f"{side}_bam"))
        runs = runs.join(b, runs[f"{side}_bam_id"] == b["_bam"], "left").drop("_bam")
    return runs


def with_projects(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Runs with their project as a struct, null where unknown."""
    p = projects.select(F.col("id").alias("_project"), F.struct("*").alias("project"))
    return runs.join(p, runs["project_id"] == p["_project"], "left").drop("_project")


#: Columns of each view that clients get; others stay inside.
VIEWS = {
    "projects": ("id", "name", "notes"),
    "bams": ("id", "project_id", "name", "normal", "notes", "tissues", "resection_date", "uri"),
    "runs": ("id", "project_id", "caller_name", "created_at", "notes", "uri", "genotype_count", "num_comments", "tumor_bam_id", "normal_bam_id", "extant_columns"),
    "comments": ("id", "vcf_id", "sample_name", "contig", "position", "reference", "alternates", "comment_text", "user", "created", "last_modified"),
    "tasks": ("type", "state"),
}


def view(table: DataFrame, name: str) -> DataFrame:
    """The columns of a view, in its order; a column that the table lacks is null."""
    there = set(table.columns)
    return table.select(*[F.col(c) if c in there else F.lit(None).cast("string").alias(c) for c in VIEWS[name]])


def with_task_states(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with the set of their tasks' states, empty where there is none."""
    states = tasks.groupBy("vcf_id").agg(F.array_sort(F.collect_set("state")).alias("task_states"))
    return runs.join(states, runs["id"] == states["vcf_id"], "left").drop("vcf_id").withColumn("task_states", F.coalesce("task_states", F.array().cast("array<string>")))


def project_tree(projects: DataFrame, runs: DataFrame, bams: DataFrame, comments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Projects with nested runs and BAMs, the one with the newest run first, those without runs last."""
    full = with_task_states(with_bams(comment_counts(runs, comments), bams), tasks)
    by_project = full.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("*")), asc=False).alias("vcfs"), F.max("id").alias("newest"))
    own = bams.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("*"))).alias("bams"))
    out = projects.join(by_project, projects["id"] == by_project["project_id"], "left").drop("project_id")
    out = out.join(own, out["id"] == own["project_id"], "left").drop("project_id")
    return out.orderBy(F.desc_nulls_last("newest"), F.desc("id"))


def with_users(comments: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("_user"), F.struct("id", "username").alias("user"))
    rows = comments.join(u, comments["user_id"] == u["_user"], "left").drop("_user")
    return rows.withColumns({"created": epoch_seconds(F.col("created")), "last_modified": epoch_seconds(F.col("last_modified"))})


def comments_by_row(comments: DataFrame, run: int) -> DataFrame:
    """(row_key, comments): a run's comments by the call they belong to, oldest first."""
    rows = comments.where(F.col("vcf_id") == run).withColumn("row_key", row_key())
    return rows.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("created", "id", "comment_text", "user_id"))).alias("comments"))


def calls_with_comments(calls: DataFrame, comments: DataFrame) -> DataFrame:
    key = ("vcf_id", *CALL_KEY)
    found = comments.groupBy(*[F.col(c).alias(f"c_{c}") for c in key]).agg(F.array_sort(F.collect_list(F.struct("created", "id", "comment_text"))).alias("comments"))
    return calls.join(found, same(calls, found, key, "c_"), "left").drop(*[f"c_{c}" for c in key])


def latest(table: DataFrame, n: int = 5, by: str = "created") -> DataFrame:
    return table.orderBy(F.desc(by), F.desc("id")).limit(n)


def related_runs(runs: DataFrame, run: int) -> DataFrame:
    own = runs.where(F.col("id") == run).select(F.col("project_id").alias("_project"))
    return runs.where(F.col("id") != run).join(F.broadcast(own), F.col("project_id") == F.col("_project"), "left_semi").orderBy(F.desc("id"))


# changes


def created(table: DataFrame, values: Mapping, unique: tuple[str, ...] = (), now=None) -> DataFrame:
    """The table with one more row, under the next id; unknown names are refused, and values that must be unique."""
    if unknown := set(values) - set(table.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    taken = table.where(F.lit(False))
    for name in unique:
        taken = taken.unionByName(table.where(F.col(name) == F.lit(values.get(name))))
    if unique and not taken.isEmpty():
        raise Conflict(f"{' or '.join(unique)} is taken")
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
    row = table.sparkSession.range(1).select(*[F.lit({"id": last + 1, **values}.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return table.unionByName(row)


def updated(table: DataFrame, key: int, values: Mapping) -> DataFrame:
    by_id(table, key)
    if unknown := set(values) - set(table.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    hit = F.col("id") == key
    return table.withColumns({n: F.when(hit, F.lit(v)).otherwise(F.col(n)).cast(table.schema[n].dataType) for n, v in values.items()})


def deleted(table: DataFrame, key: int) -> DataFrame:
    by_id(table, key)
    return table.where(F.col("id") != key)


def project_of(projects: DataFrame, project_id: int | None = None, project_name: str | None = None) -> int:
    """The id of a project given by exactly one of id and name."""
    if (project_id is None) == (project_name is None):
        raise Conflict("give either the project's id or its name")
    rows = matching(projects, id=project_id) if project_id is not None else matching(projects, name=project_name)
    found = rows.select("id").first()
    if found is None:
        raise NotFound("no such project")
    return found["id"]


def bam_of(bams: DataFrame, project: int, uri: str) -> int:
    """The id of a project's BAM with this URI; of several the newest."""
    found = matching(bams, project_id=project, uri=uri).agg(F.max("id").alias("id")).first()["id"]
    if found is None:
        raise NotFound(f"the project has no BAM at {uri}")
    return found


def comment_updated(comments: DataFrame, key: int, text: str, last_modified, now) -> DataFrame:
    """A new text, if the comment is still as the writer last saw it."""
    seen = by_id(comments, key).select("last_modified", "comment_text").first()
    if seen["last_modified"] != last_modified:
        raise Conflict("the comment has changed meanwhile")
    if not text.strip() or text == seen["comment_text"]:
        raise ValueError("the text is blank or unchanged")
    return updated(comments, key, {"comment_text": text, "last_modified": now})


# stars: a table of events, the latest of a call counts


def star_row(calls: DataFrame, values: Mapping, at, seq: int) -> DataFrame:
    """One event; the call must exist."""
    row = calls.where(F.col("vcf_id") == values["vcf_id"])
    for name in CALL_KEY:
        row = row.where(F.col(name).eqNullSafe(F.lit(values[name])))
    if row.isEmpty():
        raise NotFound("no such call")
    fields = {**values, "at": at, "seq": seq}
    return calls.sparkSession.range(1).select(*[F.lit(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(STARS).fields])


def star_event(calls: DataFrame, stars: DataFrame, values: Mapping, at) -> DataFrame:
    """The events with one more; the call must exist."""
    last = stars.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
    return stars.unionByName(star_row(calls, values, at, last + 1))


def latest_stars(events: DataFrame) -> DataFrame:
    """The latest event of each call."""
    key = ["vcf_id", *CALL_KEY]
    found = events.groupBy(*key).agg(F.max_by(F.struct("starred", "at", "seq"), F.struct("at", "seq")).alias("e"))
    return found.select(*key, "e.starred", "e.at", "e.seq")


def starred(calls: DataFrame, stars: DataFrame) -> DataFrame:
    """Calls with their star: the latest event, else what the table has, else false."""
    key = ["vcf_id", *CALL_KEY]
    now = stars.groupBy(*key).agg(F.max_by("starred", F.struct("at", "seq")).alias("_star"))
    rows = calls.join(now, same(calls, now, tuple(key)), "left").drop(*[now[c] for c in key])
    old = F.col(f"`{STARRED}`") if STARRED in calls.columns else F.lit(None).cast("boolean")
    return rows.withColumn(STARRED, F.coalesce("_star", old, F.lit(False))).drop("_star")


# tasks


def unfinished(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("state").isin("SUCCESS", "FAILURE"))


def without_tasks(tasks: DataFrame, run: int) -> DataFrame:
    """The table without a run's tasks."""
    return tasks.where(~F.col("vcf_id").eqNullSafe(run))


def ledger(events: DataFrame) -> DataFrame:
    """(task_id, state, at) from events (task_id, state, at), in whatever order they come: the first terminal state of a task
    stays, and before there is one its latest counts.  Equal times go by the state's name.  For tables and for streams."""
    terminal = F.col("state").isin("SUCCESS", "FAILURE")
    order = F.struct("at", "state")
    rows = events.groupBy("task_id").agg(F.min(F.when(terminal, order)).alias("end"), F.max(order).alias("last"))
    now = F.coalesce("end", "last")
    return rows.select("task_id", now["state"].alias("state"), now["at"].alias("at"))


def refreshed(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """The table with the latest `states` (task_id, state) of its unfinished tasks; others stay as they are."""
    new = states.select("task_id", F.col("state").alias("_state"))
    open_ = ~F.col("state").isin("SUCCESS", "FAILURE")
    rows = tasks.join(new, "task_id", "left").withColumn("state", F.when(open_, F.coalesce("_state", "state")).otherwise(F.col("state")))
    return rows.select(*tasks.columns)


def task_states(tasks: DataFrame, run: int) -> DataFrame:
    """(label, state) of a run's tasks, the latest of each type."""
    rows = tasks.where(F.col("vcf_id") == run).groupBy("type").agg(F.max_by("state", "id").alias("state"))
    return rows.select(task_label(F.col("type")).alias("label"), "state")


def visible_tasks(tasks: DataFrame, run: int) -> DataFrame:
    return tasks.where((F.col("vcf_id") == run) & (F.col("state") != "SUCCESS"))


def to_restart(tasks: DataFrame) -> DataFrame:
    """(vcf_id, steps): runs with a failed step; a failed extraction also repeats the annotation."""
    last = Window.partitionBy("vcf_id", "type").orderBy(F.desc("id"))
    now = tasks.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    failed = now.groupBy("vcf_id").agg(
        F.bool_or((F.col("state") == "FAILURE") & F.col("type").contains("extract")).alias("extract"),
        F.bool_or((F.col("state") == "FAILURE") & F.col("type").contains("annotate")).alias("annotate"),
    )
    steps = F.when(F.col("extract"), F.array(F.lit("extract"), F.lit("annotate"))).when(F.col("annotate"), F.array(F.lit("annotate")))
    return failed.select("vcf_id", steps.alias("steps")).where(F.col("steps").isNotNull())
