"""One folder with the call table and the small tables, and what clients ask of it.

Small tables are rewritten as a whole, version by version.  A writer claims the version after the one that it read by a
file that must not be there yet, so of two writers one begins again with what the other wrote (or gets Conflict, where its change
no longer holds).  Stars are a log: each is one row that is appended, and `compact_stars` keeps the latest of each call.  Calls are
partitions of one table and are only ever replaced by run.
"""
from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varloom import schema as S
from varloom.folders import path_of
from varloom.functions import json_rows
from varloom.operators import annotate, calls as C, catalog as K
from varloom.operators.effects import top_effects
from varloom.plans import cql
from varloom.plans.query import Query
from varloom.sources import call_table
from varloom.sources import header as H
from varloom.sources.bam import search_reads
from varloom.sources.vcf import facts, ingest, observed, read_table, write_run
from varloom.sources.vcf_writer import export_lines

TABLES = {"projects": S.PROJECTS, "bams": S.BAMS, "runs": S.RUNS, "comments": S.COMMENTS, "tasks": S.TASKS, "stars": S.STARS, "users": S.USERS}
#: Times that a change is made again because another writer was faster, seconds between, and those after which a claim is void.
TRIES, WAIT_S, LEASE_S = 20, 0.2, 600


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        """With `buckets`, calls lie in so many buckets of their key, and comparing runs moves none of them.  A folder has the
        same number for good."""
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._name = f"calls_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}" if buckets else None

    # tables

    def _versions(self, name: str) -> list[str]:
        """Complete versions of a small table, oldest first."""
        path, fs = path_of(self.spark, f"{self.folder}/{name}")
        found = [str(s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(v for v in found if fs.exists(path_of(self.spark, f"{v}/_SUCCESS")[0]))

    def table(self, name: str) -> DataFrame:
        """A small table, empty before its first row; `calls` is the call table."""
        if name == "calls" and self.buckets:
            return self.spark.table(self._bucketed())
        if name == "calls":
            path, fs = path_of(self.spark, f"{self.folder}/calls")
            return read_table(self.spark, str(path)) if fs.exists(path) else self.spark.createDataFrame([], S.CALLS)
        if name == "stars":
            # the log that the last version holds already is read too: someone may have been writing to it
            logs = [log for n, log in self._star_logs() if n >= self._next("stars") - 1]
            rows = self._version("stars")
            return rows.unionByName(self.spark.read.schema(rows.schema).parquet(*logs)) if logs else rows
        return self._version(name)

    def _version(self, name: str) -> DataFrame:
        kind, versions = StructType.fromDDL(TABLES[name]), self._versions(name)
        return self.spark.read.schema(kind).parquet(versions[-1]) if versions else self.spark.createDataFrame([], kind)

    def _bucketed(self) -> str:
        """The name of the call table in this session's catalog, which learns of runs that other sessions wrote."""
        if not self.spark.catalog.tableExists(self._name):
            path, fs = path_of(self.spark, f"{self.folder}/calls")
            fs.mkdirs(path)
            call_table.create(self.spark, self._name, None, self.buckets, str(path))
            self.spark.sql(f"ALTER TABLE {self._name} RECOVER PARTITIONS")
        return self._name

    def _next(self, name: str) -> int:
        versions = self._versions(name)
        return int(versions[-1].rpartition("/v")[2]) + 1 if versions else 0

    def _claimed(self, name: str, number: int) -> bool:
        """Whether this writer has the version now.  Claims of writers that never came to an end are taken over after a while."""
        path, fs = path_of(self.spark, f"{self.folder}/{name}/.claims/v{number:09d}")
        for _ in range(2):
            try:
                fs.create(path, False).close()
                return True
            except Py4JJavaError:
                if not fs.exists(path) or time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < LEASE_S:
                    return False
                fs.delete(path, False)
        return False

    def change(self, name: str, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Writes the version that `rows_of` makes of the last one.

        Readers take the last complete version, so a writer that dies loses nothing; the one before stays for those who
        still read it.  Where another writer was faster, its version is read and `rows_of` asked again.
        """
        for _ in range(TRIES):
            versions, number = self._versions(name), self._next(name)
            rows = rows_of(self.table(name))
            if not self._claimed(name, number):
                time.sleep(WAIT_S)
                continue
            rows.select(*[f.name for f in StructType.fromDDL(TABLES[name]).fields]).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{number:09d}")
            for old in versions[:-1]:
                path, fs = path_of(self.spark, old)
                fs.delete(path, True)
            return self.table(name)
        raise K.Conflict(f"others keep changing {name}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes the next version, whatever the last one was."""
        return self.change(name, lambda _: rows)

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    def list(self, name: str) -> DataFrame:
        return K.newest_first(self.table(name))

    def shown(self, name: str) -> DataFrame:
        """What clients get of a table, newest first: the columns of its view, and no others."""
        rows = self.table(name)
        if name == "runs":
            rows = K.comment_counts(rows, self.table("comments"))
        rows = K.newest_first(K.with_users(rows, self.table("users")) if name == "comments" else rows)
        return K.view(rows, name)

    def json(self, name: str) -> DataFrame:
        """The same as one JSON text for each row, with names as clients write them."""
        return json_rows(self.shown(name))

    def get(self, name: str, key: int) -> DataFrame:
        row = K.by_id(self.table(name), key)
        return K.with_projects(K.with_bams(row, self.table("bams")), self.table("projects")) if name == "runs" else row

    def create(self, name: str, values: Mapping) -> int:
        """A new row (of a project, BAM, comment or user); gives its id."""
        values = dict(values)
        if name == "bams":
            values["project_id"] = K.project_of(self.table("projects"), values.pop("project_id", None), values.pop("project_name", None))
        if name == "comments":
            values |= {"created": self.now(), "last_modified": self.now()}
        unique = {"projects": ("name",), "users": ("username", "email")}.get(name, ())
        return self._created(name, lambda table: K.created(table, values, unique))

    def _created(self, name: str, rows_of: Callable[[DataFrame], DataFrame]) -> int:
        """The id that a new row got in the version which this writer wrote."""
        new = []

        def keep(table: DataFrame) -> DataFrame:
            new[:] = [table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1]
            return rows_of(table)

        self.change(name, keep)
        return new[0]

    def update(self, name: str, key: int, values: Mapping) -> None:
        self.change(name, lambda table: K.updated(table, key, values))

    def delete(self, name: str, key: int) -> None:
        self.change(name, lambda table: K.deleted(table, key))

    def edit_comment(self, key: int, text: str, last_modified: datetime) -> None:
        """A new text; Conflict if someone has changed the comment since it was last modified as the caller saw it."""
        self.change("comments", lambda table: K.comment_updated(table, key, text, last_modified, self.now()))

    # runs

    def create_run(self, values: Mapping, genes: DataFrame | None = None) -> int:
        """A run of the VCF file at values['uri']; its calls are extracted and, with gene models or transcripts, annotated.

        BAMs are given by tumor_bam_id and normal_bam_id, or by tumor_bam_uri and normal_bam_uri.
        """
        values = dict(values)
        project = K.project_of(self.table("projects"), values.pop("project_id", None), values.pop("project_name", None))
        for side in ("tumor", "normal"):
            if uri := values.pop(f"{side}_bam_uri", None):
                values[f"{side}_bam_id"] = K.bam_of(self.table("bams"), project, uri)

        def added(runs: DataFrame) -> DataFrame:
            if not K.matching(runs, project_id=project, uri=values["uri"]).isEmpty():
                raise K.Conflict("the project has a run of this file")
            return K.created(runs, {**values, "project_id": project, "created_at": self.now()})

        run = self._created("runs", added)
        self.work(run, ("extract", "annotate"), genes)
        return run

    def work(self, run: int, steps: tuple[str, ...], genes: DataFrame | None = None) -> None:
        """The steps in order; each has a row among the tasks.  A failed step ends the work."""
        for step in steps:
            task = self.create("tasks", {"vcf_id": run, "type": f"workers.{step}.{step}", "task_id": uuid.uuid4().hex, "state": "STARTED"})
            try:
                getattr(self, f"_{step}")(run, genes)
            except Exception:
                self.update("tasks", task, {"state": "FAILURE"})
                raise
            self.update("tasks", task, {"state": "SUCCESS"})

    def delete_tasks(self, run: int) -> None:
        self.change("tasks", lambda tasks: K.without_tasks(tasks, run))

    def refresh_tasks(self, states: DataFrame) -> None:
        self.change("tasks", lambda tasks: K.refreshed(tasks, states))

    def restart_failed(self, run: int, genes: DataFrame | None = None) -> None:
        found = K.to_restart(self.table("tasks").where(F.col("vcf_id") == run)).first()
        if found:
            self.work(run, tuple(found["steps"]), genes)

    def _extract(self, run: int, _) -> None:
        uri = K.by_id(self.table("runs"), run).first()["uri"]
        found = call_table.ingest(self.spark, uri, run, self._bucketed()) if self.buckets else ingest(self.spark, uri, run, f"{self.folder}/calls")
        self._record(run, found)

    def _record(self, run: int, values: Mapping) -> None:
        hit = F.col("id") == run
        new = {n: F.when(hit, F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)).otherwise(F.col(n)).alias(n) for n, v in values.items()}
        self.change("runs", lambda runs: runs.withColumns(new))

    def _annotate(self, run: int, genes: DataFrame | None) -> None:
        if genes is None:
            return
        calls = C.run_calls(self.table("calls"), run)
        # transcripts tell what a variant does, gene models what it lies in
        found = top_effects(calls, genes) if "exons" in genes.columns else annotate.annotations(calls, genes)
        rows = annotate.annotated(calls, found).select(*[f"`{c}`" for c in S.CALLS.names])
        # a run that is read cannot be replaced: its new rows, sorted already, lie beside it for a while
        part, seen = f"{self.folder}/calls-{uuid.uuid4().hex}", Observation()
        observed(rows, seen).sortWithinPartitions("contig", "position").write.parquet(part)
        again = self.spark.read.schema(S.CALLS).parquet(part)
        if self.buckets:
            call_table.write(again, self._bucketed())
        else:
            write_run(again, f"{self.folder}/calls")
        path, fs = path_of(self.spark, part)
        fs.delete(path, True)
        self._record(run, {"extant_columns": facts(seen)["extant_columns"]})

    def _run(self, run: int):
        row = K.by_id(self.table("runs"), run).first()
        return row, (row["vcf_header"] or "").split("\n"), row["extant_columns"] or []

    def spec(self, run: int) -> DataFrame:
        _, header, extant = self._run(run)
        return H.spec(self.spark, header, extant)

    def typed(self, run: int, query: Query | Mapping | str) -> Query:
        """A query from text, a client's object or as it is, with the run's types."""
        _, header, extant = self._run(run)
        if isinstance(query, str):
            query = cql.parse(query, H.query_columns(header, extant))
        elif isinstance(query, Mapping):
            query = Query.from_json(query)
        return query.typed(H.query_types(header), S.CALLS.names)

    def calls(self, run: int, query: Query | Mapping | str) -> tuple[DataFrame, DataFrame]:
        """The records of a query's page, with stars, and its statistics."""
        q, table = self.typed(run, query).with_defaults(), self.table("calls")
        return C.query_calls(K.starred(table, self.table("stars")), run, q).drop(S.CALL_ID), C.statistics(table, run, q)

    def export(self, run: int, query: Query | Mapping | str) -> DataFrame:
        """Lines of a VCF file with all samples of the records that match; order and page of the query do not count."""
        _, header, extant = self._run(run)
        return export_lines(C.record_closure(self.table("calls"), run, self.typed(run, query)), header, extant)

    def star(self, values: Mapping) -> None:
        """Appends one event; nothing else is read or written but the call itself."""
        row = K.star_row(self.table("calls"), values, self.now(), time.time_ns())
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/stars-log/g{self._next('stars'):09d}")

    def _star_logs(self) -> list[tuple[int, str]]:
        """Logs by the version of the table that comes after them."""
        path, fs = path_of(self.spark, f"{self.folder}/stars-log")
        found = [str(s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(p.rpartition("/g")[2]), p) for p in found)

    def compact_stars(self) -> None:
        """One row of each call that has events; events that come meanwhile stay in the log."""
        self.change("stars", K.latest_stars)
        for n, log in self._star_logs():
            if n < self._next("stars") - 1:
                path, fs = path_of(self.spark, log)
                fs.delete(path, True)

    def bam_reads(self, bam_id: int, contig: str, start: int, end: int, root: str = "") -> DataFrame:
        """Reads of a BAM that overlap the interval, by its index."""
        return search_reads(self.table("bams"), bam_id, contig, start, end, root)

    # views

    def tree(self) -> DataFrame:
        return K.project_tree(*[self.table(t) for t in ("projects", "runs", "bams", "comments", "tasks")])

    def comments_by_row(self, run: int) -> DataFrame:
        return K.comments_by_row(self.table("comments"), run)

    def latest_comments(self, n: int = 5) -> DataFrame:
        return K.with_users(K.latest(self.table("comments"), n), self.table("users"))

    def examine(self, run: int) -> dict[str, DataFrame]:
        """What is shown beside a run's calls."""
        calls = self.table("calls")
        return {"run": self.get("runs", run), "spec": self.spec(run), "contigs": C.contigs(calls, run), "samples": C.samples(calls, run), "related": K.related_runs(self.table("runs"), run), "tasks": K.visible_tasks(self.table("tasks"), run)}
