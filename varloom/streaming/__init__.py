"""Runs that arrive as files in a folder, and stars that arrive as events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varloom.operators.catalog import ledger
from varloom.schema import CALL_KEY
from varloom.sources.vcf import ingest

#: Files of one micro-batch; each is one run.
FILES = 16


def watch_folder(spark: SparkSession, folder: str, table: str, checkpoint: str, run_of=None, files: int = FILES) -> StreamingQuery:
    """Ingests each new .vcf file of a folder as a run's partition.  A batch that is tried again replaces the same partitions.

    `run_of` names a file's run id; by default the digits that end its name.
    """
    run_of = run_of or (lambda path: int("".join(c for c in path.rpartition("/")[2].removesuffix(".vcf") if c.isdigit())))

    def each(batch: DataFrame, _: int) -> None:
        # all files of the batch, however many it was logged with
        for row in batch.select("path").distinct().toLocalIterator():
            ingest(batch.sparkSession, row["path"], run_of(row["path"]), table)

    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.vcf").load(folder)
    return source.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_tasks(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of each task of a stream of events (task_id, state, at): see `catalog.ledger`.

    Each batch appends only the tasks that it changed.  Its rows are events themselves, so `catalog.ledger` of the table is the
    state of all tasks, and a batch that is written twice changes nothing.
    """
    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(table)

    return ledger(events).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stars(events: DataFrame) -> DataFrame:
    """The star of each call, by its latest event; for streams (complete or update mode) and for tables."""
    return events.groupBy("vcf_id", *CALL_KEY).agg(F.max_by("starred", F.struct("at", "seq")).alias("starred"))
