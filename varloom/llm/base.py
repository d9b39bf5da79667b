"""What several text operators share: whole-text batches, scratch folders, byte classes, integers by byte."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space between words, in every contract: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression class (Java and Python).
SPACE_CLASS = r"[\x20\x09-\x0D]"
NOT_SPACE_CLASS = r"[^\x20\x09-\x0D]"

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Spark's setting under which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, so few rows and few bytes go at once.

    Spark reads these two settings of the session when a plan runs.  They are only ever lowered, and no result depends on them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: Estimates from here on mean that the planner does not know.
UNKNOWN_BYTES = 1 << 55


def shares(df: DataFrame, size: int) -> int:
    """Into how many parts rows are dealt: the shuffle partitions of the session, or more where the planner's estimate of
    the input holds that many times `size` bytes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-estimate // size)) if estimate < UNKNOWN_BYTES else least


def text_shares(docs: DataFrame, text_col: str, size: int) -> int:
    """The same by the texts' true bytes in UTF-8, which one scan of the column sums: files that compress well count in full."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("n")).first()["n"]
    return max(least, -(-total // size))


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list | pa.Array]]],
    schema: str,
    text_col: str = "text",
    drop_text: bool = False,
) -> DataFrame:
    """Append the columns of `schema` (DDL), computed from whole texts, to each row; a null text counts as empty.

    `make` runs once in a task and returns the function from a batch of texts to its columns.  Existing columns of the
    same names are replaced.  Rows are neither moved nor shuffled.
    """
    bounded_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    names = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name == text_col]
    out_kept = [f for f in kept if not (f.name == text_col and (drop_text or f.name.lower() in names))]
    out = StructType(out_kept + added.fields)
    source = df.select(*[df[f"`{f.name}`"] for f in kept])
    keep_names, new_names = [f.name for f in out_kept], [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, work = to_arrow_schema(out), make()
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            columns = work(texts)
            arrays = [batch.column(n) for n in keep_names]
            arrays += [c if isinstance(c := columns[n], pa.Array) else pa.array(c, target.field(n).type) for n in new_names]
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return source.mapInArrow(run, out)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors of a cluster share.

    Where the setting is missing a default is set on one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        root = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes within it delete their shuffle files as they end: what they wrote is read from then on.

    Files lost with an executor during a write are made anew as ever, as nothing is deleted before its end.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: cuts lineage so that a lost executor costs one stage."""
    path = scratch(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lower bytes of integers, byte by byte: in order or small, they compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def of_planes(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that `scratch` named, by Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
