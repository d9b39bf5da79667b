"""Folders that all executors share, and files by Hadoop's file system API."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, for files of this session: they go when it ends.  Only on one machine is there a
    default."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    parent, files = path_of(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files.mkdirs(parent)
    files.deleteOnExit(parent)
    return f"{parent.toString()}/data"


def path_of(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
