"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Folders that were staged within scratch(), by thread.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master a folder of our own."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="evalmill-runs-")
    return _local[app]


def path_of(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/evalmill-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder: computed once, read as often as needed, and safe from lost executors. release() removes all of an application."""
    path = path_of(df.sparkSession, name)
    if (own := _scratch.get()) is not None:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread stages within it is deleted at its end: for steps that come again and again, whose results are written elsewhere by then."""
    own: list[str] = []
    outer = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(outer)
        for path in own:
            p, fs = file_system(spark, path)
            fs.delete(p, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return bool(fs.globStatus(p))


def release(spark: SparkSession) -> None:
    p, fs = file_system(spark, f"{shared_root(spark)}/evalmill-tables/{spark.sparkContext.applicationId}")
    fs.delete(p, True)
