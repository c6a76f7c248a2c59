"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="foliate-")
    return _own[app]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python workers whole texts in batches of at most ``rows`` rows, so that a batch is some megabytes, not some tens."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000") or 0) not in range(1, rows + 1):
        spark.conf.set(name, str(rows))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/foliate/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.foliate_path = path
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs of one operator read on the executors' disks; what a lost executor held is made again."""
    return df.persist(StorageLevel.DISK_ONLY)


def broadcast_if_small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """Hint a broadcast for a narrow table of numbers if, by its counted rows, it is a few megabytes; else leave it to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later job reads."""
    for df in tables:
        path = getattr(df, "foliate_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files directly below ``path``; empty if it is missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(target) if s.isFile()]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for other file systems."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None
