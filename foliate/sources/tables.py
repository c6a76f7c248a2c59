"""Tables that cut lineage between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

SMALL_BYTES = 32 << 20
MOST_PARTITIONS = 10_000

_own: dict[str, str] = {}


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_keys(df: DataFrame, keys: Sequence[str], each: int) -> DataFrame:
    """Bring the rows of a key together, in as many partitions as keep each near ``each`` bytes as the table's size is estimated:
    their number follows the input, so that what a task sorts or holds does not."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-_bytes(df) // each))
    return df.repartition(min(n, MOST_PARTITIONS), *keys)


def spread(df: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """Deal a table of less than ``small`` bytes over all cores: it may be one row group, which one task would read and match.

    Larger tables are read in splits of their own and are not shuffled.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if _bytes(df) < small else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's result below spark.checkpoint.dir (a temporary folder only where that is unset) and read it back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="foliate-")
        folder = _own[app]
    path = f"{folder.rstrip('/')}/foliate/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
