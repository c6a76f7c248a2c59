"""How much of a table goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own value is 64 MB or 10 000 rows, of which a worker holds two batches and what it makes of them.
OWN = "4194304b"


def bound_batches(spark: SparkSession) -> None:
    """Send pages to Python in batches of a few MB, so that what a worker holds follows neither the table nor the size of a page
    times Spark's 10 000 rows.  Spark has no such setting for one step: it is the session's, and one that the session has stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, OWN)


def release_batches(spark: SparkSession) -> None:
    """Undo ``bound_batches``, for steps of others in the same session."""
    if spark.conf.get(BATCH_BYTES, None) == OWN:
        spark.conf.unset(BATCH_BYTES)
