"""Classification of arriving pages: the rule stage has no state, so a stream runs the same expressions as a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliate.operators.classify import unified
from foliate.plans.policy import Policy


def classify_stream(spark: SparkSession, folder: str, schema: str, policies: Sequence[Policy], keys: Sequence[str], text: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read page files as they arrive and append their verdicts to ``sink``; exactly once by file and checkpoint."""
    pages: DataFrame = spark.readStream.schema(schema).parquet(folder)
    verdicts = unified(pages, policies, keys, text)
    writer = verdicts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
