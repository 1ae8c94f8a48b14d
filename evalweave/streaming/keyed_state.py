"""The newest record of each key, kept by Spark's state store.

A batch updates the states of its own keys and nothing else; what changed goes on, the whole table is read from the state
store when it is wanted. A query that starts again goes on from its checkpoint. Larger states belong into RocksDB
(spark.sql.streaming.stateStore.providerClass), which is the session's to set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(records: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """key, newest (a struct that begins with the order): the same columns in any stream or table."""
    columns = [order, *[c for c in records.columns if c not in (key, order)]]
    return records.groupBy(key).agg(F.max(F.struct(*columns)).alias("newest"))


def follow_newest(stream: DataFrame, changed: Callable[[DataFrame, int], None], checkpoint: str, key: str = "qid", order: str = "ord", every: str | None = None) -> StreamingQuery:
    """Calls changed with the new states of each batch's keys. every: a pause between batches; without it, what is there is read once."""

    def step(batch: DataFrame, number: int) -> None:
        changed(batch.select(key, "newest.*"), number)

    writer = newest(stream, key, order).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def state_table(spark: SparkSession, checkpoint: str, key: str = "qid") -> DataFrame:
    """The newest record of every key as of the last batch that was committed."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col(f"key.{key}").alias(key), F.col("value.max.*"))
