"""Scores that follow a growing log.

A log is a folder to which every batch adds files, or one followed by bytes (sources/growing_log). State is one row for
each question, its newest record, kept by the state store; a batch costs its own rows.
Partial summaries have no intervals: those come once every planned question is complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.records import latest
from ..sources.logs import _file, exists
from .keyed_state import follow_newest


def stream_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file."""
    fs, at = _file(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))


def follow_log(stream: DataFrame, state: str, report: Callable[[DataFrame, int], None], checkpoint: str, key: str = "qid", order: str = "ord", every: str | None = None) -> StreamingQuery:
    """Keeps the newest record of each key in the state store and calls report with all of them after each batch.

    A batch writes the states that it changed under state/<batch> and no others; one that runs again after a failure
    writes the same. every: a pause such as "300 seconds"; without it, all that is there is read once.
    """

    def step(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/{number}")
        report(newest_state(changed.sparkSession, state, number, key, order), number)

    return follow_newest(stream, step, checkpoint, key, order, every)


def newest_state(spark: SparkSession, state: str, batch: int, key: str = "qid", order: str = "ord") -> DataFrame:
    """The newest record of each key as of a batch."""
    folders = [f"{state}/{n}" for n in range(batch + 1) if exists(spark, f"{state}/{n}/_SUCCESS")]
    return latest(spark.read.parquet(*folders), key, order)


def partial_counts(state: DataFrame, planned: DataFrame, key: str = "qid") -> DataFrame:
    """planned, observed, errors, complete: one row."""
    joined = planned.select(key).join(state.select(key, "status"), key, "left")
    return joined.agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("status") == "ok").alias("observed"), F.count_if(F.col("status") == "error").alias("errors")).withColumn("complete", F.col("planned") == F.col("observed"))
