"""Queries of logs that grow: appends of bytes, torn lines, keyed state over restarts, heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_queries import place
from .queries import LATEST_SQL, log, query, table
from .sources.growing_log import append_text, follow_lines, read_log
from .streaming.heartbeat import PROGRESS, Heartbeat, observed
from .streaming.keyed_state import follow_newest, state_table

EVENT = "event_id bigint, user_id bigint, event_type string, value double"


def rounds(rows: DataFrame) -> list[DataFrame]:
    """Three appends by four writers: the second ends in the middle of a line, which the third goes on with."""
    told = rows.select((F.col("user_id") % 4).alias("writer"), "event_id", (F.col("event_id") % 3).alias("round"), F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n")).alias("line"))
    torn = told.where("round = 2").groupBy("writer").agg(F.min_by("line", "event_id").alias("line"), F.min("event_id").alias("torn"))  # a row for each writer
    half = F.floor(F.length("line") / 2).cast("int")
    begun = torn.select("writer", F.lit(1 << 62).alias("seq"), F.substring("line", F.lit(1), half).alias("text"))
    ended = torn.select("writer", F.lit(-1).cast("long").alias("seq"), F.col("line").substr(half + 1, F.length("line")).alias("text"))
    whole = lambda k: told.where(F.col("round") == k).select("writer", F.col("event_id").alias("seq"), F.col("line").alias("text"))
    rest = told.where("round = 2").join(torn.select("torn"), F.col("event_id") == F.col("torn"), "left_anti").select("writer", F.col("event_id").alias("seq"), F.col("line").alias("text"))
    return [whole(0), whole(1).unionByName(begun), rest.unionByName(ended)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_id, user_id, event_type, value, event_id % 3 AS batch FROM events""")
def grown_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are appended to and followed by bytes: every line arrives once, in the round in which it became whole."""
    path, out, checkpoint = (place(spark, name) for name in ("grown", "arrived", "grown-checkpoint"))
    for k, some in enumerate(rounds(events(spark, sf_dir))):
        append_text(some, path)
        lines = follow_lines(spark, path, block=1 << 16).select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("r")).select("r.*", F.lit(k).cast("long").alias("batch"))
        lines.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 3 < 2""")
def torn_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose last line is half written, read by the bytes up to their last line feed."""
    path = place(spark, "torn")
    for some in rounds(events(spark, sf_dir))[:2]:
        append_text(some, path)
    return read_log(spark, [path], block=1 << 16).select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query(LATEST_SQL + "SELECT qid, ord, status, event_type, value FROM latest")
def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each key out of the state store, after a log grew three times and the query was started anew for each."""
    path, checkpoint = place(spark, "log"), place(spark, "keyed-checkpoint")
    for some in rounds(events(spark, sf_dir)):
        append_text(some, path)
        rows = follow_lines(spark, path).select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
        records = rows.select(F.col("user_id").alias("qid"), F.col("event_id").alias("ord"), status.alias("status"), "event_type", "value")
        follow_newest(records, lambda changed, number: changed.write.format("noop").mode("overwrite").save(), checkpoint).awaitTermination()
    return state_table(spark, checkpoint)


@query("""SELECT event_id % 3 AS round, count(*) AS seen, count_if(event_type <> 'error')::BIGINT AS good, count_if(event_type = 'error')::BIGINT AS bad, max(event_id) AS last_ord,
arg_max(user_id, event_id)::VARCHAR AS last_qid, arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END, event_id) AS last_status FROM events GROUP BY 1""")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listener kept of a query over three rounds of records."""
    path, checkpoint = place(spark, "beats"), place(spark, "beats-checkpoint")
    kept: list[tuple] = []
    listener = Heartbeat(kept.append)
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            log(spark, sf_dir).where(F.col("ord") % 3 == k).write.mode("append").parquet(path)
            stream = observed(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
            running = stream.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            running.awaitTermination()
            listener.wait(str(running.runId))
    finally:
        spark.streams.removeListener(listener)
    rows = spark.createDataFrame(kept, PROGRESS)
    return rows.select((F.col("last_ord") % 3).alias("round"), "seen", "good", "bad", "last_ord", "last_qid", "last_status")
