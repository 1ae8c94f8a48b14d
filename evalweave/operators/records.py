"""Which record of a key counts, and what a log says about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_sums
from .staging import settle


def latest(records: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """The last record of each key, all columns. Aggregates before it shuffles, so a hot key does no harm."""
    columns = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*").select(*records.columns)


def followed(records: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """key, first_good, last, broken: whether any record of a key follows a good one."""
    state = records.groupBy(key).agg(F.min(F.when(F.col("status") == "ok", F.col(order))).alias("first_good"), F.max(order).alias("last"))
    return state.withColumn("broken", F.coalesce(F.col("first_good") != F.col("last"), F.lit(False)))


def latest_strict(records: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """The same; an error if any record follows a good one."""
    fine = F.when(~F.col("broken"), F.col(key)).otherwise(F.raise_error(F.lit("a record follows a good one")).cast(records.schema[key].dataType))
    return latest(records, key, order).join(followed(records, key, order).select(fine.alias(key)), key)


def with_previous(records: DataFrame, column: str = "status", key: str = "qid", order: str = "ord") -> DataFrame:
    """The value of the record before, in each key.

    Rows are dealt by ranges of key and order, so a key that holds most of them is split; a range's first row takes what
    the range before ends with. Orders differ within a key. Null keys are one key.
    """
    n = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(records.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(key, order)
    mine = F.struct(F.col(key).alias("key"), F.col(column).alias("value"))
    # A row for each range.
    ends = dealt.groupBy("_part").agg(F.max_by(mine, F.struct(key, order)).alias("_end"))
    before = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_before"))
    found = dealt.withColumn("_last", F.lag(mine).over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(F.broadcast(before), "_part")
    last = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_last"))
    return found.withColumn(f"previous_{column}", F.when(last["key"].eqNullSafe(F.col(key)), last["value"])).select(*records.columns, f"previous_{column}")


def running_errors(records: DataFrame, wrong, order: list[str]) -> DataFrame:
    """Rows with wrong and seen counts and the rate of wrong ones so far, in order over all rows."""
    summed = running_sums(records, order, {"wrong_so_far": wrong.cast("long"), "seen_so_far": F.lit(1).cast("long")})
    return summed.withColumn("error_rate", F.col("wrong_so_far") / F.col("seen_so_far"))


def progress(rows: DataFrame, records: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """completed, total, last_qid, last_status: one row."""
    done = records.agg(F.count_distinct(F.when(F.col("status") == "ok", F.col(key))).alias("completed"), F.max_by(key, order).alias("last_qid"), F.max_by("status", order).alias("last_status"))
    return done.crossJoin(rows.agg(F.count(F.lit(1)).alias("total"))).select("completed", "total", "last_qid", "last_status")
