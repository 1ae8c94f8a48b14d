"""Stratified subsets that don't depend on the order of their input, and the selections that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, salted_hash
from .ordering import rank_by_hash

#: The salt of the ranking and its seed, and the share that is taken.
SALT, SEED, SHARE = "av-agent-dev-v1", "42", 0.2


def quotas(rows: DataFrame, stratum: str = "task", share: float = SHARE) -> DataFrame:
    """stratum, n, quota: shares by largest remainder (ties by name); quotas add up to the rounded share of all rows."""
    groups = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # a row for each stratum
    exact = F.col("n").cast("double") * F.lit(share)
    sized = (
        groups.withColumn("base", F.floor(exact))
        .withColumn("rest", exact - F.floor(exact))
        .withColumn("missing", half_up(F.sum("n").over(everything), share) - F.sum("base").over(everything))
        .withColumn("place", F.row_number().over(everything.orderBy(F.desc("rest"), stratum)))
    )
    return sized.select(stratum, "n", (F.col("base") + (F.col("place") <= F.col("missing")).cast("int")).alias("quota"))


def stratified_split(rows: DataFrame, dataset: str, key: str = "qid", stratum: str = "task", share: float = SHARE) -> DataFrame:
    """All columns of the chosen rows, and rank (in the stratum, by salted hash); in order of rank, then stratum."""
    hashed = rows.withColumn("_digest", salted_hash(SALT, SEED, dataset, F.col(key).cast("string")))
    ranked = rank_by_hash(hashed, stratum, "_digest", tie=(key,))
    sizes = quotas(rows, stratum, share).select(F.col(stratum).alias("_stratum"), "quota")
    chosen = ranked.join(sizes, ranked[stratum].eqNullSafe(F.col("_stratum"))).where("rank <= quota")
    return chosen.select(*rows.columns, F.col("rank").cast("long").alias("rank")).orderBy("rank", stratum)


def remaining(rows: DataFrame, chosen: DataFrame, key: str = "qid") -> DataFrame:
    return rows.join(chosen.select(key), key, "left_anti")


def unfinished(rows: DataFrame, records: DataFrame, key: str = "qid") -> DataFrame:
    """Rows without a good record; a key with two good ones is an error."""
    good = records.where("status = 'ok'").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    done = good.select(F.when(F.col("n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("two good records of a key")).cast(good.schema[key].dataType)).alias(key))
    return rows.join(done, key, "left_anti")


def extremes(rows: DataFrame, size: str, key: str = "qid", by: str | None = None) -> DataFrame:
    """Keys and sizes of the smallest and the largest row (of each group), ties by key."""
    order = F.struct(size, key)
    known = rows.where(F.col(size).isNotNull())
    out = [F.min(order).alias("lo"), F.max(order).alias("hi")]
    found = known.groupBy(by).agg(*out) if by else known.agg(*out)
    return found.select(*([by] if by else []), F.col(f"lo.{key}").alias("shortest"), F.col(f"lo.{size}").alias("shortest_size"), F.col(f"hi.{key}").alias("longest"), F.col(f"hi.{size}").alias("longest_size"))


def in_given_order(rows: DataFrame, ids: list[str], key: str = "qid") -> DataFrame:
    """The rows of a short list of ids, in the list's order."""
    spark = rows.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in ids])).alias("pos", "_id"))
    return rows.join(F.broadcast(listed), F.col(key) == F.col("_id")).drop("_id").orderBy("pos")


def first_of_each(rows: DataFrame, group: str, order: str, key: str = "qid") -> DataFrame:
    """The key of each group's first row."""
    return rows.groupBy(group).agg(F.min_by(key, order).alias(key))


def selected_pilot(rows: DataFrame, order: str, extra: list[str], stratum: str = "task", key: str = "qid") -> DataFrame:
    """The first row of each stratum and the rows of some further ids, in input order."""
    ids = first_of_each(rows, stratum, order, key).select(key)
    if extra:
        ids = ids.union(rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in extra]))))
    return rows.join(ids.distinct(), key, "left_semi").orderBy(order)
