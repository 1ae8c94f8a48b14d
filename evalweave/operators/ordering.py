"""Ranks and running sums without putting a group, or all rows, into one task.

Rows are dealt to cells; a small table of the cells' totals gives each cell its start, and a window over the cell does
the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import settle


def rank_by_hash(df: DataFrame, group: str, digest: str, name: str = "rank", tie: tuple[str, ...] = ()) -> DataFrame:
    """Rank (from 1) in each group by a hexadecimal digest. Cells are the digests' first three digits."""
    celled = df.withColumn("_cell", F.substring(digest, 1, 3))
    cells = celled.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col(group).alias("_group"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_cell").orderBy(digest, *tie)
    ranked = celled.withColumn("_in", F.row_number().over(inside))
    same = ranked[group].eqNullSafe(F.col("_group")) & (F.col("_cell") == F.col("_at"))
    return ranked.join(starts, same).withColumn(name, F.col("_start") + F.col("_in")).drop("_cell", "_group", "_at", "_start", "_in")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in a total order of all rows: by ranges, then within a range."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    # A row for each range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(inside) for k in sums}).join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.col(f"_r_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])
