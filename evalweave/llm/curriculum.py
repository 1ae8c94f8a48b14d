"""Time-varying curriculum over sources, in DataFrame operations only.

Targets. Source k (by code point, null last) weighs 5, 2, 1, 5, 2, 1, ...; the mix asks for ``budget`` times all
words. A source gives at most ``repeats`` times its words; what is above is shared again by weight. That fixed
point is one level L with target = min(weight * L, repeats * words), found from running sums over the sources
sorted by repeats * words / weight.

Documents. A source's documents lie one after another in hash order, and once more for each repeat, on an axis of
its words. A copy is taken, whole, if its middle lies below the target, so a source's taken words miss its target by
half a document at most and no document is taken more than ``repeats`` times.

Time. A source's weight changes linearly over the training, w(t) = 1 + slope * (2t - 1), integral one; sources
fade out and in by turns, so that the mix moves from odd to even sources. The words asked for until t are
target * (t + slope * (t^2 - t)); solving this for the copy's middle gives its position in the training, and the
documents are sorted by position over ranges.

Running sums go over 2^10 hash cells of each source first, then over the rows of a cell: no task holds a source.
A null text has no words; ties of hashes go by id and size; a source without words has target 0; equal rows are counted before they are shuffled
and written out again. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash32, settle

CELL_BITS = 10
RUN = 10_000
SLOPE = 0.5


def source_targets(sums: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """From source, source_size: rank (from 0), weight and target of each source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy("fills_at", "rank")
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sums.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * repeats)
        .withColumn("fills_at", F.col("most").cast("double") / F.col("weight"))
        .withColumn("asked", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("filled", F.coalesce(F.sum("most").over(below), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("asked") - F.col("filled")) / F.col("open_weight"))
        # The first source, in order of filling, that this level doesn't fill sets the level of all.
        .withColumn("final", F.min_by(F.when(F.col("level") < F.col("fills_at"), F.col("level")), F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "rank"))).over(everything))
    )
    target = F.when(F.col("final").isNull() | (F.col("fills_at") <= F.col("final")), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return ranked.select("source", "rank", "weight", "source_size", target.alias("target"))


def curriculum(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position (first, 0 to 1; null if not taken), positions."""
    rows = (
        docs.select("doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), hash32(F.col("doc_id")).alias("h"))
        .groupBy("source", "h", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("cell", F.shiftright("h", 32 - CELL_BITS).cast("int"))
    )
    # A row for each source and cell, whatever the input.
    cells = settle(rows.groupBy("source", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("words")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, repeats)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_from", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(F.col("c.source").alias("of_source"), F.col("c.cell").alias("of_cell"), "cell_from", "rank", "source_size", "target")

    in_cell = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        rows.withColumn("row_from", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_cell), F.lit(0)))
        .join(starts, F.expr("source <=> of_source and cell = of_cell"))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
        .withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, least(copies, (run + 1) * {RUN}) - 1)")))
        .withColumn("middle", F.col("cell_from") + F.col("row_from") + F.col("copy") * F.col("size") + F.col("size") / F.lit(2.0))
    )
    slope = F.when(F.col("rank") % 2 == 0, F.lit(-SLOPE)).otherwise(F.lit(SLOPE))
    asked = [(F.col("middle") + F.lit(k) * F.col("source_size")) for k in range(repeats)]

    def at(done):  # t with t + slope * (t^2 - t) = done
        one = F.lit(1.0) - slope
        return (F.sqrt(one * one + F.lit(4.0) * slope * done) - one) / (F.lit(2.0) * slope)

    positions = F.array_compact(F.array(*[F.when((F.col("size") > 0) & (m < F.col("target")), at(m / F.col("target"))) for m in asked]))
    placed = laid.withColumn("positions", positions).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        F.get("positions", F.lit(0)).alias("position"), "positions",
    )
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(n, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
