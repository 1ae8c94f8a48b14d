"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``vnodes`` points on a ring of 2^14 cells. A row hashes to a cell and belongs to the next
point clockwise. No shard may hold more than its capacity: ``n // shards`` rows, one more for the first
``n % shards`` shards. A shard with more rows than that keeps an evenly spaced part of them; the others go on
clockwise to the next points whose shards have room. Capacities add up to the row count, so counts differ by
one at most, and only overflowing rows leave the place that their hash gives them.

What decides is a table of counts for each cell (2^14 rows at any input size), so the ring walk is a matching of
two lists of intervals, overflow and room, in ring order; rows only learn their rank in a cell.

Nulls: a null text counts as empty, a null id hashes as an empty string. Equal rows (id, size and checksum) are
counted before the shuffle and spread out again at the end. An empty table gives an empty result. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash32, settle

CELL_BITS = 14
#: Copies of one row are written out in runs of this many.
RUN = 10_000


def ring_shards(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), moved (it left its home shard)."""
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    spark, cells = docs.sparkSession, 1 << CELL_BITS
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("h", hash32(F.col("doc_id")))
        .groupBy("h", "doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("cell", F.shiftright("h", 32 - CELL_BITS).cast("int"))
    )
    counts = rows.groupBy("cell").agg(F.sum("copies").alias("n"))

    # The ring: points and cells in order; a cell belongs to the first point at or after it.
    points = (
        spark.range(shards * vnodes)
        .select((F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).cast("int").alias("vnode"))
        .withColumn("ph", hash32(F.lit("point"), F.col("shard"), F.col("vnode")))
        .withColumn("cell", F.shiftright("ph", 32 - CELL_BITS).cast("int"))
    )
    spots = spark.range(cells).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    ring = (
        points.select("cell", F.lit(1).alias("kind"), "ph", "shard", "vnode", F.lit(0).cast("long").alias("n"))
        .unionByName(spots.select("cell", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ph"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("vnode"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))
        .withColumn("pos", F.row_number().over(Window.orderBy("cell", "kind", "ph", "shard", "vnode")))
    )
    whole, ahead = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("pos")
    ring = ring.withColumn("next", F.first("shard", True).over(ahead.rowsBetween(0, Window.unboundedFollowing))).withColumn("owner", F.coalesce("next", F.first_value("shard", True).over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))

    # Loads and capacities of the shards; before: rows of the shard in earlier cells.
    own = Window.partitionBy("owner")
    ring = (
        ring.withColumn("total", F.sum("n").over(whole))
        .withColumn("load", F.sum("n").over(own))
        .withColumn("cap", F.expr(f"total div {shards} + if(owner < total % {shards}, 1, 0)"))
        .withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("full", F.col("load") > F.col("cap"))
        .withColumn("kept_before", F.expr("if(full, before * cap div load, before)"))
        .withColumn("kept_after", F.expr("if(full, (before + n) * cap div load, before + n)"))
        .withColumn("over", F.expr("n - (kept_after - kept_before)"))
        .withColumn("room_from", F.expr(f"if(full or kind = 0, 0, (cap - load) * vnode div {vnodes})"))
        .withColumn("room", F.expr(f"if(full or kind = 0, 0, (cap - load) * (vnode + 1) div {vnodes} - room_from)"))
    )
    # Cut the ring where the least overflow is pending: from there on, nothing waits for a point behind it.
    so_far = ahead.rowsBetween(Window.unboundedPreceding, 0)
    ring = (
        ring.withColumn("over_sum", F.sum("over").over(so_far))
        .withColumn("room_sum", F.sum("room").over(so_far))
        .withColumn("moved_total", F.sum("over").over(whole))
        .withColumn("cut", F.min_by(F.struct("over_sum", "room_sum"), F.struct(F.col("over_sum") - F.col("room_sum"), "pos")).over(whole))
        .withColumn("q_over", F.expr("if(moved_total = 0, 0, pmod(over_sum - over - cut.over_sum, moved_total))"))
        .withColumn("q_room", F.expr("if(moved_total = 0, 0, pmod(room_sum - room - cut.room_sum, moved_total))"))
    )
    # At most 2^14 cells and the points, whatever the input: kept once, as three parts of the plan read it.
    ring = settle(ring.select("cell", "kind", "pos", "owner", "load", "cap", "full", "before", "kept_before", "over", "room", "room_from", "q_over", "q_room"))
    cell_info = ring.where("kind = 0").select("cell", F.col("owner").alias("home"), "load", "cap", "full", "before", "kept_before", "q_over")

    # Overflow and room as intervals over the same numbers: each start begins a stretch of one cell and one point.
    none = F.lit(None).cast("long")
    starts = ring.where("over > 0").select(F.col("q_over").alias("q"), F.col("cell").alias("at_cell"), none.cast("int").alias("to_shard"), none.alias("to_q"), none.alias("to_slot")).unionByName(
        ring.where("room > 0").select(F.col("q_room").alias("q"), none.cast("int").alias("at_cell"), F.col("owner").alias("to_shard"), F.col("q_room").alias("to_q"), (F.col("load") + F.col("room_from")).alias("to_slot"))
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy("q", F.col("to_shard").isNull())
    held = in_order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = (
        starts.select(
            F.col("q").alias("q_from"), F.lead("q").over(in_order).alias("q_to"),
            *[F.last(c, True).over(held).alias(c) for c in ("at_cell", "to_shard", "to_q", "to_slot")],
        )
        .where("q_to is null or q_to > q_from")
        .where("at_cell is not null and to_shard is not null")
    )

    in_cell = Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("first", F.coalesce(F.sum("copies").over(in_cell), F.lit(0)))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
        .withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, least(copies, (run + 1) * {RUN}) - 1)")))
        .join(cell_info, "cell")
        .withColumn("r", F.expr("before + first + copy"))
        .withColumn("kept_below", F.expr("if(full, r * cap div load, r)"))
        .withColumn("stays", F.expr("not full or (r + 1) * cap div load > kept_below"))
        .withColumn("q", F.expr("if(stays, null, q_over + (r - kept_below) - (before - kept_before))"))
    )
    fits = (F.col("cell") == F.col("at_cell")) & (F.col("q") >= F.col("q_from")) & (F.col("q_to").isNull() | (F.col("q") < F.col("q_to")))
    return placed.join(stretches, fits, "left").select(
        "doc_id", "size", "text_crc32",
        F.when(F.col("stays"), F.col("home")).otherwise(F.col("to_shard")).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("kept_below")).otherwise(F.expr("to_slot + q - to_q")).cast("long").alias("slot"),
        (~F.col("stays")).alias("moved"),
    )
