"""What a set of filters does in every order: sort-based duplicates and failure masks merged into additive counters.

Conditions of a document: A, B, C, D by its own text, and E: its text is also that of a document with a smaller id. For
E all rows are sorted by fingerprint (SHA-256) of the text, the text itself and doc_id: dealt by ranges of fingerprint
and id, so that a text that a third of all rows hold is split among tasks by id, and sorted within a task. Each row is
compared with its predecessor, and every run of equal texts knows the smallest id that its task has seen. Only a task's
first run may have begun in an earlier task: each task tells, for its first and its last run, the smallest id, and the
rows of first runs are judged by the smallest of those, a row or two for each task.

A document's failures make a mask of five bits. Masks are counted by part with how many are good and toxic (additive
counters: at most 32 for a part, combined before the shuffle), and every figure of every order follows from those.

Null or empty texts are empty texts: under 200 words, no repeats, no capitals, no marks, and equal to each other. Null
ids: such a row is a duplicate of nothing, and nothing is one of it. Rows that repeat an id aren't duplicates of each
other, as no id is smaller. A document is good (toxic) if any label row of its id says so; null ids have no labels. Null
parts are the empty string. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, task_batches

FILTERS = "ABCDE"
#: Bit of the filter that only the sort can tell.
DUPLICATE = 16


def own_failures(text: Column) -> Column:
    """The bits of A to D."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < 200, 1).otherwise(0)
        + F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * 50, 2).otherwise(0)
        + F.when((F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 2, 4).otherwise(0)
        + F.when(F.rlike(text, F.lit("[#$%&*|]")), 8).otherwise(0)
    ))[0]


def runs(rows: DataFrame) -> DataFrame:
    """From sorted rows (fingerprint, text, doc_id, part, mask): one row for each, without its text, and for each task its edges.

    kind 0: a row, with its part and mask, the mask with the duplicate's bit as far as the task can tell; edge: the
    fingerprint of the task's first run for rows of that run. kind 1: the first or last run's fingerprint and smallest id.
    """

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["kind", "doc_id", "part", "mask", "edge"]
        last_print = last_text = first_print = None
        least: int | None = None  # smallest id of the run so far, as far as ids are known
        edges: list[tuple[bytes, int | None]] = []
        for batch in task_batches(batches, "audit"):
            n = batch.num_rows
            if not n:
                continue
            prints, texts = batch.column("fingerprint"), batch.column("text")
            same = np.zeros(n, bool)
            if n > 1:
                same[1:] = pc.and_(pc.equal(prints.slice(1), prints.slice(0, n - 1)), pc.equal(texts.slice(1), texts.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            same[0] = last_print is not None and prints[0].as_py() == last_print and texts[0].as_py() == last_text
            ids = batch.column("doc_id").to_pylist()
            mask = batch.column("mask").to_numpy(zero_copy_only=False).copy()
            edge: list[bytes | None] = [None] * n
            for i in range(n):
                if not same[i]:
                    if last_print is not None and first_print is not None and len(edges) == 0:
                        edges.append((first_print, least))  # the first run has ended
                    least = None
                    last_print = prints[i].as_py()
                    if first_print is None:
                        first_print = last_print
                if ids[i] is not None:
                    if least is None:
                        least = ids[i]
                    elif ids[i] > least:
                        mask[i] |= DUPLICATE
                if not edges:
                    edge[i] = first_print
            last_text = texts[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), batch.column("part"), pa.array(mask, pa.int32()), pa.array(edge, pa.binary())], names=names)
        if last_print is not None:
            edges.append((last_print, least))
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(edges), pa.int32()), pa.array([e[1] for e in edges], pa.int64()), pa.nulls(len(edges), pa.string()), pa.array([0] * len(edges), pa.int32()), pa.array([e[0] for e in edges], pa.binary())], names=names)

    return rows.select("fingerprint", "text", "doc_id", "part", "mask").transform(map_arrow, compare, "kind int, doc_id long, part string, mask int, edge binary")


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask: bits 1, 2, 4, 8, 16 for failing A to E."""
    spark = docs.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("fingerprint"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    order = [F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(tasks, F.col("fingerprint").asc(), *order).sortWithinPartitions(F.col("fingerprint"), F.col("text"), *order)
    told = settle(runs(dealt.withColumn("mask", own_failures(F.col("text")))))
    starts = told.where("kind = 1").groupBy(F.col("edge").alias("run")).agg(F.min("doc_id").alias("least"))  # two rows a task at most
    found = told.where("kind = 0").join(F.broadcast(starts), F.col("edge") == F.col("run"), "left")
    again = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return found.select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part with just these failures."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """Every order and step, the step's filter as a bit and the bits of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    every = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, s, bit, before in steps()])
    # At most 32 masks a part, each in every step of every order.
    rows = counters(failure_masks(docs, part), labels).select("*", F.explode(every).alias("s")).select("part", F.col("mask").cast("int").alias("mask"), "n", "good", "toxic", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    orders = len(steps()) // len(FILTERS)
    total = lambda value, condition: F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")
    n = F.col("n")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(n, ~fails & ~earlier).alias("kept"),
        total(n, fails & ~earlier).alias("removed"),
        total(n, fails & earlier).alias("redundant"),
        total(n, F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(F.col("good"), fails & ~earlier).alias("good_lost"),
        total(F.col("toxic"), fails & ~earlier).alias("toxic_lost"),
        # Among the failures of a document each is first in an equal share of all orders.
        total(F.expr(f"n * ({orders} div bit_count(mask))"), fails).alias("shapley"),
    )
