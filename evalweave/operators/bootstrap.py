"""Cluster bootstrap of a paired difference, seeded, with fixed order statistics, over many tasks.

A repeat takes as many clusters as there are, each by the next number of the seeded Mersenne twister, in order of the
clusters' first appearance. Repeats are dealt to tasks in blocks; a task sets the twister to the place where its first
repeat begins. What a repeat draws becomes counts by cluster, cut into chunks of clusters; a chunk's counts meet its
clusters in one group of bounded size, and the sums of a repeat's chunks make its share. Nothing holds all clusters of all
repeats, and the result is that of drawing one repeat after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.twister import at_place, seeded
from .ordering import running_sums

#: Repeats, seed, and which of the sorted draws bound the interval.
REPEATS, SEED, LOW, HIGH = 2000, 42, 49, 1949
#: Repeats of a task, clusters of a chunk, and numbers drawn at a time.
TASK_REPEATS, CHUNK, BLOCK = 125, 8192, 1 << 20


def drawn(source: np.random.RandomState, size: int) -> np.ndarray:
    """How often each of `size` clusters is drawn by the next `size` numbers."""
    counts = np.zeros(size, np.int32)
    for start in range(0, size, BLOCK):
        picked = (source.random_sample(min(BLOCK, size - start)) * size).astype(np.int64)
        if size <= BLOCK:
            return np.bincount(picked, minlength=size).astype(np.int32)
        np.add.at(counts, picked, 1)
    return counts


def draw_interval(difference: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The plain way for a few clusters in order: bounds of 100 * sum of differences / sum of rows."""
    source = seeded(SEED)
    counts = np.array([drawn(source, len(n)) for _ in range(REPEATS)], np.int64)
    low, high = np.partition(100 * (counts @ difference) / (counts @ n), (LOW, HIGH))[[LOW, HIGH]].tolist()
    return low, high


def packed(counts: np.ndarray) -> bytes:
    """One byte a cluster unless one is drawn more often than that can say."""
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else "<i4").tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == size else "<i4").astype(np.int64)


def draws(sizes: DataFrame) -> DataFrame:
    """group, chunk, repeat, counts for every group's size (clusters)."""

    def draw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for group, size, block in zip(*(batch.column(c).to_pylist() for c in ("group", "clusters", "block")), strict=True):
                first = block * TASK_REPEATS
                source = at_place(SEED, first * size)
                for repeat in range(first, min(first + TASK_REPEATS, REPEATS)):
                    counts = drawn(source, size)
                    chunks = range(-(-size // CHUNK))
                    parts = [packed(counts[k * CHUNK : (k + 1) * CHUNK]) for k in chunks]
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(parts)), pa.array(chunks, pa.int64()), pa.array([repeat] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["group", "chunk", "repeat", "counts"])

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-REPEATS // TASK_REPEATS) - 1))).alias("block")
    asked = sizes.select("group", "clusters", blocks)
    spread = asked.repartition(-(-REPEATS // TASK_REPEATS), "group", "block")
    return spread.mapInArrow(draw, "group long, chunk long, repeat int, counts binary")


def chunk_sums(clusters: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    """The sums of one chunk of clusters for every repeat."""
    clusters = clusters.sort_values("place")
    values = clusters[["difference", "n"]].to_numpy(np.int64)
    sums = np.array([unpacked(c, len(values)) @ values for c in repeats["counts"]], np.int64).reshape(-1, 2)
    return pd.DataFrame({"group": repeats["group"], "repeat": repeats["repeat"], "difference": sums[:, 0], "n": sums[:, 1]})


def bootstrap_interval(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """partials: (keys,) difference, n, first_ord: a row for each cluster. low, high, clusters, bootstrap_repeats (by keys)."""
    keys = keys or []
    ranked = running_sums(partials.select(*keys, "difference", "n", "first_ord"), [*keys, "first_ord"], {"_rank": F.lit(1).cast("long")})
    # A group is named by the rank of its first cluster.
    groups = ranked.groupBy(*keys).agg(F.min("_rank").alias("group"), F.count(F.lit(1)).alias("clusters")).where("clusters > 0")
    same = [ranked[k].eqNullSafe(groups[k]) for k in keys]
    placed = (ranked.join(groups, same) if keys else ranked.crossJoin(F.broadcast(groups))).select(  # without keys one row
        "group", (F.col("_rank") - F.col("group")).alias("place"), F.col("difference").cast("long").alias("difference"), F.col("n").cast("long").alias("n")
    )
    chunked = placed.withColumn("chunk", F.expr(f"place div {CHUNK}"))
    sums = chunked.groupBy("group", "chunk").cogroup(draws(groups).groupBy("group", "chunk")).applyInPandas(chunk_sums, "group long, repeat int, difference long, n long")
    shares = sums.groupBy("group", "repeat").agg((F.sum("difference") * 100 / F.sum("n")).alias("share"))
    bounds = shares.groupBy("group").agg(F.sort_array(F.collect_list("share")).alias("sorted"))  # REPEATS values
    out = groups.join(bounds, "group")
    return out.select(*keys, F.get("sorted", F.lit(LOW)).alias("low"), F.get("sorted", F.lit(HIGH)).alias("high"), "clusters", F.lit(REPEATS).alias("bootstrap_repeats"))
