"""Pieces shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of this machine only where all of Spark runs in one process (tests)."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="evalweave-")
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder; later reads start from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_hash(df: DataFrame, most: int) -> DataFrame:
    """The rows with the `most` smallest values of the 64-bit hash h, one row for each value.

    A bound on h that lets about twice as many through comes first, so that tasks sort and send few rows; if too few
    different values are below it (rows that repeat), it isn't used. The result is the same either way.
    """
    total = df.count()
    if total > 4 * most:
        low = df.where(F.col("h") < int(2 * most / total * 2**64) - 2**63).dropDuplicates(["h"])
        if low.count() >= most:
            return low.orderBy("h").limit(most)
    return df.dropDuplicates(["h"]).orderBy("h").limit(most)


def crc_of_id(c: Column) -> Column:
    """crc32 of an id written in decimal; a null id counts as an empty string."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hash32(*parts: Column) -> Column:
    """The first 32 bits of an MD5 digest as a long from 0 to 2^32 - 1."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


#: What may be kept in a Python worker between tasks, by operator, and how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    _KEPT[operator] = drop


def tidy(operator: str = "") -> None:
    """Start of a task: lets go of what other operators left in this worker, and has Arrow take memory where trim() gives it back."""
    import gc

    import pyarrow as pa

    quiet_threads()
    pa.set_memory_pool(pa.system_memory_pool())
    for other, drop in _KEPT.items():
        if other != operator:
            drop()
    gc.collect()
    trim()


def task_batches(batches: Iterator, operator: str, rows: int = 1024) -> Iterator:
    """A task's Arrow batches in slices, once what other operators left in this worker is gone."""
    tidy(operator)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    trim()


def trim() -> None:
    """Gives free memory back to the system; glibc does so only when asked."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run here remove their shuffle files when they end, and not when the driver's heap is full."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_arrow(df: DataFrame, task: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with batches of at most 1,024 rows, unless the session asks for another number: texts are long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1024")
    return df.mapInArrow(task, schema)


def quiet_threads() -> None:
    """One thread for each Python worker: the task slots are the parallelism."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
