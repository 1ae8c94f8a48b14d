"""Keeping an intermediate table, and the shared folder for it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where all of Spark runs in one process (tests)."""
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
    """Computes df once; what reads the result starts from the shared folder, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
