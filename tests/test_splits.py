"""Operators that split what others hold in one task: the bootstrap's draws, a key's records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import twister
from evalweave.operators import bootstrap, records


@pytest.mark.parametrize("n", [0, 1, 311, 312, 624, 5000, 123_457])
def test_jumps_land_where_drawing_does(n):
    plain = twister.seeded(42)
    plain.random_sample(n)
    assert (twister.at_place(42, n).random_sample(1500) == plain.random_sample(1500)).all()


def plain_interval(difference, n):
    """One repeat after the other."""
    source = np.random.RandomState([42])
    shares = []
    for _ in range(bootstrap.REPEATS):
        picked = [int(source.random_sample() * len(n)) for _ in range(len(n))]
        shares.append(100 * int(difference[picked].sum()) / int(n[picked].sum()))
    shares.sort()
    return shares[bootstrap.LOW], shares[bootstrap.HIGH]


def test_bootstrap_over_tasks_and_chunks(spark, monkeypatch):
    """Chunks smaller than a group, tasks of uneven repeats, groups of several sizes, orders of any kind."""
    monkeypatch.setattr(bootstrap, "CHUNK", 16)
    monkeypatch.setattr(bootstrap, "TASK_REPEATS", 300)
    source = np.random.default_rng(2)
    rows, want = [], {}
    for group, size in (("a", 1), ("b", 16), ("c", 45), (None, 7)):
        difference, n = source.integers(-3, 4, size), source.integers(1, 9, size)
        rows += [(group, int(d), int(k), (0, 100 - size, i)) for i, (d, k) in enumerate(zip(difference, n, strict=True))]
        want[group] = (*plain_interval(difference, n), size)
    source.shuffle(rows)
    df = spark.createDataFrame([(g if g is None else str(g), int(d), int(k), tuple(map(int, o))) for g, d, k, o in rows], "contrast string, difference long, n long, first_ord struct<file:int,block:bigint,line:bigint>")
    got = {r["contrast"]: (r["low"], r["high"], r["clusters"]) for r in bootstrap.bootstrap_interval(df, ["contrast"]).collect()}
    assert got == want
    one = bootstrap.bootstrap_interval(df.where("contrast = 'c'").drop("contrast")).first()
    assert (one["low"], one["high"]) == want["c"][:2] and one["bootstrap_repeats"] == 2000
    assert bootstrap.bootstrap_interval(df.where("false").drop("contrast")).collect() == []


def test_previous_record_of_a_hot_key(spark):
    """One key with nearly all rows is in every range; the value is carried over the ranges' ends."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 1000 == 7, F.lit(None)).when(F.col("id") % 500 == 3, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("hot").alias("qid"), (F.col("id") * 7919 % 100_003).alias("ord"), F.concat(F.lit("s"), F.col("id")).alias("status"))
    got = records.with_previous(rows)
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: r["ord"]):
        by_key.setdefault(r["qid"], []).append(r["status"])
    before = {s: p for states in by_key.values() for s, p in zip(states, [None, *states[:-1]], strict=True)}
    found = got.collect()
    assert len(found) == 100_000 and all(r["previous_status"] == before[r["status"]] for r in found)
    parts = rows.repartitionByRange(4, "qid", "ord").withColumn("p", F.spark_partition_id()).where("qid = 'hot'").select("p").distinct().count()
    assert parts == 4
    assert records.with_previous(rows.where("false")).collect() == []
