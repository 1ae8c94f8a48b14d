import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import numeric


def column(spark, rows, schema, c):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def test_rounding_is_exact(spark):
    source = random.Random(0)
    xs = [1.0005, 2.0005, 0.0005, 2.675, 1e20, -1.0015, *[round(source.uniform(0, 4000), 4) + 0.0005 for _ in range(500)]]
    assert column(spark, [(x,) for x in xs], "x double", numeric.round_decimals(F.col("x"), 3)) == [round(x, 3) for x in xs]
    assert column(spark, [(x,) for x in xs[:200]], "x double", numeric.fixed3(F.col("x"))) == [f"{x:.3f}" for x in xs[:200]]


def test_windows_stay_inside(spark):
    grid = [(float(c), float(d)) for d in (4, 12, 65, 3600) for c in (0, d / 2, d)]
    for (c, d), w in zip(grid, column(spark, grid, "c double, d double", numeric.window_interval(F.col("c"), F.col("d")))):
        assert 0 <= w["start"] and w["end"] <= d and w["end"] - w["start"] <= 12.001
    with pytest.raises(Exception, match="finite and positive"):
        column(spark, [(1.0, 0.0)], "c double, d double", numeric.window_interval(F.col("c"), F.col("d")))


def test_frames_and_snippets(spark):
    cases = [(d, t) for d in (0.5, 1.9, 7.3, 100.0) for t in (2, 3, 7, 31, 500, 99999)]
    counts = column(spark, cases, "d double, t long", numeric.frame_count(F.col("d"), F.col("t")))
    assert counts == [int(min(max(d * 2, 4), 32, t)) // 2 * 2 for d, t in cases]
    pairs = [(n, t) for n in range(2, 33, 2) for t in (n, n + 1, 100, 12345)]
    assert column(spark, pairs, "n int, t long", numeric.frame_indices(F.col("n"), F.col("t"))) == [np.rint(np.linspace(0, t - 1, n)).astype(int).tolist() for n, t in pairs]
    got = column(spark, [(s,) for s in (1.0, 2.0, 31.5)], "s double", numeric.snippet_starts(F.col("s")))
    assert np.allclose(got, [np.linspace(0, max(0, s - 2), 8) for s in (1.0, 2.0, 31.5)])
    assert column(spark, [(1.0,), (40.0,)], "s double", numeric.snippet_seconds(F.col("s"))) == [8.0, 16.0]


def test_resize_plan(spark):
    def plan(h, w, f=28, lo=128 * 784, hi=768 * 784):
        a, b = (max(f, round(x / f) * f) for x in (h, w))
        if a * b > hi:
            s = math.sqrt(h * w / hi)
            return max(f, math.floor(h / s / f) * f), max(f, math.floor(w / s / f) * f)
        if a * b < lo:
            s = math.sqrt(lo / (h * w))
            return math.ceil(h * s / f) * f, math.ceil(w * s / f) * f
        return a, b

    sizes = [(h, w) for h in (20, 42, 360, 720, 2160) for w in (20, 70, 640, 1280, 4000)]
    assert [tuple(r) for r in column(spark, sizes, "h int, w int", numeric.resize_plan(F.col("h"), F.col("w")))] == [plan(h, w) for h, w in sizes]


def test_hashes_and_ratios(spark):
    keys = [("k1",), ("k2",), ("",)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert column(spark, keys, "k string", numeric.hash_parity(F.col("k"))) == [int(sha(k), 16) % 2 for (k,) in keys]
    assert column(spark, keys, "k string", numeric.salted_hash("s", "42", F.col("k"))) == [sha(f"s|42|{k}") for (k,) in keys]
    assert column(spark, [(1, 3), (1, 0)], "a int, b int", numeric.percent(F.col("a"), F.col("b"))) == [100 / 3, None]
    with pytest.raises(Exception):
        column(spark, [(1, 0)], "a int, b int", numeric.percent_required(F.col("a"), F.col("b")))
    assert column(spark, [("b",), (" D ",), ("E",)], "l string", numeric.option_of_letter(F.array(*map(F.lit, "wxyz")), F.col("l"))) == ["x", "z", None]
    assert column(spark, [(float("nan"),), (float("inf"),), (1.0,)], "x double", numeric.is_finite(F.col("x"))) == [False, False, True]
