"""Prefix scans of affine maps against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import scan
from vectide.operators.running import lerp, lerp_fold


def plain(rows, start=(0.5, 1.0)):
    """State after each row, of rows (key, place, a, b) with a second state of maps (0.5, b)."""
    out, state = {}, {}
    for key, place, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        x, y = state.get(key, start)
        x = x if a is None or b is None else a * x + b
        y = y if b is None else 0.5 * y + b
        state[key] = x, y
        out[key, place] = x, y
    return out, state


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "key string, place long, a double, b double").repartition(parts)


def states():
    return {"x": (F.col("a"), F.col("b"), 0.5), "y": (F.lit(0.5), F.col("b"), 1.0)}


@pytest.mark.parametrize("fan", [2, 64])
def test_fold_and_scan(spark, fan):
    rnd = random.Random(fan)
    rows = [(rnd.choice(["hot"] * 8 + ["b", None, "", "one"]), k * 7 - 900, rnd.choice([None, 0.0, -1.0, 0.9, 1.01]), rnd.choice([None, 1.0, -2.5])) for k in range(600)] + [("single", 3, 0.5, 2.0), ("single null", None, 1.0, 1.0), ("b", None, 0.0, 7.0)]
    every, last = plain(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.key: (r.x, r.y) for r in scan.affine_fold(frame(spark, rows, 5), ["key"], "place", states(), fan=fan).collect()}
        trace = scan.affine_scan(frame(spark, rows, 5), ["key"], "place", states(), fan=fan).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(got) == set(last) and all(np.allclose(got[k], last[k], rtol=1e-9) for k in last)
    assert len(trace) == len(rows) and all(np.allclose((r.x, r.y), every[r.key, r.place], rtol=1e-9) for r in trace)


def test_one_key_of_a_million_batches(spark):
    """The only key's rows are spread over tasks, and no window takes a key whole."""
    n, w = 1_000_000, 0.001
    df = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("place"), F.sin("id").alias("x"))
    out = lerp_fold(df, ["key"], "place", F.col("x"), w, 2.0, "v")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    weights = w * (1 - w) ** np.arange(n - 1, -1, -1.0)
    assert out.first().v == pytest.approx(float(weights @ np.sin(np.arange(n)) + 2.0 * (1 - w) ** n), rel=1e-9)
    runs = scan._sorted(df, ["key"], "place", {"v": lerp(F.col("x"), w, 2.0)}).mapInArrow(lambda b: scan._runs(b, ["key"], 1), "key int, run long, a0 double, b0 double")
    assert runs.count() > 1


def test_several_keys_and_empty(spark):
    rows = spark.createDataFrame([(1, "a", 1, 3.0), (1, "b", 1, 4.0), (1, "a", 2, 5.0)], "k int, l string, place int, x double")
    got = {(r.k, r.l): r.v for r in lerp_fold(rows, ["k", "l"], "place", F.col("x"), 0.5, 0.0, "v").collect()}
    assert got == {(1, "a"): 3.25, (1, "b"): 2.0}
    assert lerp_fold(rows.limit(0), ["k", "l"], "place", F.col("x"), 0.5, 0.0, "v").collect() == []
    assert scan.affine_scan(rows.limit(0), ["k"], "place", {"v": lerp(F.col("x"), 0.5, 0.0)}).collect() == []


def test_array_operations():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 50):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
        starts = np.unique(np.append(0, rng.integers(0, n, 3)))
        got_a, got_b = scan.composed(a.copy(), b.copy(), starts)
        all_a, all_b = scan.scanned(a.copy(), b.copy(), starts)
        for r, s in enumerate(starts):
            e = [*starts[1:], n][r]
            x = np.array([0.3, -2.0])
            v = x
            for k in range(s, e):
                v = a[k] * v + b[k]
                assert np.allclose(all_a[k] * x + all_b[k], v)
            assert np.allclose(got_a[r] * x + got_b[r], v)
