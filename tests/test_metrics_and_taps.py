"""Metrics of one pass, their log, removal after scoring, and models with several outputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import codec, metrics


def counted(spark, df):
    """df, and an accumulator of the rows that tasks have made of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_metrics_need_no_second_scan(spark, tmp_path):
    df, seen = counted(spark, spark.range(1000).withColumn("x", F.col("id") * 0.5))
    path, log = f"{tmp_path}/samples", f"{tmp_path}/log"
    got = metrics.write_scored(df, {"n": F.count("*"), "mean": F.avg("x"), "none": F.max(F.lit(None).cast("double"))}, path)
    assert got == {"n": 1000, "mean": 249.75, "none": None} and seen.value == 1000
    assert spark.read.parquet(path).count() == 1000
    with pytest.raises(ValueError):
        metrics.remove_scored(spark, path, log, 1)
    metrics.log_metrics(spark, log, 1, got)
    with pytest.raises(ValueError):
        metrics.remove_scored(spark, path, log, 2)
    assert os.path.exists(path)
    metrics.remove_scored(spark, path, log, 1)
    assert not os.path.exists(path)
    metrics.log_metrics(spark, log, 2, {"n": 5})
    assert sorted((r.step, r.name, r.value) for r in spark.read.parquet(log).collect() if r.value is not None) == [(1, "mean", 249.75), (1, "n", 1000.0), (2, "n", 5.0)]


def test_taps(spark):
    """Each batch goes through the model once, whatever the number of points."""
    calls, made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    weights = np.random.default_rng(1).normal(size=(4, 3))

    def make():
        made.add(1)

        def model(x):
            calls.add(len(x))
            h = np.maximum(x @ weights, 0)
            return {"first": h, "pooled": h.mean(1, keepdims=True), "in": x}

        return model

    rows = [(k, None if k == 7 else np.random.default_rng(k).normal(size=4).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = {r.id: r.taps for r in codec.taps(df, "two layers", make, ["first", "pooled"]).collect()}
    assert calls.value == 39 and 1 <= made.value <= 4
    for k, v in rows:
        if v is None:
            assert got[k].first is None and got[k].pooled is None
        else:
            h = np.maximum(np.array(v) @ weights, 0)
            assert np.allclose(got[k].first, h) and np.allclose(got[k].pooled, [h.mean()])
    with pytest.raises(Exception, match="no points"):
        codec.taps(df, "two layers more", make, ["last"]).collect()
    assert codec.taps(df.limit(0), "none", make, ["first"]).collect() == []
