"""Stacked arrays read back, and permutations of row numbers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import permute
from vectide.sources import stacked


def test_stacked_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(53, 6)).astype("f4")
    df = spark.createDataFrame([(int(k) * 10 - 100, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)
    path = f"{tmp_path}/s"
    stacked.write_stacked(df, path, "id", "v", shape=(2, 3), dtype="float32", rows=10)
    shards = spark.read.parquet(path).orderBy("shard").collect()
    assert [(r.shard, r.first, r.n) for r in shards] == [(k, 10 * k, min(10, 53 - 10 * k)) for k in range(6)]
    got = {r.place: r.x for r in stacked.read_stacked(spark, path).collect()}
    assert sorted(got) == list(range(53)) and all((np.array(got[k], "f4") == x[k]).all() for k in got)
    assert stacked.stacked(df.limit(0), "id", "v").count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(k, [1.0] * (3 if k == 40 else 2)) for k in range(50)], "id long, v array<double>")
    path = f"{tmp_path}/bad"
    with pytest.raises(Exception, match="different sizes"):
        stacked.write_stacked(df, path, "id", "v", rows=8)
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f.startswith("part")]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 65537])
def test_permutations(n):
    x = np.arange(n)
    seen = set()
    for seed in (0, 1, -5, 2**40):
        p = permute.permuted(x, n, seed)
        assert (np.sort(p) == x).all() and (permute.permuted(p, n, seed, back=True) == x).all()
        seen.add(p.tobytes())
    assert n < 10 or len(seen) == 4


def test_permutation_mixes():
    p = permute.permuted(np.arange(100_000), 100_000, 3)
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02 and abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.02
    assert len(permute.permuted(np.arange(0), 0, 3)) == 0


def test_resumed_epoch(spark):
    rows = spark.range(103).repartition(3)
    whole = {(r.batch, r.slot): r.id for r in permute.shuffled_batches(rows, "id", 103, 5, 10).collect()}
    assert set(whole) == {(b, s) for b in range(10) for s in range(10)} and len(set(whole.values())) == 100
    rest = {(r.batch, r.slot): r.id for r in permute.shuffled_batches(rows, "id", 103, 5, 10, done=4).collect()}
    assert rest == {k: v for k, v in whole.items() if k[0] >= 4}
    last = permute.shuffled_batches(rows, "id", 103, 5, 10, drop_last=False)
    assert last.count() == 103 and last.where(F.col("batch") == 10).count() == 3
