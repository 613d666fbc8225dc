"""Moments merged in a tree: many partial sums, and matrices cut into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import moments


def test_two_thousand_partials(spark):
    """Each partial is a task's sums; a task of the tree gets at most FAN blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3, 4)) * [1, 5, 0.1, 3] + [0, 100, -7, 2]
    rows = []
    for p, own in enumerate(x):
        mu = own.mean(0)
        m2 = (own - mu).T @ (own - mu)
        rows += [(0, i, j, p, 3, mu[i : i + 3].tobytes(), mu[j : j + 3].tobytes(), np.ascontiguousarray(m2[i : i + 3, j : j + 3]).tobytes()) for i in (0, 3) for j in (0, 3) if i <= j]
    parts = spark.createDataFrame(rows, moments.PARTIAL).repartition(7)
    widest = parts.groupBy("k", "i", "j", F.floor(F.col("part") / moments.FAN)).count().agg(F.max("count")).first()[0]
    assert widest == moments.FAN
    merged = moments.merge_tree(parts)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") >= 4  # 2000, 250, 32, 4, 1
    got = {(r.i, r.j): r for r in merged.collect()}
    assert len(got) == 3 and all(r.n == 6000 and r.part == 0 for r in got.values())
    flat = x.reshape(-1, 4)
    cov = np.cov(flat, rowvar=False)
    for (i, j), r in got.items():
        assert np.allclose(np.frombuffer(r.m2).reshape(len(r.mu_i) // 8, -1) / 5999, cov[i : i + 3, j : j + 3], rtol=1e-9)
        assert np.allclose(np.frombuffer(r.mu_i), flat.mean(0)[i : i + 3])


@pytest.mark.parametrize("size", [1, 4, 7, 256])
def test_blocks(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10)) + 50
    df = spark.createDataFrame([(r.tolist(), r[:2].tolist() if k % 3 else None) for k, r in enumerate(x)], "v array<double>, w array<double>").repartition(19)
    a, b = moments.summaries(df, "v", "w", size=size)
    assert a.n == 300 and b.n == 200
    assert np.allclose(a.mu, x.mean(0)) and np.allclose(a.sigma, np.cov(x, rowvar=False))
    some = x[[k % 3 > 0 for k in range(300)], :2]
    assert np.allclose(b.mu, some.mean(0)) and np.allclose(b.sigma, np.cov(some, rowvar=False))
    rows = moments.covariance(df, "v", size=size).collect()
    got = np.full((10, 10), np.nan)
    for r in rows:
        got[r.i, r.j] = r["cov"]
    assert len(rows) == 100 and np.allclose(got, a.sigma)


def test_odd_inputs(spark):
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    s = moments.summary(one, "v")
    assert s.n == 1 and np.isnan(s.sigma).all() and (s.mu == [1, 2]).all()
    with pytest.raises(ValueError):
        moments.summary(one.limit(0), "v")
    with pytest.raises(Exception, match="dimensions|reshape"):
        moments.summary(spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, 3.0],)], "v array<double>").repartition(3), "v")
