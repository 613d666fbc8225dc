"""Similarity joins by grid and with pruned tiles against NumPy, and how much pruning leaves out."""

import numpy as np
import pyarrow as pa
import pytest

from vectide.operators import simjoin


def frame(spark, x, parts=5):
    return spark.createDataFrame([(k, v.tolist(), k % 4) for k, v in enumerate(x)], "vec_id long, v array<double>, label long").repartition(parts)


@pytest.fixture(scope="module")
def clustered():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(40, 8))[rnd.integers(0, 40, 3000)] * 5 + rnd.normal(size=(3000, 8)) * 0.05
    x[50:60] = x[0]  # ties
    x[70] = 0
    x[71] = 1e-9 * x[1]
    return x


def expected(x, ids, metric, k, own, by_class):
    c = simjoin.costs(x, x[ids], metric)
    label = np.arange(len(x)) % 4
    out = {}
    for j, q in enumerate(ids):
        gap = np.abs(label - label[q]) if by_class else np.zeros(len(x), int)
        order = [r for r in np.lexsort([np.arange(len(x)), c[:, j], gap]) if not own or r != q][:k]
        out[q] = [(gap[r], c[r, j]) for r in order]
    return out


@pytest.mark.parametrize("metric, by_class, own, broadcast", [("cosine", False, True, 0), ("cosine", True, True, 32_000_000), ("l2", False, False, 32_000_000), ("unit_cosine", True, False, 0)])
def test_pruned_top_k(spark, clustered, metric, by_class, own, broadcast):
    df = frame(spark, clustered)
    ids = np.arange(0, 3000, 7)
    got = simjoin.similarity_join(df, df.where("vec_id % 7 = 0"), metric, class_col="label" if by_class else None, k=6, exclude_self=own, prune=True, block=100, tile=64, broadcast=broadcast).collect()
    rows = {}
    for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
        rows.setdefault(r.qid, []).append((abs(r.qid % 4 - r.rid % 4) if by_class else 0, r.cost))
    want = expected(clustered, ids, metric, 6, own, by_class)
    assert set(rows) == set(want)
    for q in want:
        assert [g for g, _ in rows[q]] == [g for g, _ in want[q]] and np.allclose([c for _, c in rows[q]], [c for _, c in want[q]], atol=1e-9)


@pytest.mark.parametrize("metric, within", [("cosine", -0.9), ("l2", 1.0), ("unit_cosine", 0.0)])
@pytest.mark.parametrize("prune", [True, False])
def test_threshold_join(spark, clustered, metric, within, prune):
    df = frame(spark, clustered)
    got = simjoin.similarity_join(df, df.where("vec_id % 50 = 0"), metric, within=within, prune=prune, tile=64, broadcast=0).collect()
    c = simjoin.costs(clustered, clustered[::50], metric)
    r, q = np.nonzero(c <= within)
    assert sorted((x.qid, x.rid) for x in got) == sorted(zip((q * 50).tolist(), r.tolist()))
    assert all(np.isclose(c[x.rid, x.qid // 50], x.cost) for x in got)


def test_share_of_tiles(spark, clustered):
    """Clusters let most tiles be skipped; classes too; a threshold of everything skips none."""
    df = frame(spark, clustered)
    blocks, tiles = simjoin.tile_sides(df, df.where("vec_id % 50 = 0"), "l2", prune=True, block=16, tile=64)
    pairs = blocks.count() * tiles.count()
    assert simjoin.needed_pairs(blocks, tiles, "l2", False, 5, None).count() < 0.3 * pairs
    assert simjoin.needed_pairs(blocks, tiles, "l2", False, None, 0.5).count() < 0.3 * pairs
    assert simjoin.needed_pairs(blocks, tiles, "l2", False, None, 1e9).count() == pairs
    blocks, tiles = simjoin.tile_sides(df, df.where("vec_id % 50 = 0"), "l2", class_col="label", prune=True, block=16, tile=64)
    assert simjoin.needed_pairs(blocks, tiles, "l2", True, 5, None).count() < 0.3 * blocks.count() * tiles.count()


def test_plan_is_independent_of_queries(spark, clustered):
    df = frame(spark, clustered)
    size = lambda q: len(simjoin.similarity_join(df, q, k=3, block=10, broadcast=0)._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(df.where("vec_id < 20")) == size(df)


def sent_to_python(df):
    """Bytes that the last Python step of a plan has read, after a run of it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan()
    while not plan.metrics().contains("pythonDataSent"):
        plan = plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else plan.children().head()
    return plan.metrics().get("pythonDataSent").get().value()


@pytest.mark.parametrize("k", [None, 3])
def test_what_reaches_python_grows_with_the_input(spark, clustered, k):
    """Not with the product of both sides: rows are sent to a worker once a cell, not once a pair of a block and a tile."""
    sent = []
    for n in (1000, 2000):
        df = frame(spark, clustered[:n])
        sent.append(sent_to_python(simjoin.similarity_join(df, df.where("vec_id % 2 = 0"), "unit_cosine", k=k, block=25, tile=25)))
    assert sent[1] < 2.5 * sent[0]


@pytest.mark.parametrize("prune", [True, False])
def test_pairs_at_once(spark, prune):
    """Blocks and tiles, and cells, of 1024 rows each give their pairs in lots of 2**17 at most, all of them."""
    rnd = np.random.default_rng(8)
    ids, x, of = np.arange(1024), rnd.normal(size=(1024, 8)), np.zeros(1024, "i8")
    if prune:
        data = simjoin._store(ids, of, x)
        got = list(simjoin._compared([pa.table({"b_no": [0], "b_data": [data], "data": [data]}).to_batches()[0]], "l2", False, None, 1e9, False))
    else:
        side = np.repeat(np.int32([0, 1]), 1024)
        t = pa.table({"id": np.tile(ids, 2), "v": pa.array(np.tile(x, (2, 1)).tolist()), "of": np.tile(of, 2), "q": side * 0, "r": side * 0, "side": side})
        got = list(simjoin._passed(t.to_batches(max_chunksize=700), "l2", False, None, None, False))
    assert max(b.num_rows for b in got) <= 1 << 17
    pairs = pa.Table.from_batches(got)
    c = np.zeros((1024, 1024))
    c[pairs["rid"].to_numpy(), pairs["qid"].to_numpy()] = pairs["cost"].to_numpy()
    assert pairs.num_rows == 1 << 20 and len(set(zip(pairs["rid"].to_pylist(), pairs["qid"].to_pylist()))) == 1 << 20
    assert np.allclose(c, simjoin.costs(x, x, "l2"), atol=1e-9)


@pytest.mark.parametrize("k", [None, 5])
def test_many_groups_of_queries(spark, clustered, k, monkeypatch):
    """Groups of a few hundred queries, each in cells of its own: every pair once, and the same nearest rows."""
    df, ids = frame(spark, clustered), np.arange(0, 3000, 5)
    join = lambda: simjoin.similarity_join(df, df.where("vec_id % 5 = 0"), "l2", k=k, exclude_self=k is not None)
    monkeypatch.setattr(simjoin, "CELL", 10_000)
    got = join().collect()
    if k is None:
        c = simjoin.costs(clustered, clustered[ids], "l2")
        assert len(got) == c.size == len({(r.qid, r.rid) for r in got})
        assert np.allclose([r.cost for r in got], [c[r.rid, r.qid // 5] for r in got], atol=1e-9)
    else:
        want = expected(clustered, ids, "l2", k, True, False)
        rows = {}
        for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
            rows.setdefault(r.qid, []).append(r.cost)
        assert set(rows) == set(want) and all(np.allclose(rows[q], [c for _, c in want[q]], atol=1e-9) for q in want)


def test_edges(spark, clustered):
    df = frame(spark, clustered[:5])
    none = spark.createDataFrame([(9, None, 1), (None, [1.0] * 8, 1)], "vec_id long, v array<double>, label long")
    for prune in (False, True):
        assert simjoin.similarity_join(df, none, k=2, prune=prune).collect() == []
        assert simjoin.similarity_join(none, df, k=2, prune=prune).collect() == []
        twice = simjoin.similarity_join(df.union(df).union(none), df.limit(1), k=20, prune=prune)
        assert twice.count() == 10
