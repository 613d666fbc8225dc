"""Vector functions, similarity joins, moments and integrators against NumPy and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import arrays, quality, vec
from vectide.functions.numbering import numbered
from vectide.operators import codec, integrate, layout, moments, quantize, running, simjoin, weights


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(rows)], "vec_id long, v array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(1)
    return np.concatenate([rnd.normal(size=(40, 6)), np.zeros((1, 6)), np.ones((2, 6))])


def test_joins(spark, data):
    df = frame(spark, data)
    q = df.where("vec_id % 5 = 0")
    for metric in ("cosine", "l2", "unit_cosine"):
        want = simjoin.costs(data, data[::5], metric)
        got = {(r.qid, r.rid): r.cost for r in simjoin.similarity_join(df, q, metric).collect()}
        assert len(got) == want.size
        assert all(math.isclose(want[r, k // 5], c, abs_tol=1e-9) for (k, r), c in got.items())
        top = simjoin.similarity_join(df, q, metric, k=4).collect()
        for k in range(0, len(data), 5):
            mine = sorted((r.rank, r.rid) for r in top if r.qid == k)
            best = sorted(range(len(data)), key=lambda r: (round(want[r, k // 5], 9), r))[:4]
            assert {round(want[r, k // 5], 7) for _, r in mine} == {round(want[r, k // 5], 7) for r in best} and [x for x, _ in mine] == [1, 2, 3, 4]
    same = simjoin.similarity_join(df, q, class_col="label", k=3).collect()
    assert all(r.qid % 3 == r.rid % 3 for r in same)
    few = simjoin.similarity_join(df.where("label = 0 or vec_id = 1"), q.where("vec_id = 10"), class_col="label", k=3).orderBy("rank").collect()
    assert [r.rid % 3 for r in few] == [1, 0, 0]
    assert simjoin.similarity_join(df, q.limit(0), k=3).collect() == []
    with pytest.raises(ValueError):
        simjoin.costs(data, data, "other")


def test_query_blocks(spark, data):
    df = frame(spark, data)
    one = sorted(map(tuple, simjoin.similarity_join(df, df, k=2).collect()))
    assert sorted(map(tuple, simjoin.similarity_join(df, df, k=2, block=7).collect())) == one


def test_interpolation(spark):
    a, b = [1.0, 0.0], [0.0, 2.0]
    df = spark.createDataFrame([(a, b), (a, a), (a, [-1.0, 0.0]), ([0.0, 0.0], b)], "a array<double>, b array<double>")
    rows = df.select(vec.slerp(F.col("a"), F.col("b"), 0.0).alias("s0"), vec.slerp(F.col("a"), F.col("b"), 1.0).alias("s1"), vec.slerp(F.col("a"), F.col("b"), 0.5).alias("s"), vec.normalize(F.col("a")).alias("n")).collect()
    assert np.allclose(rows[0].s0, a, atol=1e-6) and np.allclose(rows[0].s1, b, atol=1e-6)
    assert np.allclose(rows[0].s, [math.sqrt(0.5), math.sqrt(2)], atol=1e-6)
    assert np.allclose(rows[1].s, a, atol=1e-3) and np.allclose(rows[2].s, [0, 0]) and rows[3].n == [0.0, 0.0]


def test_moments(spark, data, tmp_path):
    s = moments.summary(frame(spark, data), "v")
    assert s.n == len(data) and np.allclose(s.mu, data.mean(0)) and np.allclose(s.sigma, np.cov(data, rowvar=False))
    assert abs(moments.frechet(s, s)) < 1e-9
    t = moments.Summary(s.n, s.mu + 1, s.sigma)
    assert math.isclose(moments.frechet(s, t), 6, rel_tol=1e-9) and math.isclose(moments.frechet(s, t), moments.frechet(t, s), rel_tol=1e-9)
    d1, d2 = np.diag([1.0, 4.0]), np.diag([9.0, 16.0])
    assert math.isclose(moments.frechet(moments.Summary(9, np.zeros(2), d1), moments.Summary(9, np.zeros(2), d2)), (1 - 3) ** 2 + (2 - 4) ** 2)
    moments.save_summary(spark, s, f"{tmp_path}/s")
    assert np.allclose(moments.load_summary(spark, f"{tmp_path}/s").sigma, s.sigma)
    few = moments.summary(frame(spark, data[:3]), "v")  # fewer rows than dimensions
    assert np.isfinite(moments.frechet(few, s))
    with pytest.raises(ValueError):
        moments.frechet(s, moments.Summary(1, np.zeros(2), d1))
    with pytest.raises(ValueError):
        moments.summary(frame(spark, data).limit(0), "v")


def test_weights(spark):
    rows = [(q, k, float(k * q)) for q in range(4) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "qid long, rank int, cost2 double")
    w = weights.softmax_weights(df)
    assert all(abs(r.s - 1) < 1e-12 for r in w.groupBy("qid").agg(F.sum("p").alias("s")).collect())
    h = {r.qid: r.entropy for r in weights.entropy(w).collect()}
    assert math.isclose(h[0], math.log(5)) and all(0 <= x <= math.log(5) + 1e-12 for x in h.values())
    assert sorted(r.qid for r in weights.draw(w).collect()) == [0, 1, 2, 3]


def test_quality(spark):
    df = spark.createDataFrame([([0.0, 0.5], [0.0, 0.5]), ([0.0, 0.5], [0.1, 0.5])], "a array<double>, b array<double>")
    same, other = df.select(quality.psnr(F.col("a"), F.col("b")).alias("signed"), quality.psnr(F.col("a"), F.col("b"), False).alias("unit")).collect()
    assert same.signed == math.inf and math.isclose(other.signed - other.unit, 20 * math.log10(2))
    rnd = np.random.default_rng(1)
    x = rnd.uniform(0, 255, (1, 20, 20))
    assert np.allclose(quality.ssim_scores(x, x)[0], 1) and quality.ssim_scores(x, 255 - x)[0] < 0.5
    assert np.isnan(quality.image_scores(x[None], x[None])[1]).all()
    big = rnd.uniform(0, 255, (1, 256, 256))
    assert np.allclose(quality.image_scores(big[None], big[None]), 1)


def test_layouts():
    for index in (arrays.pixel_unshuffle(1, 8, 8, 2), arrays.patchify(4, 4, 4, 2), arrays.tokens_to_map(16, 4), arrays.unpatchify(4, 2, 1)):
        assert sorted(index) == list(range(64)) and [index[i] for i in arrays.inverse(index)] == list(range(64))
    x = np.arange(64).reshape(1, 8, 8)
    assert x.reshape(1, 4, 2, 4, 2).transpose(0, 2, 4, 1, 3).ravel().tolist() == arrays.pixel_unshuffle(1, 8, 8, 2)
    assert arrays.zigzag(3, 3) == [0, 3, 1, 2, 4, 6, 7, 5, 8] or arrays.zigzag(3, 3) == [0, 1, 3, 6, 4, 2, 5, 7, 8]
    for m in (layout.dct2(8, 8), layout.haar2(8, 8, 3)):
        assert np.allclose(m @ m.T, np.eye(64))
    assert np.allclose(layout.masked_dct(8, 8, [1] * 64), np.eye(64))
    assert arrays.keep_count(0.5, 5) == 2 and arrays.keep_count(0.5, 7) == 4 and arrays.keep_count(None, 9) == 9 and arrays.keep_count(99, 9) == 9
    assert sum(arrays.band_mask(4, 4, "drop_low", 0)) == 16 and sum(arrays.band_mask(4, 4, "low", 3)) == 3
    for f, a in ((arrays.square_side, 5), (lambda n: arrays.tokens_to_map(n, 2), 6)):
        with pytest.raises(ValueError):
            f(a)


def test_integrators(spark):
    df = spark.createDataFrame([([0.7, -1.0],)], "v array<double>")

    def f(x, t):
        return F.transform(x, lambda a: 0.3 * a + 0.2 * t)

    def exact(x, t1, t2):  # of x' = 0.3 x + 0.2 t
        c = x + 0.2 / 0.3 * t1 + 0.2 / 0.09
        return c * math.exp(0.3 * (t2 - t1)) - 0.2 / 0.3 * t2 - 0.2 / 0.09

    want = [exact(0.7, 1, 0), exact(-1.0, 1, 0)]
    rough = df.select(integrate.euler(F.col("v"), lambda x, t, _: f(x, t), integrate.grid(40)).alias("z")).first().z
    fine = df.select(integrate.euler(F.col("v"), lambda x, t, _: f(x, t), integrate.grid(40), heun=True).alias("z")).first().z
    assert np.allclose(rough, want, atol=2e-2) and np.allclose(fine, want, atol=1e-2)
    assert np.abs(np.subtract(fine, want)).max() < np.abs(np.subtract(rough, want)).max()
    z = df.withColumn("z", integrate.coupled(F.col("v"), F.col("v"), f, integrate.grid(5), None))
    back = z.select(integrate.coupled(F.col("z.x"), F.col("z.y"), f, integrate.grid(5), None, inverse=True).alias("b")).first().b
    assert np.allclose(back.x, [0.7, -1.0], atol=1e-12)
    one = z.select(integrate.coupled(F.col("z.x"), F.col("z.x"), f, integrate.grid(5), 0.9, inverse=True).alias("b")).first().b
    assert not np.allclose(one.x, [0.7, -1.0], atol=1e-3)  # mixing and one end state don't invert
    for name in ("linear", "cosine", "sqrt_linear", "sqrt"):
        assert len(integrate.betas(name, 20)) == 20 and 0 < integrate.betas(name, 20)[0] <= 0.999
    with pytest.raises(ValueError):
        integrate.betas("other", 5)


def test_running(spark):
    rows = [("a", k, float(k * k % 7)) for k in range(50)] + [("b", 3, 2.0)]
    df = spark.createDataFrame(rows, "key string, at long, x double").repartition(4)
    got = {r.key: r.ema for r in running.ema(df, "key", "at", "x", 0.9).collect()}
    e = rows[0][2]
    for _, _, x in rows[1:50]:
        e = 0.9 * e + 0.1 * x
    assert math.isclose(got["a"], e) and got["b"] == 2.0
    assert {r.key: r.ema for r in running.ema(df, "key", "at", "x", 0.0).collect()}["a"] == rows[49][2]
    use = {(r.key, r.at): r.usage for r in running.ring_usage(df, "key", "at", F.col("x").cast("int"), 5, 7).collect()}
    ring = [0] * 5
    for _, k, x in rows[:50]:
        ring = ring[1:] + [int(x)]
        assert math.isclose(use["a", k], len(set(ring)) / 7)


def test_quantizers(spark, data):
    df = frame(spark, data)
    book = spark.createDataFrame([(k, [float(x) for x in data[k]]) for k in range(5)], "code_id long, c array<double>")
    got = {r.vec_id: (r.code, r.distance) for r in simjoin.nearest_codeword(df, book).collect()}
    d = ((data[:, None] - data[None, :5]) ** 2).sum(2)
    assert all(got[k][0] == d[k].argmin() and math.isclose(got[k][1], d[k].min(), abs_tol=1e-9) for k in range(len(data)))
    soft = quantize.soft_codewords(df, book, 1.0).where("vec_id = 7").first()
    p = np.exp(data[7] @ data[:5].T)
    assert np.allclose(soft.soft, p / p.sum() @ data[:5])
    with pytest.raises(ValueError):
        quantize.load_codebook(book, max_codes=4)


def test_codecs(spark):
    df = frame(spark, np.random.default_rng(2).normal(size=(5, 64)))
    for target in ("pixel_shuffle", "block_dct", "haar"):
        z = codec.apply(df, {"target": target}, "encode")
        back = codec.apply(z, {"target": target}, "decode", "z", "back")
        assert all(np.allclose(r.v, r.back) for r in back.collect())
    for bad in (lambda: codec.from_config({"target": "no"}), lambda: codec.LatentShape((4,)), lambda: codec.apply(df, {"target": "haar"}, "code"), lambda: codec.register("haar", None)):
        with pytest.raises(ValueError):
            bad()


def test_numbered(spark):
    df = spark.createDataFrame([(k * 37 % 1000,) for k in range(200)], "k long")
    got = [r.rn for r in numbered(df, "k", width=64).orderBy("k").collect()]
    assert got == list(range(1, 201))


def test_query_blocks_waves_and_tiles(spark):
    """5,000 queries in blocks of 700 and waves of 3 scans, against NumPy; the own row is left out or kept."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(6000, 4))
    x[100:140] = x[0]  # ties
    df = frame(spark, x)
    q = df.where("vec_id < 5000")
    cost = simjoin.costs(x, x[:5000], "cosine")
    for own in (False, True):
        got = simjoin.similarity_join(df, q, k=3, exclude_self=own, block=700).toPandas().sort_values(["qid", "rank"])
        assert len(got) == 15000
        c = cost.copy()
        if own:
            c[np.arange(5000), np.arange(5000)] = np.inf
        assert np.allclose(got.cost.to_numpy().reshape(5000, 3), np.sort(c, axis=0)[:3].T, atol=1e-9)
        assert not (own and (got.qid == got.rid).any())
    near = simjoin.similarity_join(df, q.where("vec_id % 100 = 0"), class_col="label", k=5, exclude_self=True).toPandas()
    label = np.arange(6000) % 3
    for qid, rows in near.sort_values("rank").groupby("qid"):
        gap = np.abs(label - label[qid])
        order = np.lexsort([np.arange(6000), np.round(cost[:, qid], 12), gap])
        want = [k for k in order if k != qid][:5]
        assert np.allclose(cost[rows.rid.to_numpy(), qid], cost[want, qid]) and (gap[rows.rid.to_numpy()] == gap[want]).all()


def test_moments_of_2048_dimensions(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(60, 2048))
    df = frame(spark, x).withColumn("w", F.when(F.col("vec_id") < 20, F.col("v")))
    a, b = moments.summaries(df, "v", "w")
    assert (a.n, b.n) == (60, 20) and np.allclose(a.sigma, np.cov(x, rowvar=False)) and np.allclose(b.mu, x[:20].mean(0))
    rows = moments.covariance(df.select(F.slice("v", 1, 30).alias("v")), "v").toPandas().sort_values(["i", "j"])
    assert np.allclose(rows["cov"].to_numpy().reshape(30, 30), np.cov(x[:, :30], rowvar=False))


def test_ring_of_65536(spark):
    """Against a real ring buffer, with ranges smaller than the ring, one hot key and one hot code."""
    rnd = np.random.default_rng(10)
    n, size = 70_000, 65_536
    codes = np.where(rnd.random(n) < 0.5, 3, rnd.integers(0, 5000, n))
    df = spark.range(n, numPartitions=3).withColumn("key", F.lit("a"))
    df = df.join(spark.createDataFrame(list(enumerate(codes.tolist())), "id long, code long"), "id")
    got = running.ring_usage(df, "key", "id", F.col("code"), size, 5000, width=9000).toPandas().set_index("id").usage
    assert len(got) == n
    ring, count, used = np.zeros(size, int), np.zeros(5000, int), 1
    count[0] = size
    for k, c in enumerate(codes):
        old, ring[k % size] = ring[k % size], c
        count[old] -= 1
        used -= count[old] == 0
        used += count[c] == 0
        count[c] += 1
        if k % 997 == 0 or k > n - 50:
            assert math.isclose(got[k], used / 5000)


def test_band_edges_and_squares():
    edges = arrays.band_edges(4, 4, 2, [1.0, 2.0, 8.0])
    assert edges[0] == 0 and math.isclose(edges[1], math.hypot(3, 3) / 2) and edges[2] > math.hypot(3, 3) and len(edges) == 3
    assert arrays.band_edges(4, 4, 2, []) == arrays.band_edges(4, 4, 2)
    assert arrays.band_mask(4, 4, "drop_high", 7, "square") == [1, 1, 1, 0] * 3 + [0] * 4
    assert arrays.band_mask(4, 4, "low", 0, "square") == [0] * 16
    with pytest.raises(ValueError):
        arrays.band_mask(4, 4, "high", 5, "square")
