"""State of streams: what a trigger writes, restarts, and sizes at which the ring turns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import running
from vectide.streaming import states

SCHEMA = "key string, at long, x long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get(states.PROVIDER)
    states.use_rocksdb(spark)
    yield
    spark.conf.set(states.PROVIDER, before)


def made(n: int, codes: int, seed: int) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    return [("a" if k % 3 else None, k, int(c)) for k, c in enumerate(rnd.integers(0, codes, n))]


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder))


def run(spark, tmp_path, size, codes, got):
    """Runs a stream over the files that are there; adds (key, n) -> usage to got and returns the rows of state that it wrote."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = states.stream_ring_usage(stream, "key", "at", "x", size, codes)
    take = lambda batch, _: got.update({(r.key, r.n): r.usage for r in batch.collect()})
    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]


def check(spark, rows, got, size, codes):
    batch = spark.createDataFrame(rows, SCHEMA)
    usages = running.ring_usage(batch, "key", "at", F.col("x"), size, codes).collect()
    want = {}
    for key in {r.key for r in usages}:
        mine = sorted((r.at, r.usage) for r in usages if r.key == key)
        want |= {(key, n + 1): usage for n, (_, usage) in enumerate(mine)}
    assert got and all(math.isclose(usage, want[place]) for place, usage in got.items())
    return want


@pytest.mark.parametrize("size", [7, 300, 600])
def test_ring_goes_on_after_a_restart(spark, tmp_path, size):
    rows, got = made(1500, 40, size), {}
    put(spark, rows[:700], tmp_path / "in" / "0")
    run(spark, tmp_path, size, 40, got)
    put(spark, rows[700:710], tmp_path / "in" / "1")
    run(spark, tmp_path, size, 40, got)
    put(spark, rows[710:], tmp_path / "in" / "2")
    run(spark, tmp_path, size, 40, got)
    want = check(spark, rows, got, size, 40)
    last = {key: max(n for k, n in got if k == key) for key in ("a", None)}
    assert last == {"a": 1000, None: 500}
    mean = states.ring_usage_of(spark, f"{tmp_path}/state", 40).first()
    assert mean.keys == 2 and math.isclose(mean.usage, (want["a", 1000] + want[None, 500]) / 2)


def test_a_trigger_writes_what_its_rows_change(spark, tmp_path):
    """Of a full ring of 65,536 codes, 60 rows write a page or two a key, and the counts of codes that enter or leave."""
    rnd, got = np.random.default_rng(3), {}
    rows = [("a", k, int(c)) for k, c in enumerate(rnd.integers(0, 5000, 70_060))]
    put(spark, rows[:70_000], tmp_path / "in" / "0")
    first = run(spark, tmp_path, 65536, 5000, got)
    put(spark, rows[70_000:], tmp_path / "in" / "1")
    second = run(spark, tmp_path, 65536, 5000, got)
    assert sum(first) > 5000 and 0 < sum(second) <= 2 * 60 + 3
    check(spark, rows, got, 65536, 5000)


def test_ema_goes_on_after_a_restart(spark, tmp_path):
    rows, got = made(400, 40, 1), {}
    for k, part in enumerate((rows[:1], rows[1:250], rows[250:])):
        put(spark, part, tmp_path / "in" / str(k))
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        out = states.stream_ema(stream, "key", "at", "x", 0.9)
        q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ema").foreachBatch(lambda b, _: got.update({(r.key, r.n): r.ema for r in b.collect()})).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {r.key: r.ema for r in running.ema(spark.createDataFrame(rows, SCHEMA), "key", "at", "x", 0.9).collect()}
    assert math.isclose(got["a", 266], want["a"]) and math.isclose(got[None, 134], want[None])


def test_other_state_stores_are_refused(spark):
    spark.conf.unset(states.PROVIDER)
    stream = spark.readStream.format("rate").load().select(F.lit("k").alias("key"), F.col("value").alias("at"), F.col("value").alias("x"))
    with pytest.raises(ValueError, match="RocksDB"):
        states.stream_ring_usage(stream, "key", "at", "x", 5, 5)
