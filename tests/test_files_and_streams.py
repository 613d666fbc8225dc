"""Image trees, archives and streaming state on small files."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import running
from vectide.sources import archive, images
from vectide.streaming import states


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rnd = np.random.default_rng(1)
    for c, n in (("b", 3), ("a", 2)):
        (root / c).mkdir()
        for k in range(n):
            (root / c / f"x{k}.{'PNG' if k else 'png'}").write_bytes(png(rnd.integers(0, 256, (4, 6, 3))))
    (root / "a" / "notes.txt").write_text("no image")
    return root


def test_scans(spark, tree):
    got = [(r.class_name, r.label, r.path.rsplit("/", 1)[1]) for r in images.scan_class_folders(spark, str(tree)).orderBy("path").collect()]
    assert got == [("a", 0, "x0.png"), ("a", 0, "x1.PNG"), ("b", 1, "x0.png"), ("b", 1, "x1.PNG"), ("b", 1, "x2.PNG")]
    names = images.scan_images(spark, str(tree))
    assert [r.name for r in names.collect()] == ["a/x0.png", "a/x1.PNG", "b/x0.png", "b/x1.PNG", "b/x2.PNG"]
    assert images.scan_images(spark, str(tree), max_images=2).count() == 2 and images.scan_flat(spark, f"{tree}/b", 2).count() == 2
    assert {r.label for r in images.resolve_labels(names).collect()} == {0, 1}
    one = images.scan_images(spark, f"{tree}/b")
    assert {r.label for r in images.resolve_labels(one).collect()} == {None}  # one folder gives no labels
    listed = spark.createDataFrame([("a\\x0.png", 7)], "name string, label int")
    assert {r.name: r.label for r in images.resolve_labels(names, listed).collect()}["a/x0.png"] == 7


def test_decoding(spark, tmp_path):
    a = np.arange(4 * 6 * 3).reshape(4, 6, 3) * 3
    (tmp_path / "i.png").write_bytes(png(a))
    r = images.decode_rgb(spark, str(tmp_path)).first()
    assert (r.height, r.width) == (4, 6) and r.pixels == a.transpose(2, 0, 1).ravel().tolist()
    x = images.prepared(images.decode_rgb(spark, str(tmp_path)), 4).first().x
    assert len(x) == 48 and -1 <= min(x) and max(x) <= 1


def test_resizing():
    flat = np.full((3, 37, 50), 9.0)
    assert np.allclose(images.center_crop(flat, 8), 9) and images.center_crop(flat, 8).shape == (3, 8, 8)
    x = np.random.default_rng(1).normal(size=(1, 8, 8))
    assert np.allclose(images.resize(x, 8, 8), x) and np.allclose(images.resize(x, 8, 8, "bilinear"), x)
    halves = images.center_crop(np.arange(256.0).reshape(1, 16, 16), 8)
    assert np.allclose(halves, np.arange(256.0).reshape(1, 8, 2, 8, 2).mean((2, 4)))


def test_archives(spark, tmp_path):
    items = spark.range(12).select(archive.arcname(F.col("id") + 99_995).alias("arcname"), F.lit(b"xy").alias("bytes"), F.when(F.col("id") > 0, F.col("id").cast("int")).alias("label"))
    archive.write_archive(items, f"{tmp_path}/a")
    names = {r.name for r in spark.read.parquet(f"{tmp_path}/a/names").collect()}
    assert "00099/img00099995.png" in names and {"00099", "00100"} <= names and len(names) == 14
    assert archive.read_archive(spark, f"{tmp_path}/a", check=False).count() == 12
    with pytest.raises(Exception, match="no label for 00099/img00099995.png"):
        archive.read_archive(spark, f"{tmp_path}/a").collect()
    with pytest.raises(Exception, match="unknown kind of q.gif"):
        archive.load_by_kind(spark.createDataFrame([("q.gif", b"x")], "name string, bytes binary")).collect()
    import io

    out = io.BytesIO()
    np.save(out, np.array([[1.0, 2.0]]))
    got = archive.load_by_kind(spark.createDataFrame([("a.npy", out.getvalue()), ("b.json", b"{}")], "name string, bytes binary")).orderBy("name").collect()
    assert got[0]["values"] == [1.0, 2.0] and got[1]["json"] == "{}"


def run_stream(spark, out, name):
    q = out.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get(states.PROVIDER)
    states.use_rocksdb(spark)
    yield
    spark.conf.set(states.PROVIDER, before)


def test_streams_match_batch(spark, tmp_path, rocksdb):
    rows = [("a" if k % 3 else "b", k, float(k * 7 % 13)) for k in range(60)]
    for part in range(3):  # one file a trigger, in order
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "key string, at long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    batch = spark.createDataFrame(rows, "key string, at long, x double")
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {}
    for r in run_stream(spark, states.stream_ema(stream(), "key", "at", "x", 0.9), "ema_out"):
        got[r.key] = max(got.get(r.key, (0, 0)), (r.n, r.ema))
    want = {r.key: r.ema for r in running.ema(batch, "key", "at", "x", 0.9).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 40, "b": 20} and all(math.isclose(v[1], want[k]) for k, v in got.items())
    usage = run_stream(spark, states.stream_ring_usage(stream().withColumn("x", F.col("x").cast("int")), "key", "at", "x", 5, 13), "ring_out")
    final = {r.key: r.usage for r in running.ring_usage(batch, "key", "at", F.col("x").cast("int"), 5, 13).where("at >= 58").collect()}
    assert all(any(r.key == k and math.isclose(r.usage, v) for r in usage) for k, v in final.items() if k == "a")
    moments = run_stream(spark, states.stream_running_moments(stream(), "key", "x"), "moments_out")
    assert {r.key for r in moments} == {"a", "b"} and all(math.isfinite(r["var"]) for r in moments)
