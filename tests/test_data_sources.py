"""The file and archive data sources on small trees: same rows as the plain scans, pushed filters, partitions, streams, commits."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.sources import archive, images, zips
from vectide.sources.listing import packed
from vectide.sources.tree import Tree, register


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    register(spark)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for folder, n in (("a", 30), ("b", 3), ("b/deep", 2), ("empty", 0)):
        (root / folder).mkdir()
        for k in range(n):
            (root / folder / f"x{k:02d}.{('png', 'JPG', 'txt')[k % 3]}").write_bytes(f"{folder}{k}".encode() * (k + 1))
    (root / "top.png").write_bytes(b"top")
    (root / "b" / "_hidden.png").write_bytes(b"no")
    (root / "b" / "noending").write_bytes(b"")
    return root


def files(spark, root, schema=None, **options):
    r = spark.read.format("vectide_files").options(**options)
    return (r.schema(schema) if schema else r).load(str(root))


def test_same_rows_as_the_plain_scans(spark, tree):
    got = files(spark, tree).where(F.col("extension").isin("png", "jpg"))
    assert sorted(r.name for r in got.collect()) == [r.name for r in images.scan_images(spark, str(tree), ["png", "jpg"]).collect()]
    flat = files(spark, tree / "b", recursive="false", extensions="png,jpg")
    assert sorted(r.name for r in flat.collect()) == ["x00.png", "x01.JPG"]
    classes = {(r.path.rsplit("/", 1)[1], r.class_name) for r in images.scan_class_folders(spark, str(tree)).collect()}
    assert {(r.name.rsplit("/", 1)[1], r.class_name) for r in got.where("name like '%/%' and name not like '%/%/%'").collect()} == classes
    (tree / "aa").mkdir()  # a class without images has a label, too
    assert {(r.class_name, r.label) for r in images.scan_class_folders(spark, str(tree)).collect()} == {("a", 0), ("b", 2)}
    (tree / "aa").rmdir()
    rows = {r.name: r for r in files(spark, tree).collect()}
    assert len(rows) == 37 and rows["top.png"].class_name is None and rows["b/noending"].extension == "" and bytes(rows["b/noending"].content) == b""
    assert bytes(rows["a/x02.txt"].content) == b"a2a2a2" and rows["b/deep/x01.JPG"].class_name == "deep" and rows["top.png"].size == 3
    assert abs(rows["top.png"].modified.timestamp() - os.stat(tree / "top.png").st_mtime) < 1e-3


def test_large_folders_are_dealt_and_small_ones_shared(spark, tree):
    names = files(spark, tree, "name string", files_per_partition=4)
    assert names.rdd.getNumPartitions() == 8 + 3  # a's 30 files; the root, b, b/deep, of which no two fit together
    assert len({r.name for r in names.collect()}) == names.count() == 37
    assert [p.pieces for p in packed([("a", 3), ("b", 2), ("c", 9), ("d", 2)], 4)] == [[("a", 0, 1)], *[[("c", k, 3)] for k in range(3)], [("b", 0, 1), ("d", 0, 1)]]


def test_filters_are_pushed(spark, tree):
    x = files(spark, tree, "name string, extension string, class_name string")
    x = x.where("extension = 'png' and class_name in ('a', 'deep')")
    assert "Filter " not in x._jdf.queryExecution().executedPlan().toString()  # nothing is left to Spark
    assert "Filter EndsWith" in x.where("name like '%png'")._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in x.collect()} == {f"a/x{k:02d}.png" for k in range(0, 30, 3)} | {"b/deep/x00.png"}
    assert files(spark, tree).where("name like 'b/%'").count() == 6 and files(spark, tree).where("name = 'b/x00.png' and size > 2").count() == 0
    assert files(spark, tree).where("extension = 'none'").count() == 0


def test_folders_out_of_reach_are_not_listed(tree):
    from pyspark.sql.datasource import StringStartsWith
    from pyspark.sql.types import StringType, StructType

    t = Tree({"path": str(tree)}, StructType().add("name", StringType()))
    assert list(t.filters.take([StringStartsWith(("name",), "b/d")])) == []
    assert [folder for folder, _ in t.folders()] == ["", "b/", "b/deep/"]
    assert [p.pieces for p in t.pieces()] == [[("b/deep/", 0, 1)]]


def test_edges(spark, tree, tmp_path):
    assert files(spark, tmp_path).count() == 0 and files(spark, tmp_path / "missing").count() == 0
    with pytest.raises(Exception, match="no such columns"):
        files(spark, tree, "nothing string").collect()


def test_stream_of_new_files(spark, tmp_path):
    root, got = tmp_path / "in", []
    root.mkdir()

    def run():
        stream = spark.readStream.format("vectide_files").schema("name string, content binary").options(settle_ms=0, extensions="png").load(str(root))
        take = lambda batch, _: got.extend((r.name, bytes(r.content)) for r in batch.collect())
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(take).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    for k, names in enumerate((["a.png", "no.txt"], ["b.png", "c.png"], [])):
        for name in names:
            (root / name).write_bytes(name.encode())
            os.utime(root / name, (1000 + k, 1000 + k))
        run()
    assert sorted(got) == [(n, n.encode()) for n in ("a.png", "b.png", "c.png")]


def items(spark, n=40):
    x = spark.range(n, numPartitions=3)
    return x.select(archive.arcname(F.col("id")).alias("arcname"), F.col("id").cast("string").cast("binary").alias("bytes"), F.when(F.col("id") % 4 > 0, F.col("id") % 7).cast("int").alias("label"))


def test_zips_hold_what_the_parquet_archive_holds(spark, tmp_path):
    zips.write_zips(items(spark), f"{tmp_path}/z")
    archive.write_archive(items(spark), f"{tmp_path}/p")
    rows = lambda x: sorted((r.name, bytes(r.bytes), r.label is None, r.label or 0) for r in x.collect())
    assert rows(zips.read_zips(spark, f"{tmp_path}/z", check=False)) == rows(archive.read_archive(spark, f"{tmp_path}/p", check=False))
    with pytest.raises(Exception, match="no label for 00000/img0000"):
        zips.read_zips(spark, f"{tmp_path}/z").collect()
    names = sorted(os.listdir(f"{tmp_path}/z"))
    assert names[0] == "_SUCCESS" and len(names) == 4 and all(n.endswith(".zip") for n in names[1:])
    with zipfile.ZipFile(f"{tmp_path}/z/{names[1]}") as z:  # a plain zip, uncompressed, with its labels
        assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}
        assert ["00000/img00000001.png", 1] in json.loads(z.read("dataset.json"))["labels"]
    zips.write_zips(items(spark, 5), f"{tmp_path}/z")
    assert zips.read_zips(spark, f"{tmp_path}/z", check=False).count() == 45
    zips.write_zips(items(spark, 5), f"{tmp_path}/z", "overwrite")
    assert zips.read_zips(spark, f"{tmp_path}/z", check=False).count() == 5 and not os.path.exists(f"{tmp_path}/z/_temporary")


def test_archives_are_split_and_filtered(spark, tmp_path):
    zips.write_zips(items(spark, 500).coalesce(1), f"{tmp_path}/z")
    size = sum(x.stat().st_size for x in (tmp_path / "z").iterdir())
    x = spark.read.format("vectide_archives").option("split_bytes", size // 5).schema("name string, label long").load(f"{tmp_path}/z")
    assert x.rdd.getNumPartitions() >= 5 and x.count() == x.select("name").distinct().count() == 500
    assert x.where("name in ('00000/img00000003.png', 'none')").collect()[0].label == 3
    np.savez(f"{tmp_path}/s.npz", mu=np.arange(3.0), sigma=np.eye(3))
    got = archive.load_by_kind(zips.read_zips(spark, f"{tmp_path}/s.npz", check=False)).orderBy("name").collect()
    assert [(r.name, r.shape) for r in got] == [("mu.npy", [3]), ("sigma.npy", [3, 3])] and got[0]["values"] == [0, 1, 2]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    zips.write_zips(items(spark, 10), f"{tmp_path}/z")
    before = sorted(os.listdir(tmp_path / "z"))
    broken = items(spark).withColumn("bytes", F.when(F.col("arcname") != "00000/img00000039.png", F.col("bytes")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="has no name or content"):
            zips.write_zips(broken, f"{tmp_path}/z", mode)
        assert sorted(os.listdir(tmp_path / "z")) == before
    assert zips.read_zips(spark, f"{tmp_path}/z", check=False).count() == 10


def test_equal_names_and_no_rows(spark, tmp_path):
    twice = spark.createDataFrame([("a.png", b"1", 1), ("a.png", b"2", None)], "arcname string, bytes binary, label int").coalesce(1)
    zips.write_zips(twice, f"{tmp_path}/z")
    assert sorted(bytes(r.bytes) for r in zips.read_zips(spark, f"{tmp_path}/z").collect()) == [b"1", b"2"]
    zips.write_zips(twice.limit(0), f"{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == ["_SUCCESS"] and zips.read_zips(spark, f"{tmp_path}/none").count() == 0
