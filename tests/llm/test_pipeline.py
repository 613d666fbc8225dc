import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    from test_decontaminate import brute as leaks
    from test_jaccard import brute as groups
    from test_substring import brute as passages

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            assert 0 < len(after) < len(before) and all(before[i] == t for i, t in after.items())
        if k == 1:
            want = groups(list(before.items()))
            assert set(after) == {int(c) for *_, c in want}
        if k == 2:
            import hashlib

            want = passages(list(before.items()), 35)
            for i, (n, gone, sha) in want.items():
                assert (i in after) == (gone == 0 or gone < n)
                if i in after:
                    assert (after[i] == before[i]) if gone == 0 else hashlib.sha256(after[i].encode()).hexdigest() == sha
        if k == 3:
            assert set(after) == {i for i, t in before.items() if not leaks(t, bench, 10)[3]}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(after)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 for x in by.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def rough(spark):
    """Nulls in every column, repeated rows and ids, near copies, and columns whose names the stages use inside."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " x", None, None, None), (None, None, None, None, None), (None, "a b", "en", "s", 3), (3, "", "en", "s", 0), (3, "other words", "en", "s", 11), (4, None, "en", "s", None), (5, "leak " + " ".join(f"item{k}" for k in range(12)), "en", "s", 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("chunk", "rows", "h", "whole", "node", "task", "rank", "score", "predicted", "kept_text", "n_words", "n_removed", "spans", "items", "n_hit", "piece", "k"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def tables(spark, folder):
    spark.createDataFrame([(i, 1, 0) for i in (1, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(12))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_rough_rows(spark, tmp_path):
    folder, df = tables(spark, tmp_path), rough(spark)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: repr(tuple(r))
    plain = sorted(map(key, df.select(corpus_pipeline.COLUMNS).collect()))
    got = {name: stage(spark, df, folder) for name, stage in stages.items()}
    for name in list(stages)[:4]:
        assert got[name].columns == corpus_pipeline.COLUMNS
    rows = {name: sorted(map(key, x.select(corpus_pipeline.COLUMNS).collect())) for name, x in got.items() if name != "best-fit packing"}
    assert rows["quality classifier"] == plain  # labels of one kind: nothing is rejected
    kept = [(r.doc_id, r.text) for r in got["near duplicates"].collect()]
    assert [x for x in kept if x[1] and x[1].startswith("w0")] == [(1, df.where("doc_id = 1").first().text)]
    assert len(kept) == 7 and (None, "a b") in kept and (None, None) in kept and (3, "other words") in kept
    passages = [(r.doc_id, r.text) for r in got["substring dedup"].collect()]
    assert sorted(map(repr, passages)) == sorted(map(repr, [(2, "x"), (None, None), (None, "a b"), (3, ""), (3, "other words"), (4, None), (5, df.where("doc_id = 5").first().text)]))
    assert rows["benchmark decontamination"] == [x for x in plain if "item0" not in x]
    packed = got["best-fit packing"].collect()
    assert len(packed) == 9 and "clash" not in {x for r in packed for x in r}


def test_empty_tables(spark, tmp_path):
    folder, df = tables(spark, tmp_path), rough(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, folder).collect() == []
