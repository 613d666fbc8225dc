import os
import random

import pytest
from pyspark.sql import functions as F

from vectide.llm import language, quality_model

DATA = "/root/testdata/sf0.01"


def test_language_spans(spark):
    rnd = random.Random(1)
    words = {"aa": ["kral", "mok", "tavi", "zek"], "bb": ["ouilon", "quen", "eauri"], "cc": ["да", "нет", "слово"]}
    text = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    train = [(i, text(k, 30), k) for i, k in enumerate(sorted(words) * 20)] + [(900, "x y", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    mixed = text("aa", 12) + " " + text("bb", 30)
    docs = [(1, text("bb", 9), "q"), (2, mixed, "q"), (3, None, "q"), (4, "12 -- 3", "q"), (5, "«» –", "q"), (6, text("cc", 2), "q"), (7, "", "q"), (7, "", "q"), (8, "漢", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(2)
    rows = language.identify(df, model, carry=["score"]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7)] == ["bb", "bb", "und", "und", "und", "cc", "und"]
    assert got[3].score == 0 and 0 < got[2].score < 1 and got[6].score == 1
    spans = got[2].spans
    assert [s.lang for s in spans] == ["aa", "bb"]
    assert abs(mixed.encode()[: spans[0].end].count(b" ") - 11) <= 2
    assert got[8].lang_pred in words
    assert language.fit(df.limit(0).withColumn("lang", F.lit("a"))) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    part = quality_model.id_number("doc_id", 5)
    model = language.fit(docs.where(part != 0))
    out = language.identify(docs.where(part == 0), model, carry=["lang"])
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    part = quality_model.id_number("doc_id", 5)
    model = quality_model.fit(docs, labels.where(part != 0))
    out = quality_model.score_quality(docs.where(part == 0), model).join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    auc = sum((good > b).mean() for b in bad) / len(bad)
    assert auc > 0.95 and out.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "a b c", "!!", "a b c", "\n", "é"])], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    both = spark.createDataFrame([(2, 1), (4, 1), (3, 0), (1, 0), (0, 0)], "doc_id long, quality int")
    assert {r.score for r in quality_model.score_quality(docs, quality_model.fit(docs, none)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in quality_model.score_quality(docs, quality_model.fit(docs, one)).collect())
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, quality_model.fit(docs, both), carry=["score"]).collect()}
    assert len(got) == 7 and got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    assert quality_model.score_quality(docs.limit(0), quality_model.fit(docs, both)).collect() == []


def test_the_sample_of_the_fit_is_bounded_in_bytes(spark):
    """Twice the bytes that a fit may take: about half of the ids are learnt from; a text beyond max_bytes never is."""
    from vectide.llm import quality_model

    docs = spark.createDataFrame([(k, "good words here. " * 40 if k % 2 else "BAD !! " * 90) for k in range(400)] + [(9999, "long " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(9999, 1)], "doc_id long, quality int")
    total = sum(len(r.text) for r in docs.where("doc_id < 9999").collect())
    whole = quality_model.fit(docs, labels, max_bytes=20_000)
    same = quality_model.fit(docs, labels, max_bytes=20_000, sample_bytes=total)
    half = quality_model.fit(docs, labels, max_bytes=20_000, sample_bytes=total // 2)
    one = quality_model.fit(docs, labels, max_bytes=20_000, sample_bytes=1)
    score = lambda m: [r.score for r in quality_model.score_quality(docs, m).orderBy("doc_id").collect()]
    assert score(whole) == score(same) != score(half) and one.net is None
    assert all((x > 0.5) == bool(k % 2) for k, x in enumerate(score(half)[:400]))
