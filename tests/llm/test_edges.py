"""Very long texts, clashing columns and null ids through every operator on documents."""

import random

import pytest
from pyspark.sql import functions as F

from vectide.llm import decontaminate, jaccard, language, language_model, packing, quality_model, quality_rules, substring, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(250_000))  # about 1.4 MB, more than a block
    rows = [(1, long, "en"), (2, long[:5000], None), (3, None, "en"), (None, "a b c", "de"), (4, "", "de"), (5, "x" * 700_000, "en"), (1, "short text", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("chunk", "rows", "task", "rank", "node", "train", "score", "kept", "n_words", "piece", "spans", "i", "y"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(2).cache(), long


def counts(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


WANT = sorted([(False, 1), (False, 2), (False, 3), (True, 0), (False, 4), (False, 5), (False, 1)])


def test_deduplication(docs):
    df, long = docs
    a = suffix_dedup.dedup_bytes(df, n=2)
    assert counts(a) == WANT
    by = {(r.doc_id, r.n_bytes): r for r in a.collect()}
    assert by[2, 5000].n_removed == 5000 and by[1, len(long)].n_removed == 0 and by[5, 700_000].n_removed == 700_000 - 1
    b = substring.dedup_substrings(df, carry=["lang", "score", "spans"], n=2)
    assert counts(b) == WANT and b.columns == ["doc_id", "lang", "score", "n_words", "n_removed", "kept_text", "spans"]
    c = jaccard.similar_components(df, n=2)
    assert counts(c) == WANT


def test_models(spark, docs):
    df, _ = docs
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, quality int")
    assert counts(quality_model.score_quality(df, quality_model.fit(df, labels), carry=["lang", "score"])) == WANT
    assert counts(language.identify(df, language.fit(df), carry=["spans", "rank"])) == WANT
    assert counts(language_model.score_texts(df, F.col("doc_id") == 2, n=2)) == WANT


def test_scans(spark, docs):
    df, long = docs
    assert counts(quality_rules.apply_quality_rules(df, carry=["kept", "rank"])) == WANT
    bench = spark.createDataFrame([(7, " ".join(long.split()[240_000:240_030])), (None, long), (8, None)], "item_id long, text string")
    hits = decontaminate.find_contamination(df, bench, carry=["n_words", "rank"])
    assert counts(hits) == WANT
    assert {r.doc_id: r["items"] for r in hits.where("n_hit > 0").collect()} == {1: ["", "7"], 2: [""]}
    packed = packing.pack_documents(df)
    assert set(counts(packed)) == set(WANT)
