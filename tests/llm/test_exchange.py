"""Sizes of chunks and key ranges: by the session's settings, or given; results don't depend on them."""

import pytest

from vectide.llm import exchange
from vectide.llm.substring import dedup_substrings


@pytest.fixture()
def sizes(spark):
    yield lambda chunk, keys: (spark.conf.set(exchange.CHUNK_SETTING, chunk), spark.conf.set(exchange.RANGE_SETTING, keys))
    spark.conf.unset(exchange.CHUNK_SETTING)
    spark.conf.unset(exchange.RANGE_SETTING)


def test_sizes_are_settings(spark, sizes):
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "doc_id long, text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert exchange.partitions(docs) == (least, least)
    assert exchange.partitions(docs, 6) == (6, 3) and exchange.partitions(docs, 6, ranges=6) == (6, 6)
    sizes("5000", "20000")
    assert exchange.partitions(docs) == (20, 5) and exchange.partitions(docs, ranges=2) == (20, 2)
    sizes("0", "20000")
    with pytest.raises(ValueError, match="numbers of bytes"):
        exchange.partitions(docs)


def test_results_do_not_depend_on_sizes(spark, sizes):
    shared = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"own{k} {shared if k % 3 else ''} end{k} " + " ".join(f"q{k}z{j}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    run = lambda: sorted((r.doc_id, r.n_removed, r.kept_text) for r in dedup_substrings(docs, window=35).collect())
    want = run()
    assert sum(n for _, n, _ in want) > 0
    for chunk, keys in (("1500", "9000"), ("9000", "1500")):
        sizes(chunk, keys)
        assert run() == want
