"""Near duplicates among rows that share an id, or have none."""

import corpus_pipeline


def text(seed, n=60):
    return " ".join(f"{seed}{k}" for k in range(n))


def near(seed):
    return text(seed) + " end"


def test_near_duplicates_by_row(spark):
    rows = [
        (3, text("a")), (7, near("a")), (7, text("clean")),  # only the copied text of id 7 goes
        (9, text("b")), (9, near("b")), (9, near("b")),  # near copies of one id
        (None, text("c")), (None, near("c")),  # near copies without an id
        (None, near("a") + " too"), (None, text("d")), (11, near("d")),  # a row with an id stays rather than one without
        (5, ""), (5, ""), (6, "--"), (5, None), (5, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "l", str(i), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect()]
    # Of near copies with one id, or none, one stays, the same in every run.
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, r.text)) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(2), "").collect())
    got = [(i, {near("b"): text("b"), near("c"): text("c")}.get(t, t)) for i, t in got]
    want = [(3, text("a")), (7, text("clean")), (9, text("b")), (None, text("c")), (11, near("d")), (5, ""), (6, "--"), (5, None), (None, "")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    rest = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert all(r.source == str(r.doc_id) and r.n_chars == len(r.text or "") for r in rest)
