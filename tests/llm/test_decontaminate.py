import random
import re

from pyspark.sql import DataFrame

from vectide.llm import decontaminate
from vectide.llm.decontaminate import find_contamination


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode())


def brute(text, bench, k):
    w, hit, items = words(text), set(), set()
    for i, t in bench:
        x = words(t)
        wins = [x] if 0 < len(x) < k else [x[p : p + k] for p in range(len(x) - k + 1)]
        for v in wins if x else []:
            for p in range(len(w) - len(v) + 1):
                if w[p : p + len(v)] == v:
                    hit.update(range(p, p + len(v)))
                    items.add(str(i))
    return len(w), len(hit), sorted(items), bool(hit)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    pick = lambda n: [rnd.choice(["a", "B", "é", "c1", "dd", "out", "x"]) for _ in range(n)]
    bench = [(i, " ".join(pick(rnd.choice([2, 6, 9, 10, 14, 30])))) for i in range(25)] + [(90, None), (91, "--"), (7, "x x x"), (92, "x " * 30)]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "x " * 60)]
    for i in range(4, 60):
        parts = [rnd.choice([" ", ", ", "-"]).join(pick(rnd.randint(0, 12)))]
        if rnd.random() < 0.6:
            parts.append((rnd.choice(bench)[1] or "").upper())
        docs.append((i, " ".join(parts + pick(3))))
    docs += [docs[-1]] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for k, size in ((10, 10**6), (4, 60), (1, 10**6)):
        rows = find_contamination(d, b, k, index_bytes=size).collect()
        assert len(rows) == len(docs)
        for r in rows:
            text = dict(docs)[r.doc_id]
            assert (r.n_words, r.n_hit, r.items, r.contaminated) == brute(text, bench, k)
            w = words(text)
            for m in r.matches:
                assert any(words(t)[m.item_start : m.item_start + m.length] == w[m.doc_start : m.doc_start + m.length] for i, t in bench if str(i) == m.item_id)
    assert find_contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in find_contamination(d, b.limit(0)).collect())


def test_many_blocks(spark, monkeypatch):
    """The same rows from one block and from ten and more, whose texts never reach the driver; documents are parsed once for all of them."""
    rnd = random.Random(8)
    pick = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    bench = [(None, pick(12))] + [(i % 30, pick(rnd.choice([3, 11, 40]))) for i in range(40)]
    docs = [(i, " ".join([pick(5), rnd.choice(bench)[1], pick(20)])) for i in range(30)] + [(99, pick(3000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(bench, "item_id long, text string").repartition(3)
    whole = sorted(find_contamination(d, b).collect())
    assert len(decontaminate._indexes(b, 10, "item_id", "text", 150)) >= 10

    def refused(self):
        raise AssertionError("rows of the benchmark reach the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", refused)
        m.setattr(type(spark.sparkContext), "broadcast", lambda self, value: refused(self))
        blocks = find_contamination(d, b, index_bytes=150)
    assert sorted(blocks.collect()) == whole and any(r.contaminated for r in whole)
    for r in whole:
        assert (r.n_words, r.n_hit, [x for x in r.items], r.contaminated) == brute(dict(docs)[r.doc_id], [("" if i is None else i, t) for i, t in bench], 10)
