"""Matches of decontamination against a list of all maximal matches by brute force."""

import random

import numpy as np
import pyarrow as pa
from test_decontaminate import words

from vectide.llm import decontaminate, textnp
from vectide.llm.textnp import ALNUM, Words, packed


def brute(text, item, k):
    a, b, out = words(item), words(text), set()
    k = min(k, len(a))
    for i in range(len(a) if k else 0):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1] and len(a) > k:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= k:
                out.add((i, j, n))
    return out


def tables():
    rnd = random.Random(3)
    pick = lambda n, of: " ".join(rnd.choice(of) for _ in range(n))
    passage = pick(14, [f"w{k}" for k in range(90)])
    items = [("x", "x " * 30), ("aba", f"{passage} between {passage}"), ("short", "q r q"), ("none", "--")]
    items += [(f"i{k}", pick(rnd.choice([9, 10, 25, 60]), "ab")) for k in range(12)]
    docs = [(0, "x " * 30), (1, f"{passage} between {passage}"), (2, f"{passage} other {passage}"), (3, "q r q r q"), (4, None), (5, "x " * 45 + "y " + "x " * 12)]
    return items, docs + [(10 + k, pick(80, "ab")) for k in range(8)]


def test_all_longest_matches(spark):
    items, docs = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for k in (10, 4):
        for r in decontaminate.find_contamination(d, b, k).collect():
            got = [(m.item_id, m.item_start, m.doc_start, m.length) for m in r.matches]
            want = {(i, *m) for i, t in items for m in brute(dict(docs)[r.doc_id] or "", t, k)}
            assert len(got) == len(set(got)) and set(got) == want


def test_slices_of_pairs(monkeypatch):
    items, docs = tables()
    index = decontaminate.Index([i for i, _ in items], [t for _, t in items], 4)
    shard = decontaminate.Shard(Words(*packed(pa.array([t for _, t in docs], pa.string())), ALNUM, lower=True), 4)
    whole = [x.tolist() for x in decontaminate.found(index, shard)]
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    assert whole[2] and whole == [x.tolist() for x in decontaminate.found(index, shard)]


def test_suffix_array():
    rnd = np.random.default_rng(1)
    for n, kinds, depth in ((0, 3, 4), (1, 3, 4), (60, 3, 8), (200, 2, 200), (300, 50, 3)):
        number = rnd.integers(0, kinds + 2, n)
        sa = decontaminate.suffix_array(number, depth)
        assert sorted(sa.tolist()) == list(range(n))
        alone = {p: (0, p) for p in range(n) if number[p] < decontaminate.FIRST}  # these differ from all others, and sort first
        key = lambda p: [alone.get(q, (1, int(number[q]))) for q in range(p, min(p + depth, n))]
        assert [key(p) for p in sa] == sorted(key(p) for p in range(n))


def test_words_of_equal_hash(monkeypatch):
    """Where all words' hashes collide, their bytes decide."""
    items, docs = tables()
    texts = pa.array([t for _, t in docs], pa.string())

    def matches():
        shard = decontaminate.Shard(Words(*packed(texts), ALNUM, lower=True), 4)
        return [x.tolist() for x in decontaminate.found(decontaminate.Index(*zip(*items), 4), shard)]

    want = matches()
    monkeypatch.setattr(textnp, "byte_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    got = matches()
    assert got[:2] == want[:2] and sorted(got[2]) == sorted(want[2])


def test_thue_morse(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    d = spark.createDataFrame([(1, a.translate(str.maketrans("ab", "ba"))), (2, a)], "doc_id long, text string")
    got = decontaminate.find_contamination(d, spark.createDataFrame([(1, a)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 0, 2: 1}
