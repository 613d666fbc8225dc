import hashlib
import random
import re
from collections import Counter

import numpy as np

from vectide.llm import substring
from vectide.llm.substring import dedup_substrings


def brute(docs, k):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in docs}
    seen = Counter(tuple(w[p : p + k]) for w in words.values() for p in range(len(w) - k + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if seen[tuple(w[p : p + k])] > 1:
                gone.update(range(p, p + k))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(base) for _ in range(90)]
    docs = [(1, None), (2, ""), (3, " \t "), (4, "a b"), (5, "x " * 80)]
    for i in range(6, 40):
        body = [rnd.choice(base) for _ in range(rnd.randint(0, 90))]
        cut = rnd.randint(0, 50)
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(body + passage[cut : cut + rnd.randint(10, 60)] + body[:5] + ["é"] * rnd.randint(0, 3))))
    docs += [(100, docs[-1][1]), (101, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, hot in ((1, 5000), (8, 5000), (35, 5000), (8, 3), (35, 1)):
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(df, k, n=3, hot=hot).collect()}
        assert got == brute(docs, k)


def test_extension_of_hits():
    """Against all pairs of places, on stretches of few different words."""
    rnd = np.random.default_rng(2)
    for window, block in ((5, 3), (7, 4), (35, 18)):
        for _ in range(20):
            n = int(rnd.integers(2, 40))
            before, after = rnd.integers(0, window - block + 1, n), rnd.integers(block, window + 1, n)
            words = [rnd.choice(3, b + a, p=[0.9, 0.05, 0.05]) for b, a in zip(before, after)]
            key = rnd.integers(0, 3, n).astype("u8")
            bounds = np.concatenate([[0], np.cumsum(before + after)])
            got = substring.extended(np.concatenate(words), bounds, key, before, window)
            for i in range(n):
                for left in range(before.max() + 1):
                    at = before[i] - left
                    mine = words[i][at : at + window].tolist() if at >= 0 else []
                    want = len(mine) == window and any(
                        i != j and key[i] == key[j] and before[j] >= left and words[j][before[j] - left : before[j] - left + window].tolist() == mine for j in range(n)
                    )
                    assert bool(got[i, left]) == want


def test_thue_morse_words(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"{tail} {a} {tail}"), (2, f"{tail} {b} {tail}"), (3, f"{tail} {b} {tail} {a}")]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 35, n=2).collect()}
    assert got == brute(docs, 35) and got[1][1] == 0 and got[2][1] == 41


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words int")
    assert dedup_substrings(empty, carry=["n_words"]).collect() == []
    twice = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c e", "y")], "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.n_removed, r.lang, [tuple(s) for s in r.spans]) for r in dedup_substrings(twice, 3, carry=["lang"]).collect())
    assert got == [("1", 4, "x", [(0, 4)]), ("1", 4, "x", [(0, 4)]), ("None", 3, "y", [(0, 3)])]
