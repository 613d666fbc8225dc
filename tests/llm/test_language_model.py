import math
import os
import random
import re
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm.language_model import MIX, PRIOR, score_texts
from vectide.llm.quality_model import id_number
from vectide.llm.textnp import mix64

DATA = "/root/testdata/sf0.01"


def brute(docs):
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()) + [None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    c = Counter(x for i, t in docs if not held(i) for x in tok(t))
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok(t))) for i, t in docs}


def check(rows, docs):
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        held, n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)


def test_base_and_edges(spark):
    docs = [(i, t) for i, t in enumerate([None, "", "a B a", "\t x\x1c", "é É b"] + [f"the w{k % 7} runs. The end{k}" for k in range(30)])] + [(None, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("train", F.lit("x")).repartition(3)
    held = id_number("doc_id", 5) == 1
    for rounds, n in ((1, 2), (2, 3)):
        rows = score_texts(df, held, classes=4, rounds=rounds, n=n).collect()
        check(rows, docs)
        assert all(r.score < 0 for r in rows)
    assert score_texts(df.limit(0), held).collect() == []
    rows = score_texts(df, F.lit(True), n=2).collect()
    assert all(r.score == r.base_score and r.train_tokens == 0 for r in rows)


def model(docs, classes, rounds, gain):
    """The class model by plain dictionaries: score of a text, and the likelihood after each round. Its probabilities must sum to one."""
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
    train = [tok(t) for _, t in docs]
    count = Counter(w for t in train for w in t)
    end, unknown = "end", "unknown"

    def start(w):
        two = w[-1] * 256 + (w[-2] if len(w) > 1 else 0)
        return int(mix64(np.array([two], np.uint64))[0] % np.uint64(classes))

    def bigrams(z, once=None):
        b = Counter()
        for t in train:
            c = [end, *[(once or {}).get(w, z[w]) for w in t], end]
            b.update(zip(c, c[1:]))
        return b

    def likelihood(b):
        x = lambda ns: sum(n * math.log(n) for n in ns if n)
        left, right = Counter(), Counter()
        for (p, q), n in b.items():
            left[p] += n
            right[q] += n
        return x(count.values()) + x(b.values()) - x(left.values()) - x(right.values())

    def moved(z, b):
        known = [*range(classes), end]
        s = lambda p, q: b[p, q] + 0.5
        row = {p: sum(s(p, q) for q in known) for p in known}
        col = {q: sum(s(p, q) for p in known) for q in known}
        out = {}
        for w in z:
            score = [0.0] * classes
            for t in train:
                c = [end, *[z[x] for x in t], end]
                for k, x in enumerate(t):
                    if x == w:
                        for y in range(classes):
                            score[y] += math.log(s(c[k], y) / col[y]) + math.log(s(y, c[k + 2]) / row[y])
            best = max(range(classes), key=lambda y: (score[y], -y))
            out[w] = best if score[best] > score[z[w]] else z[w]
        return out

    z = {w: start(w) for w in count}
    values = [likelihood(bigrams(z))]
    for k in range(rounds):
        new = moved(z, bigrams(z))
        values.append(likelihood(bigrams(new)))
        if values[-1] < values[-2]:
            break
        z = new
        if values[-1] - values[-2] < gain * abs(values[-2]):
            break
    b, once = bigrams(z), {w: unknown for w in count if count[w] == 1}
    total = Counter(b)
    both = bigrams(z, once)
    for t in train:
        c = [end, *[z[w] for w in t], end]
        for k, w in enumerate(t):
            if count[w] == 1:
                total[c[k], unknown] += 1
                total[unknown, c[k + 2]] += 1
    total[unknown, unknown] += both[unknown, unknown]
    known = [*range(classes), end]
    size = {q: sum(b[p, q] for p in known) for q in known}
    n, kinds = sum(size.values()), [*known, unknown]
    everything = sum(total.values())
    share = {q: sum(total[p, q] for p in kinds) / everything for q in kinds}
    row = {p: sum(total[p, q] for q in kinds) for p in kinds}
    step = lambda p, q: (total[p, q] + PRIOR * share[q]) / (row[p] + PRIOR)
    base = lambda c: (c + 0.5) / (n + 0.5 * (len(count) + 2))

    def chance(p, w):
        """Of the word (or end) after class p."""
        if w == end:
            return MIX * step(p, end) + (1 - MIX) * base(size[end])
        return MIX * step(p, z[w] if count[w] else unknown) * (count[w] / size[z[w]] if count[w] else 1.0) + (1 - MIX) * base(count[w])

    def score(text):
        c = [end, *[z[w] if count[w] else unknown for w in tok(text)]]
        return sum(math.log10(chance(p, w)) for p, w in zip(c, [*tok(text), end]))

    for p in kinds:  # all words, the end and one unknown word
        assert math.isclose(sum(chance(p, w) for w in [*list(z), end, b"never seen"]), 1, rel_tol=1e-9)
    return score, values


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    kinds = [[f"{c}{k}{rnd.choice('xyz')}" for k in range(6)] for c in "nvad"]
    return [(i, " ".join(rnd.choice(kinds[(p + rnd.randint(0, 1)) % 4]) for p in range(rnd.randint(0, 12)))) for i in range(n)] + [(n, "once more"), (n + 1, None)]


def test_score_by_brute_force(spark):
    docs = corpus()
    held = [(1000, "n0x v1y never seen a2z"), (1001, ""), (1002, "once d1x")]
    df = spark.createDataFrame(docs + held, "doc_id long, text string").repartition(3)
    for rounds, gain in ((1, 0.01), (3, 0.0), (6, 0.02)):
        score, values = model(docs, 4, rounds, gain)
        got = {r.doc_id: r.score for r in score_texts(df, F.col("doc_id") >= 1000, classes=4, rounds=rounds, gain=gain, n=3).collect()}
        for i, t in docs + held:
            assert math.isclose(got[i], score(t), rel_tol=1e-5, abs_tol=1e-5), (rounds, i, values)


def test_guard_warns(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    with pytest.warns(UserWarning, match="guard of 1 rounds"):
        score_texts(df, F.lit(False), classes=4, rounds=1, gain=0.0, n=2)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_each_round_lowers_perplexity(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    before = None
    for rounds in (1, 2, 3):
        rows = score_texts(docs, id_number("doc_id", 5) == 1, rounds=rounds, gain=0.0).collect()
        now = [-sum(r.score for r in rows if r.held_out == h) / sum(r.n_tokens for r in rows if r.held_out == h) for h in (False, True)]
        assert before is None or (now[0] < before[0] and now[1] < before[1])
        before = now


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_beats_base(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)  # the gain stops the rounds, not the guard
        rows = score_texts(docs, id_number("doc_id", 5) == 1).collect()
    held = [r for r in rows if r.held_out]
    for out, most in ((False, 2943), (True, 1003)):
        own = [r for r in rows if r.held_out == out]
        assert 10 ** (-sum(r.score for r in own) / sum(r.n_tokens for r in own)) < most
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
