"""Language labels against all label sequences, and quality scores against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from vectide.llm import language, quality_model
from vectide.llm.textnp import byte_hashes, packed


def test_viterbi_against_all_sequences():
    rnd = np.random.default_rng(4)
    for kinds, penalty in ((2, 1.5), (3, 0.7), (3, 6.0)):
        model = language.Model([f"l{k}" for k in range(kinds)], np.ones((kinds, language.BUCKETS)), np.ones((kinds, 14)), penalty)
        counts = np.array([0, 1, 5, 7, 0, 3, 6])
        e = rnd.normal(0, 2, (counts.sum(), kinds)).astype(np.float32)
        got = model.viterbi(e, counts)
        for a, n in zip(np.cumsum(counts) - counts, counts):
            value = lambda path: sum(e[a + k, y] for k, y in enumerate(path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))
            best = max(itertools.product(range(kinds), repeat=int(n)), key=value)
            assert math.isclose(value(got[a : a + n].tolist()), value(best), abs_tol=1e-4)


def test_word_scores_and_scripts():
    """Scores of words are sums of the model's log-probabilities of their trigrams; a script that only one language has leaves only it."""
    rnd = np.random.default_rng(5)
    scripts = np.zeros((2, 14))
    scripts[0, 0] = scripts[1, 2] = 10  # Latin and Cyrillic
    model = language.Model(["aa", "bb"], rnd.integers(0, 50, (2, language.BUCKETS)), scripts, 6.0)
    data, off = packed(pa.array(["Kral да x", None, "мир"]))
    w, e = model.emissions(data, off)
    table = model.table
    for k in range(len(w)):
        word = w.data[w.start[k] : w.end[k]].tobytes()
        ext = b" " + word + b" "
        want = np.zeros(2)
        for a, b, c in zip(ext, ext[1:], ext[2:]):
            want += table[((((a << 16) | (b << 8) | c) * 2654435761) & 0xFFFFFFFF) >> 17]
        other = 1 if word.decode().isascii() else 0
        want[other] -= 1000
        assert np.allclose(e[k], want, rtol=1e-4)
    lang, score, _ = language.labelled(model, np.array(["aa", "bb", "und"], object), data, off)
    assert lang.to_pylist() == ["aa", "und", "bb"] and score.to_pylist() == [5 / 9, 0, 1]


def tokens(text):
    return re.findall(rb"\n|[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())


def shape(w, before):
    if w == before:
        return quality_model.REPEAT
    a, b = w[0], w[1] if len(w) > 1 else w[0]
    up = lambda x: 65 <= x < 91
    if a == 10:
        return 5
    if a < 128 and not chr(a).isalnum():
        return 4
    return 3 if 48 <= a < 58 else 2 if up(a) and up(b) and len(w) > 1 else 1 if up(a) else 0


def test_quality_score_by_loops():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Good", "prose", "runs", "on", "WIN", "cash", "!!!", "77", "é", "\n", "wörd,"]) for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    labels = np.array([int("WIN" not in t) for t in texts])
    model = quality_model.fit_rows(pa.array(texts), labels, min_count=2, epochs=20)
    data, off = packed(pa.array([*texts, "", "unseen Unseen UNSEEN 12 ?!"]))
    got = model.score(data, off)
    mean, std, w1, b1, w2, b2 = model.net
    place = {int(h): k for k, h in enumerate(model.vocab)}
    for text, s in zip([*texts, "", "unseen Unseen UNSEEN 12 ?!"], got):
        total, seq = np.zeros(model.vectors.shape[1]), tokens(text)
        for k, w in enumerate(seq):
            x = np.frombuffer(w, np.uint8)
            h = int(byte_hashes(x, np.array([0]), np.array([len(x)]))[0])
            kind = shape(w, seq[k - 1] if k else None)
            total += model.vectors[place[h] + quality_model.SHAPES if h in place and kind != quality_model.REPEAT else kind]
        z = np.maximum(((total / max(len(seq), 1)) - mean) / std @ w1 + b1, 0) @ w2 + b2
        assert math.isclose(s, 1 / (1 + math.exp(-z / model.temperature)), rel_tol=1e-3, abs_tol=1e-4)
    assert np.mean((got[:60] > 0.5) == labels) > 0.9
