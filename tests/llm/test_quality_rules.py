import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from vectide.llm import quality_rules, textnp
from vectide.llm.quality_rules import apply_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for p in range(len(w) - 7):
        windows.setdefault(tuple(w[p : p + 8]), []).append(p)
    rep = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", "\n\n", " x", "a\na\n a\n\na", "#|é x " * 30]
    for _ in range(80):
        body = [rnd.choice(["wort", "ünd", "a", "b#", "the", "|", "c$", "end."]) + (str(rnd.randint(0, 60)) if rnd.random() < 0.7 else "") for _ in range(rnd.randint(0, 80))]
        text = "".join(x + rnd.choice([" ", " ", "\n", "\t"]) for x in body)
        texts.append(text + text[: rnd.randint(0, len(text))] * rnd.randint(0, 2))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in apply_quality_rules(df, carry=["kept"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_verdicts_and_order(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(5)]
    junk = [" ".join(word() + "###" for _ in range(60)), " ".join(word().upper() + "!!" for _ in range(60)), "\n".join([clean[0][:40], word()] * 30)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    a = {r.doc_id: r.kept for r in apply_quality_rules(df).collect()}
    b = {r.doc_id: r.kept for r in apply_quality_rules(df, order=list(quality_rules.RULES)[::-1]).collect()}
    assert a == b == {i: i < 5 for i in range(8)}
    assert apply_quality_rules(df.limit(0)).collect() == []


def test_what_was_counted_is_kept():
    """Counts carried from texts to some of them equal counts made anew, and each rule's own counts are right."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("a b c é# D!\n \n12".split(" ")) for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    data, off = textnp.packed(pa.array(texts))
    t = quality_rules.Texts(data, off)
    quality_rules.base_failed(t), t.word_chars, t.n_symbols, t.lines
    keep = np.array([k % 3 > 0 for k in range(30)])
    some = t.take(keep)
    new = quality_rules.Texts(*textnp.packed(pa.array([x for x, k in zip(texts, keep) if k])))
    for name, rule in quality_rules.RULES.items():
        assert (rule(some) == rule(new)).all(), name
    for n in (1, 2, 3):
        want = [max(Counter(tuple(w[p : p + n]) for p in range(len(w) - n + 1)).values(), default=0) for w in (re.findall(r"[^\x20\x09-\x0D]+", x) for x in texts)]
        assert quality_rules._top_gram(t, n).tolist() == want
    for x, e in zip(texts, quality_rules._entropy(t)):
        p = [c / len(x.encode()) for c in Counter(x.encode()).values()]
        assert abs(e + sum(q * np.log2(q) for q in p)) < 1e-9


def test_only_empty_texts(spark):
    rows = apply_quality_rules(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.n_words, r.n_dup_lines, r.base_failed, r.kept) for r in rows] == [(0, 0, True, False)] * 2


def test_thue_morse(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    df = spark.createDataFrame([(1, a + "\n" + a.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert apply_quality_rules(df).first().n_dup_lines == 0
