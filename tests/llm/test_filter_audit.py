"""The filter audit against every order of the filters applied to every document."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from vectide.llm import filter_audit as A


def brute(docs, labels):
    docs = [(i, t or "", s or "") for i, t, s in docs]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    tests = {
        "A": lambda i, t: len(words(t)) < 200,
        "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda i, t: i is not None and any(j is not None and j < i and u == t for j, u, _ in docs),
    }
    fails = [{f for f in tests if tests[f](i, t)} for i, t, _ in docs]
    good = [any(i is not None and j == i and q == 1 for j, q, _ in labels) for i, *_ in docs]
    toxic = [any(i is not None and j == i and x == 1 for j, _, x in labels) for i, *_ in docs]
    out = {}
    for part in {s for *_, s in docs}:
        rows = [k for k, d in enumerate(docs) if d[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(rows)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left - gone), len(gone), sum(f in fails[k] for k in rows if k not in left), sum(fails[k] == {f} for k in rows), sum(good[k] for k in gone), sum(toxic[k] for k in gone)]
                left -= gone
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def result(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, mask int").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = A.audit(A.cells(A.fail_masks(docs), labels)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_all_orders(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "one", "A B C", "x " * 250, "café\x1cé " * 300, "100 % sure"]
    texts += [" ".join(rnd.choice(["word", "Word", "w#", "é"]) + str(rnd.randint(0, n)) for _ in range(m)) for n in (9, 3000) for m in (150, 199, 200, 201, 260) for _ in range(2)]
    texts += [" ".join(f"w{k // 2}" for k in range(400)), " ".join(f"w{k % 199}" for k in range(400)), "AB" + "x" * 98, "ABC" + "x" * 97, "y " * 200_000]
    docs = [(i, rnd.choice(texts), rnd.choice(["a", "b", None, ""])) for i in range(120)]
    docs += [(None, "one", "a"), (None, "", "a"), (5, docs[5][1], "b"), (5, docs[5][1], "b"), (-3, "one", "c")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 100, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert result(spark, [], []) == {}
    got = result(spark, [(1, "x", None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_each_order_once(n):
    order, seen = list(range(n)), []
    for p in [None, *A.swaps(n)]:
        if p is not None:
            order[p], order[p + 1] = order[p + 1], order[p]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_shapley_shares_what_all_filters_remove():
    rnd = np.random.default_rng(1)
    n = rnd.integers(0, 50, (4, 32))
    orders, counts, shapley = A.walked(n, n, n, 5)
    assert (shapley.sum(1) == len(orders) * (n.sum(1) - n[:, 0])).all() and (counts[..., 1] == counts[..., 3]).all()
