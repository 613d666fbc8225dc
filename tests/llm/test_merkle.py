"""Merkle manifests against a plain tree, and the filter audit's walk against all orders counted anew."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vectide.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """Root and proofs (lists of (side, sibling)) of a list of nodes."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, j in enumerate(at):
            run = nodes[j - j % 2 : j - j % 2 + 2]
            proofs[k].append((j % 2, run[1 - j % 2] if len(run) == 2 else ""))
            at[k] = j // 2
        nodes = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
    return nodes[0], proofs


def brute(rows):
    """Expected rows (as repr, sorted) of (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(plain_tree([leaf_of(r) for r in parts[name]]))
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for name, (sub, proofs), up in zip(names, trees, above):
        for r, proof in zip(parts[name], proofs):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            cur = leaf_of((*r[:3], r[3] + 1, r[4]) if touched else r)
            for right, s in proof + up:
                cur = H(s, cur) if right else H(cur, s)
            out.append(repr((r[0], leaf_of(r), sub, root, H(*[s for _, s in proof + up]), cur, cur == root)))
    return sorted(out)


def manifest(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf_", F.lit(1)).withColumn("i", F.lit("x")).repartition(3)
    own = [F.col(c) for c in ("doc_id", "source", "lang")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    df = df.select("*", merkle.leaf(*own, F.col("n_chars"), F.col("text")).alias("leaf"), F.when(touched, merkle.leaf(*own, F.col("n_chars") + 1, F.col("text"))).alias("other"))
    return merkle.manifest(df, other_col="other", k=k)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("k", [2, 12])
def test_against_plain_tree(spark, k):
    rnd = random.Random(k)
    rows = [(i, f"s{i % 3}" if i % 5 else None, rnd.choice(["en", "de", None, "", "é", "EN"]) if i > 40 else "en", i if i % 9 else None, rnd.choice([None, "", "ü" * 5, f"text {i}"])) for i in range(150)]
    rows += [(2**53 + 1, "s", "en", 1, "big"), (2**53 + 2, "s", "en", 1, "big"), (None, "s", "en", 5, "no id"), (None, "s", "fr", None, None), (7, "s", "en", 3, "same id"), (7, "s", "en", 3, "other text"), (9, "s", "de", 1, "x" * 300_000)]
    rows += [(300, "s", "en", 2, "repeated")] * 20  # equal rows
    got = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in manifest(spark, rows, k).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_small_and_ragged(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)] + [(100 + i, "s", f"l{i}", 1, "t") for i in range(n - 1)]
    got = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in manifest(spark, rows, 1).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert manifest(spark, [], 2).collect() == []


def test_steps_round_trip_and_tampering(spark):
    """The stored proof alone tells any changed leaf or sibling from the true ones."""
    rows = [(i, "s", "ab"[i % 2], 1, str(i)) for i in range(11)]
    for r in manifest(spark, rows, 2).collect():
        steps = merkle.unpacked_steps(bytes(r.steps))
        assert merkle.packed_steps(steps) == bytes(r.steps)
        assert merkle.folded(r.leaf.encode(), steps).decode() == r.root
        assert merkle.folded(H("x").encode(), steps).decode() != r.root
        for j, s in enumerate(steps):
            if s[:1] != merkle.ALONE:
                assert merkle.folded(r.leaf.encode(), [*steps[:j], s[:1] + H("x").encode(), *steps[j + 1 :]]).decode() != r.root


def test_field_is_unambiguous(spark):
    rows = [("a", "1:b"), ("a1:b", None), (None, "-"), ("-", None), ("", None), (None, "")]
    got = spark.createDataFrame(rows, "x string, y string").select(merkle.leaf(F.col("x"), F.col("y")).alias("h")).collect()
    assert len({bytes(r.h) for r in got}) == len(rows)
