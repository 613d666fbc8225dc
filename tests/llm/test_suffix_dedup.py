import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vectide.llm import exchange as X
from vectide.llm import suffix_dedup, textnp
from vectide.llm.suffix_dedup import dedup_bytes, equal_groups


def brute(docs, k):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            if b[p : p + k] in seen:
                gone[p : p + k] = True
            seen.add(b[p : p + k])
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def test_groups():
    rnd = np.random.default_rng(1)
    for n, sigma, k in ((5, 2, 3), (200, 2, 5), (3000, 3, 9), (50, 1, 7), (400, 250, 2)):
        text = rnd.integers(1, sigma + 1, n).astype(np.uint8)
        order, group = equal_groups(text, k)
        word = [np.roll(text, -s)[:k].tobytes() for s in order]
        assert word == sorted(word)
        assert [a == b for a, b in zip(word, word[1:])] == (group[1:] == group[:-1]).tolist()


def documents(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdé ") for _ in range(700))
    docs = [(1, None), (2, ""), (3, "x" * 400), (3, "x" * 400), (4, "ab" * 150), (None, base[:300])]
    for i in range(5, 50):
        text = "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 80)))
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 500)
            text += base[a : a + rnd.randint(20, 260)] + rnd.choice(["", "q", "zz"])
        docs.append((i, text))
    return docs + [(60, docs[-1][1]), (61, docs[-1][1]), (62, docs[-2][1][:-40] + "!" + docs[-2][1][-40:])]


def collected(df, **kw):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_bytes(df, **kw).collect())


def test_against_brute_force(spark):
    for seed, k in ((1, 100), (2, 20), (3, 41)):
        docs = documents(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert collected(df, length=k, n=3) == brute(docs, k)


def local(docs, length=100, n=3, r=2, hot=5000):
    """The steps of dedup_bytes in this process, so that parts of them can be replaced."""
    by_key = lambda table, name: {k: table.filter(pc.equal(table[name], k)) for k in table[name].unique().to_pylist()}
    rows = [(i, t, zlib.crc32((t or "").encode()), zlib.crc32(repr((i, t)).encode()) % n) for i, t in docs]
    batch = pa.table(list(zip(*rows)), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("h", pa.int64()), ("chunk", pa.int32())])).to_batches()
    chunks = by_key(pa.Table.from_batches(list(X._pack(batch))), "chunk")
    records = pa.concat_tables([suffix_dedup._scan(t, r, length) for t in chunks.values()])
    answers = by_key(pa.concat_tables([suffix_dedup._compare(t, hot) for t in by_key(records, "dest").values()]), "dest")
    none = X.rows([])
    texts = pa.concat_tables([suffix_dedup._ship(t, answers.get(c, none), r, length) for c, t in chunks.items()])
    repeats = by_key(pa.concat_tables([suffix_dedup._transform(t, length) for t in by_key(texts, "dest").values()]), "dest")
    out = pa.concat_tables([suffix_dedup._remove(t, repeats.get(c, none), length) for c, t in chunks.items()])
    return sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept"]) for x in out.to_pylist())


def test_hot_keys_and_small_texts(spark, monkeypatch):
    docs = documents(7)
    want = brute(docs, 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert collected(df, n=4, hot=1) == want  # every key is hot
    assert dedup_bytes(df.limit(0)).collect() == []
    assert local(docs) == local(docs, hot=1) == want
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 500)
    assert local(docs) == want


def test_all_repeats_come_from_the_transform(monkeypatch):
    """Without grouping of copies by content, what the transform says is all that is removed; with one that finds nothing, nothing is."""
    docs = documents(9)

    def all_new(data, key, start, size, hashes=None):
        order = np.argsort(key, kind="stable")
        return order, np.ones(len(order), bool)

    def parted(text, length):
        order, group = equal_groups(text, length)
        return order, np.arange(len(group))

    monkeypatch.setattr(suffix_dedup, "distinct_bytes", all_new)
    assert local(docs) == brute(docs, 100)
    monkeypatch.setattr(suffix_dedup, "equal_groups", parted)
    assert not any(r[2] for r in local(docs))


def test_equal_hashes_remove_nothing(monkeypatch):
    """Where all hashes of contents collide, bytes decide."""
    docs = documents(5)
    want = brute(docs, 100)
    for module in (suffix_dedup, textnp):
        monkeypatch.setattr(module, "byte_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    assert local(docs) == want


def test_thue_morse(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    docs = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, "c" + a)]
    assert local(docs) == brute(docs, 100)
    assert local(docs, length=255) == brute(docs, 255)
