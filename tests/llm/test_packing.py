import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import pretokens
from vectide.llm.packing import default_tokenizer, pack_documents, plan
from vectide.llm.pretokens import encoder
from vectide.llm.textnp import packed

ENC = encoder(default_tokenizer())


def ids(texts):
    return [e.ids for e in ENC.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'streé \n\t 1９!#'lvmd中　​|", max_size=24), max_size=6))
def test_pretokens(texts):
    flat, bounds = ENC.encode(*packed(pa.array(texts, pa.string())))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a<|endoftext|>b"]
    flat, bounds = ENC.encode(*packed(pa.array(texts, pa.string())))
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == ids(texts)


def test_thue_morse_and_equal_hashes(monkeypatch):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts = [a, a.translate(str.maketrans("ab", "ba")), "a few words, a few more"]
    ENC.clear()
    for _ in range(2):
        flat, bounds = ENC.encode(*packed(pa.array(texts, pa.string())))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == ids(texts)
        ENC.clear()
        monkeypatch.setattr(pretokens, "byte_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    ENC.clear()


def test_other_tokenizers():
    """Whatever the tokenizer's split is, its own ids come out."""
    folder = os.path.dirname(default_tokenizer())
    texts = ["Some words don't  split\nalike ", "", "été 12 345!"]
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json") and "bpe" in name:
            e = encoder(os.path.join(folder, name))
            flat, bounds = e.encode(*packed(pa.array(texts, pa.string())))
            assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plan_holds_histogram():
    rnd = np.random.default_rng(1)
    for size, n in ((16, 50), (64, 5000), (1024, 20000), (1024, 0)):
        hist = np.bincount(rnd.integers(1, size + 1, n), minlength=size + 1)
        got, lengths = np.zeros_like(hist), 0
        for pat, many in plan(hist, size):
            assert sum(pat) <= size and many > 0
            lengths += many
            for v in pat:
                got[v] += many
        assert (got == hist).all()
        assert lengths <= 1.01 * (hist * np.arange(size + 1)).sum() / size + 2 or n < 100


def test_packs_whole_texts(spark):
    rnd = random.Random(4)
    texts = [None, "", "x"] + ["".join(rnd.choice(["the ", "of\n", "é", "word", " 12", "'s "]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    docs = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, piece int").repartition(4)
    rows = pack_documents(df, size=64, with_ids=True).collect()
    want = {i: x + [2] for i, x in enumerate(ids([t or "" for t in texts]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids == want[r.doc_id][r.start : r.start + r.length] and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in want.items():
        own = sorted(by_doc[i])
        assert sum(p[2] for p in own) == len(x) * (21 if i == 5 else 1)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_seq) <= 1.05 * sum(r.length for r in rows) / 64 + 1
    assert pack_documents(df.limit(0)).collect() == []
