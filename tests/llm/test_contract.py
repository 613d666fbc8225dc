"""Every registered query of the package on small tables, against its contract by brute force, and against its SQL."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_decontaminate import brute as hits_of
from test_jaccard import brute as components_of
from test_language_model import brute as base_of
from test_quality_rules import brute as rules_of
from test_substring import brute as passages_of
from test_suffix_dedup import brute as bytes_of

from vectide.llm.packing import default_tokenizer
from vectide.llm.pretokens import encoder
from vectide.llm.queries import ORACLE_SQL, QUERIES


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def part(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    vocab = {"en": [f"en{k}th" for k in range(60)], "de": [f"{k}ung" for k in "abcdefghij"] + [f"die{k}" for k in range(50)]}
    bench = [(k, " ".join(rnd.choice(vocab["en"]) for _ in range(rnd.choice([4, 12, 30])))) for k in range(8)] + [(50, None), (51, "--")]
    passage = " ".join(rnd.choice(vocab["en"]) for _ in range(50))
    docs = [(1, None, "en"), (2, "", None), (3, "12 34 --", "de"), (4, "﻿# \x1c é\n\n", "en"), (5, "Zwei Wörter", "de")]
    for i in range(6, 70):
        lang = rnd.choice(["en", "de"])
        body = [rnd.choice(vocab[lang]) for _ in range(rnd.randint(1, 90))]
        if i % 9 == 0:
            body += [passage]
        if i % 11 == 0:
            body += [rnd.choice(bench)[1] or ""]
        text = rnd.choice([" ", "\n", "  "]).join(body)
        docs.append((i, text.upper() if i % 13 == 0 else text, lang if i % 7 else None))
    docs += [(100 + k, docs[20 + k][1], "en") for k in range(6)] + [(200 + k, docs[40 + k][1] + " one more word", "de") for k in range(6)]
    talk = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", None, "", "a <|end|>\n b\\", "<|turn user|>\n", "</s>[INST] x [/INST]", "é" * 5])) for c in range(12) for t in range(rnd.randint(1, 5))]
    made = {
        "documents": spark.createDataFrame([(i, t, x, f"s{i % 3}", len(t or "")) for i, t, x in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
        "labels": spark.createDataFrame([(i, int(i % 2), 0) for i, *_ in docs[5:50]], "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
    }
    pages = [(k, f"http://h{k % 3}.org/{k}", f"<html><body><nav><a href=/>Home</a></nav><article><h1>T {k} &amp;c</h1><p><b>{(t or '')[:99].replace('<', '&lt;')}</b><br><p>more &quot;{k}&quot;</p></article><footer>&copy; {k}") for k, (i, t, _) in enumerate(docs)]
    made["pages"] = spark.createDataFrame([*pages, (999, None, None)], "page_id long, url string, html string")
    for name, df in made.items():
        df.repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return folder, [(i, t) for i, t, _ in docs], bench, talk, {i: x for i, _, x in docs}


def result(spark, tables, name):
    rows = QUERIES[name](spark, tables[0]).collect()
    return rows


def test_op1(spark, tables):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, tables, "op1_suffix_array_dedup"))
    assert got == sorted((*x[:4], sha(x[4])) for x in bytes_of(tables[1], 100))


def test_op2(spark, tables):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in result(spark, tables, "op2_ngram_jaccard_join"))
    assert got == components_of(tables[1])


def test_op3(spark, tables):
    rows = result(spark, tables, "op3_language_id")
    text, lang = dict(tables[1]), tables[4]
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert r.held_out == (part(r.doc_id) == 0) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    sure = [r for r in rows if r.held_out and lang[r.doc_id] and len(text[r.doc_id] or "") > 40 and r.doc_id % 9 and r.doc_id % 11 and r.doc_id < 100]
    assert sum(r.lang_pred == lang[r.doc_id] for r in sure) >= 0.9 * len(sure) > 0


def test_op4(spark, tables):
    for r in result(spark, tables, "op4_quality_rules"):
        want = rules_of(dict(tables[1])[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_op5(spark, tables):
    for r in result(spark, tables, "op5_decontamination"):
        n, hit, items, bad = hits_of(dict(tables[1])[r.doc_id], tables[2], 10)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), sha(",".join(sorted(items))), bad)


def test_op6(spark, tables):
    rows = result(spark, tables, "op6_best_fit_packing")
    encode = encoder(default_tokenizer()).tokenizer.encode
    ids = {i: [*encode(t or "", add_special_tokens=False).ids, 2] for i, t in tables[1]}
    for i, want in ids.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(want)
        for r in mine:
            assert 0 < r.length <= 1024 and (r.piece == 0 or r.length == 1024 or len(want) <= 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_op7(spark, tables):
    want = base_of(tables[1])
    for r in result(spark, tables, "op7_lm_scoring"):
        held, n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_op8(spark, tables):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, tables, "op8_substring_dedup")}
    assert got == passages_of(tables[1], 35)


def test_op9(spark, tables):
    rows = result(spark, tables, "op9_quality_classifier")
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in tables[1])
    assert all(r.held_out == (part(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op10(spark, tables):
    talk = [*tables[3], (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in result(spark, tables, "op10_chat_formatting")}
    assert set(rows) == {c for c, *_ in talk}
    for c, r in rows.items():
        turns = [(role or "", text or "") for _, role, text in sorted(((t, role or "", text or "") for x, t, role, text in talk if x == c))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{tables[0]}/{t}.parquet/*.parquet'")
    got = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    df = QUERIES[name](spark, tables[0])
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(repr, r)) for r in df.select(columns).collect()) == sorted(tuple(map(repr, r)) for r in got.fetchall())


def test_names():
    assert sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(QUERIES) and len(QUERIES) == 13
