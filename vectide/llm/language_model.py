"""Scores of texts under a Brown class-based bigram model learned from the corpus.

Every word belongs to one of ``classes`` classes. A token's probability is that of its class after the class before it,
times its share of its class, mixed with the smoothed unigram probability. Classes start from a hash of the last two bytes of a word;
an exchange round moves every word, whatever its count, to the class whose left and right neighbour classes fit its own best, given
the class bigram counts of the round before (all words at once, as is usual when exchange is run in parallel); of equally good classes a
word's own stays, then the first. Rounds go on until the likelihood that classes give the training tokens gains less than ``gain``
(a share of the logarithm); a round that lowers it is refused. ``rounds`` is a guard far beyond what that takes: a warning says when it stops them.

Texts are parsed once: a chunk of documents is written to the shared folder as numbers of its distinct words, and its tasks read it from there in every round.
A chunk sends, for each distinct word, its count and sparse neighbour-class counts to the word's key range,
which adds them up over all chunks and answers with total count and class. Only tables of classes x classes, and the
number of distinct words, reach the driver. Words seen once stand for unknown words in the class bigrams; all unknown
words are one more type, so the probabilities of all types sum to one.

Null texts are empty (one end token); documents of a null id are learnt from or not by the crc32 of the empty text;
repeated rows count each time; very long texts are scored whole; an empty table gives an empty result; without training tokens the score is the base score;
other columns are not read.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import exchange as X
from vectide.llm.textnp import Words, blocks, mix64, packed

COUNTS = ["u8", "u8", "u1"]  # word hash, training count, class; sparse counts follow
BIGRAMS = 8  # kind of rows that hold a chunk's class bigrams
SPARSE = ["u4", "u2", "u4"]  # word number in the blob, neighbour class, count
MIX, PRIOR = 0.95, 5.0


@X.lean
def _parsed(table: pa.Table, classes: int) -> pa.Table:
    """One row: the words of a chunk in its fixed order, as numbers of its distinct words, and their bigrams in their first classes."""
    table = X.ordered(table)
    data, off = packed(table["text"])
    hashes, counts, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for i, j in blocks(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        hashes.append(w.hash)
        counts.append(w.counts)
        last = w.data[w.end - 1].astype(np.uint64)
        before = np.where(w.end - w.start > 1, w.data[w.end - 2], 0).astype(np.uint64)
        start.append((mix64(last * np.uint64(256) + before) % np.uint64(classes)).astype(np.uint8))
    keys, back = np.unique(np.concatenate(hashes), return_inverse=True)
    initial = np.zeros(len(keys), np.uint8)
    initial[back] = np.concatenate(start)
    as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    docs = [as_list(table["doc_id"].combine_chunks()), as_list(table["train"].combine_chunks()), as_list(pa.array(np.concatenate(counts), pa.int64()))]
    words = [pa.array([X.dump(x)], pa.binary()) for x in (keys, initial, back.astype("u4"))]
    t = Tokens(pa.table([*docs, *words], names=TOKENS))
    table = [table["chunk"][:1].combine_chunks(), *docs, *words, pa.array([t.bigrams(t.initial[t.back], classes, classes + 1).tobytes()], pa.binary())]
    return pa.table(table, names=["chunk", *TOKENS, "table"])


TOKENS = ["doc_id", "train", "counts", "keys", "initial", "words"]
TOKEN_ROWS = "chunk int, doc_id array<bigint>, train array<boolean>, counts array<bigint>, keys binary, initial binary, words binary, table binary"


class Tokens:
    """A chunk as _parsed() made it: distinct words and their first classes, the number of each word of the texts, bounds of texts."""

    def __init__(self, row: pa.Table):
        blob = lambda c, t: X.load(row[c][0].as_py(), [t])[0]
        self.doc_id = row["doc_id"][0].values
        self.keys, self.initial, self.back = blob("keys", "u8"), blob("initial", "u1").astype(np.int64), blob("words", "u4")
        self.counts = row["counts"][0].values.to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.trained = row["train"][0].values.to_numpy(zero_copy_only=False).astype(bool)
        self.learn = np.repeat(self.trained, self.counts)
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def neighbours(self, z: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Class before and class after each word; texts are within ends."""
        before, after = np.full(len(z), end, z.dtype), np.full(len(z), end, z.dtype)
        same = self.doc[1:] == self.doc[:-1]
        before[1:][same], after[:-1][same] = z[:-1][same], z[1:][same]
        return before, after

    def bigrams(self, z: np.ndarray, end: int, size: int, mask: np.ndarray | None = None) -> np.ndarray:
        """Class bigram counts over training texts, ends included; mask: of counted words (or ends) by (first, second)."""
        before, _ = self.neighbours(z, end)
        out = np.bincount(before[self.learn].astype(np.int64) * size + z[self.learn], minlength=size * size)
        final = np.full(len(self.counts), end, np.int64)
        full = self.counts > 0
        final[full] = z[self.bounds[1:][full] - 1]
        out += np.bincount(final[self.trained] * size + end, minlength=size * size)
        return out.reshape(size, size)


def _chunk(rows: pa.Table, folder: str) -> tuple[int, Tokens | None]:
    """Number and words of the chunk that some answers are for."""
    chunk = rows["dest"][0].as_py()
    row = X.stored_rows(f"{folder}/chunk={chunk}") if chunk >= 0 else None
    return chunk, None if row is None else Tokens(row)


def _summed(tables: DataFrame, size: int) -> np.ndarray:
    """Sum of size x size tables, first by 32 tasks."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in t["table"].to_pylist())
        return pa.table({"table": pa.array([total.tobytes()], pa.binary())})

    got = tables.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("part").applyInArrow(add, "table binary").collect()
    return sum((np.frombuffer(r["table"], np.int64) for r in got), np.zeros(size * size, np.int64)).reshape(size, size)


def _classes(t: Tokens, answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Training count and class of the distinct words of a chunk, from the key ranges' answers."""
    count, z = np.zeros(len(t.keys), np.int64), np.zeros(len(t.keys), np.int64)
    at = X.cuts(t.keys, n, 64)
    for b, blob in X.replies(answers, 0).items():
        c, k = X.load(blob, ["u8", "u1"])
        count[at[b] : at[b + 1]], z[at[b] : at[b + 1]] = c, k
    return count, z


@X.lean
def _count(answers: pa.Table, folder: str, r: int, classes: int, first: bool) -> pa.Table:
    """Counts and neighbour classes of the distinct words of a chunk."""
    chunk, t = _chunk(answers, folder)
    if t is None:
        return X.rows([])
    own = t.initial if first else _classes(t, answers, r)[1]
    z = own[t.back]
    before, after = t.neighbours(z, classes)
    word = t.back[t.learn].astype(np.int64)
    total = np.bincount(word, minlength=len(t.keys)).astype("u8")
    size = 2 * (classes + 1)
    pair, many = X.distinct(np.concatenate([word * size + before[t.learn], word * size + classes + 1 + after[t.learn]]))
    of, ctx = pair // size, pair % size
    at = X.cuts(t.keys, r, 64)
    out = [] if first else [(r, chunk, BIGRAMS, pa.py_buffer(t.bigrams(z, classes, classes + 1).tobytes()))]
    for b in range(r):
        lo, hi = at[b], at[b + 1]
        if hi > lo:
            i, j = np.searchsorted(of, [lo, hi])
            out.append((b, chunk, 0, X.dump(t.keys[lo:hi], total[lo:hi], own[lo:hi].astype("u1")) + X.dump((of[i:j] - lo).astype("u4"), ctx[i:j].astype("u2"), many[i:j].astype("u4"))))
    return X.rows(out)


@X.lean
def _exchange(table: pa.Table, bigrams: np.ndarray, classes: int, move: bool) -> pa.Table:
    """Total counts, and the best class of each word of a key range, for every chunk that has it."""
    dest = table["dest"][0].as_py()
    got = X.by_kind(table, 0)
    if not got:
        return X.rows([])
    heads = [X.load(p, COUNTS) for *_, p in got]
    bounds = np.cumsum([0] + [len(h[0]) for h in heads])
    keys, first, back = np.unique(np.concatenate([h[0] for h in heads]), return_index=True, return_inverse=True)
    own = np.concatenate([h[2] for h in heads])[first]
    total = np.bincount(back, np.concatenate([h[1] for h in heads]).astype(float), minlength=len(keys)).astype(np.int64)
    entries = [X.load(p[8 + 17 * len(h[0]) :], SPARSE) for (*_, p), h in zip(got, heads)]
    word = np.concatenate([back[bounds[k] + e[0]] for k, e in enumerate(entries)])
    ctx, many = np.concatenate([e[1] for e in entries]), np.concatenate([e[2] for e in entries])
    order = np.argsort(word, kind="stable")
    word, ctx, many = word[order], ctx[order], many[order]
    b = bigrams.astype(float) + 0.5
    left = np.log(b[:, :classes] / b[:, :classes].sum(0))  # what stands before a class
    right = np.log(b[:classes] / b[:classes].sum(1, keepdims=True)).T  # and after it
    fits = np.concatenate([left, right])
    score = np.zeros((len(keys), classes), np.float32)
    for lo in range(0, len(keys) if move else 0, 20_000):
        hi = min(lo + 20_000, len(keys))
        i, j = np.searchsorted(word, [lo, hi])
        near = np.bincount((word[i:j] - lo) * len(fits) + ctx[i:j], many[i:j], minlength=(hi - lo) * len(fits))
        score[lo:hi] = near.reshape(hi - lo, len(fits)) @ fits  # in single precision equal ones stay equal, whatever the order of sums
    best = score.argmax(1).astype("u1")
    here = np.arange(len(keys))
    best = np.where(score[here, best] > score[here, own], best, own) if move else own
    out = [(c, dest, 0, X.dump(total[back[bounds[k] : bounds[k + 1]]].astype("u8"), best[back[bounds[k] : bounds[k + 1]]])) for k, (_, c, _) in enumerate(got)]
    return X.rows([*out, (-1 - dest, dest, 9, pa.py_buffer(f"{(total > 0).sum()} {(total * np.log(np.maximum(total, 1))).sum()}".encode()))])


def likelihood(bigrams: np.ndarray) -> float:
    """What of the logarithm of the training tokens' likelihood depends on their classes."""
    x = lambda n: float((n * np.log(np.maximum(n, 1))).sum())
    return x(bigrams.astype(float)) - x(bigrams.sum(0).astype(float)) - x(bigrams.sum(1).astype(float))


@X.lean
def _bigrams(answers: pa.Table, folder: str, n: int, classes: int) -> pa.Table:
    """Class bigrams of a chunk, with words seen once also counted as unknown (the last class)."""
    end, unknown, size = classes, classes + 1, classes + 2
    total = np.zeros((size, size), np.int64)
    t = _chunk(answers, folder)[1]
    if t is not None:
        count, z = (x[t.back] for x in _classes(t, answers, n))
        once = np.where(count == 1, unknown, z)
        total += t.bigrams(z, end, size)
        both = t.bigrams(once, end, size)
        before, after = t.neighbours(z, end)
        single = t.learn & (count == 1)
        total[:, unknown] += np.bincount(before[single], minlength=size)
        total[unknown] += np.bincount(after[single], minlength=size)
        total[unknown, unknown] += both[unknown, unknown]
    return pa.table({"table": pa.array([total.tobytes()], pa.binary())})


@X.lean
def _score(answers: pa.Table, folder: str, bigrams: np.ndarray, distinct: int, n: int, classes: int) -> pa.Table:
    t = _chunk(answers, folder)[1]
    if t is None:
        return SCHEMA.empty_table()
    end, unknown = classes, classes + 1
    count, z = (x[t.back] for x in _classes(t, answers, n))
    z = np.where(count > 0, z, unknown)
    known = bigrams[: end + 1, : end + 1]
    size = known.sum(0)
    tokens = int(size.sum())
    share = bigrams.sum(0) / max(bigrams.sum(), 1)
    step = (bigrams + PRIOR * share) / (bigrams.sum(1, keepdims=True) + PRIOR)
    base = lambda c: (c + 0.5) / (tokens + 0.5 * (distinct + 1))
    before, _ = t.neighbours(z, end)
    own = np.where(count > 0, count / np.maximum(np.append(size, [1])[np.minimum(z, end + 1)], 1), 1.0)
    p0 = base(count)
    p = MIX * step[before, z] * own + (1 - MIX) * p0
    final = np.full(len(t.counts), end)
    full = t.counts > 0
    final[full] = z[t.bounds[1:][full] - 1]
    e0 = base(float(size[end]))
    add = lambda x: np.bincount(t.doc, x, len(t.counts))
    base_score = add(np.log10(p0)) + np.log10(e0)
    if size[end]:
        score = add(np.log10(p)) + np.log10(MIX * step[final, end] + (1 - MIX) * e0)
    else:
        score = base_score
    n_known = add((count > 0).astype(float)).astype(np.int64) + int(size[end] > 0)
    return pa.table([t.doc_id, pa.array(~t.trained), pa.array(t.counts + 1, pa.int64()), pa.array(n_known), pa.array(np.full(len(t.counts), tokens), pa.int64()), pa.array(base_score), pa.array(score)], schema=SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, held_out, classes: int = 64, rounds: int = 50, gain: float = 0.01, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities). held_out: a boolean column."""
    if not 1 <= classes <= 250 or rounds < 1:
        raise ValueError("classes must be 1 to 250, rounds 1 or more")
    n, r = X.partitions(docs, n, text_col)
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (~held_out).alias("train"))
    parts = X.chunked(plain, n, "doc_id", "text", ["train"])
    folder = X.stored(parts.groupBy("chunk").applyInArrow(lambda t: _parsed(t, classes), TOKEN_ROWS), "tokens", "chunk")
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("dest"), F.lit(-1).alias("chunk"), F.lit(-1).alias("kind"), F.lit(b"").alias("payload"))

    def by_chunk(answers: DataFrame | None):
        """A group for every chunk, also for those without words."""
        return (every if answers is None else answers.where("dest >= 0").unionByName(every)).repartition(n, "dest").groupBy("dest")

    def counted(answers: DataFrame | None) -> DataFrame:
        first = answers is None
        return X.checkpointed(by_chunk(answers).applyInArrow(lambda t: _count(t, folder, r, classes, first), X.ROWS).repartition(n, "dest"))

    def exchanged(counts: DataFrame, bigrams: np.ndarray, move: bool = True) -> DataFrame:
        return X.checkpointed(counts.where("kind = 0").groupBy("dest").applyInArrow(lambda t: _exchange(t, bigrams, classes, move), X.ROWS))

    def tables(answers: DataFrame) -> np.ndarray:
        return _summed(by_chunk(answers).applyInArrow(lambda t: _bigrams(t, folder, r, classes), "table binary"), classes + 2)

    bigrams = _summed(docs.sparkSession.read.schema("table binary").parquet(folder), classes + 1)
    answers, done, refused = exchanged(counted(None), bigrams), 1, False
    got = answers.where("kind = 9").select(F.split(F.col("payload").cast("string"), " ").alias("x")).agg(F.sum(F.col("x")[0].cast("long")), F.sum(F.col("x")[1].cast("double"))).first()
    distinct, words = got[0] or 0, got[1] or 0.0
    last, before = words + likelihood(bigrams), None  # before: the answers that the last round changed
    while done < rounds:
        X.release(docs)
        counts = counted(answers)
        X.release(docs)
        bigrams = _summed(counts.where(f"kind = {BIGRAMS}").select(F.col("payload").alias("table")), classes + 1)
        now = words + likelihood(bigrams)
        refused = now < last
        if refused or now - last <= gain * abs(last):
            break
        before, last = answers, now
        answers, done = exchanged(counts, bigrams), done + 1
    else:
        warnings.warn(f"exchange stopped by its guard of {rounds} rounds, not by its gain", stacklevel=2)
    X.release(docs)
    bigrams = tables(answers)
    if refused or words + likelihood(bigrams[: classes + 1, : classes + 1]) < last - 1e-6 * abs(last):  # back to the classes before the last round
        answers = exchanged(counted(None), bigrams[: classes + 1, : classes + 1], move=False) if before is None else before
        bigrams = tables(answers)
    distinct += int(bigrams[:, classes].sum() > 0)  # the end
    return by_chunk(answers).applyInArrow(lambda t: _score(t, folder, bigrams, distinct, r, classes), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
