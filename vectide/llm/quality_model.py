"""Quality classifier: random-indexing word vectors, pooled by document, and a small network with calibrated output.

Tokens are runs of letters and digits, runs of punctuation, and line ends. The model is fitted in one task on a bounded
sample of labelled rows (``max_rows``, ``sample_bytes`` of text, taken by a hash of the id, alike at every size). Each word of the sample seen often enough
has a sparse ternary index vector; its word vector sums the index vectors of its neighbours, normalised, beside its
own. Other words share the vectors of their shape (lower, capital, upper case, number, punctuation, line end), and a token equal to the one before it has
the vector of a repeat. The mean over a text goes
through one hidden layer; the last fifth of the sample sets the temperature that divides the logit.

Scores need only the text. Null texts are empty and get the score of an empty text; without labels the score is 0.5, with
labels of one kind it is near that label; repeated ids are scored row by row; very long texts are scored whole, and not fitted beyond ``max_bytes``; a label given twice counts as its mean rounded;
empty tables give empty results; carried columns whose name a result column has are dropped.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import lean, widened
from vectide.llm.textnp import Words, blocks, mix64, packed

KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 2
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = 1
KINDS[128:] = 1
KINDS[10] = 3
SHAPES, REPEAT, NEAR = 7, 6, 2


def id_number(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % parts


def _shapes(w: Words) -> np.ndarray:
    d, n = w.data, len(w.data)
    a = d[w.start] if n else np.zeros(0, np.uint8)
    b = d[np.minimum(w.start + 1, w.end - 1)] if n else a
    upper = lambda x: (x >= 65) & (x < 91)
    repeat = np.zeros(len(w), bool)
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return np.select([repeat, a == 10, KINDS[a] == 2, (a >= 48) & (a < 58), upper(a) & upper(b) & (w.end - w.start > 1), upper(a)], [REPEAT, 5, 4, 3, 2, 1], 0)


class Model:
    """Vocabulary, word vectors and network; score(data, offsets) gives a probability for each text."""

    def __init__(self, vocab: np.ndarray, vectors: np.ndarray, net: tuple | None, bias: float = 0.0, temperature: float = 1.0):
        self.vocab, self.vectors, self.net, self.bias, self.temperature = vocab, vectors, net, bias, temperature

    def numbers(self, w: Words) -> np.ndarray:
        shape = _shapes(w)
        if not len(self.vocab) or not len(w):
            return shape
        place = np.minimum(np.searchsorted(self.vocab, w.hash), len(self.vocab) - 1)
        return np.where((self.vocab[place] == w.hash) & (shape != REPEAT), place + SHAPES, shape)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = Words(data, offsets, KINDS)
        ids = self.numbers(w)
        out = np.zeros((len(w.counts), self.vectors.shape[1]), np.float32)
        for a in range(0, len(ids), 40_000):
            doc = w.doc[a : a + 40_000]
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[doc[head]] += np.add.reduceat(self.vectors[ids[a : a + 40_000]], head, axis=0)
        return out / np.maximum(w.counts, 1)[:, None].astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), self.bias)
        mean, std, w1, b1, w2, b2 = self.net
        return np.maximum(((x - mean) / std) @ w1 + b1, 0) @ w2 + b2

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pooled(data, offsets)) / self.temperature, -30, 30)))


def _random_indexing(ids: np.ndarray, doc: np.ndarray, size: int, dims: int) -> np.ndarray:
    """Own index vectors beside normalised sums of the neighbours' index vectors."""
    own = np.zeros((size, dims), np.float32)
    base = np.arange(size, dtype=np.uint64)
    for k in range(4):
        h = mix64(base * np.uint64(8) + np.uint64(k + 1))
        own[np.arange(size), (h % np.uint64(dims)).astype(int)] += np.where(h >> np.uint64(63), 1.0, -1.0)
    context = np.zeros((size, dims))
    for step in range(1, NEAR + 1):
        same = doc[step:] == doc[:-step]
        a, b = ids[step:][same], ids[:-step][same]
        for d in range(dims):
            context[:, d] += np.bincount(a, own[b, d], size) + np.bincount(b, own[a, d], size)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return np.concatenate([own / 2, context], axis=1).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 7) -> tuple:
    rnd = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / std).astype(np.float64)
    p = [rnd.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rnd.normal(0, 0.3, hidden), 0.0]
    m, v, t = [np.zeros_like(np.asarray(q)) for q in p], [np.zeros_like(np.asarray(q)) for q in p], 0
    for _ in range(epochs):
        order = rnd.permutation(len(z))
        for a in range(0, len(order), 128):
            k = order[a : a + 128]
            h = np.maximum(z[k] @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[k]) / len(k)
            gh = g[:, None] * p[2] * (h > 0)
            grads = [z[k].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum()]
            t += 1
            for i, q in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return mean, std, *p


def fit_rows(texts: pa.Array, labels: np.ndarray, dims: int = 24, hidden: int = 32, min_count: int = 3, max_vocab: int = 60_000, epochs: int = 60) -> Model:
    empty = Model(np.zeros(0, np.uint64), np.zeros((SHAPES, 1), np.float32), None)
    if not len(labels):
        return empty
    if labels.min() == labels.max():
        empty.bias = 4.0 if labels[0] else -4.0
        return empty
    data, off = packed(texts)
    hashes, docs, shapes = [], [], []
    for i, j in blocks(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], KINDS)
        hashes.append(w.hash)
        docs.append(w.doc + i)
        shapes.append(_shapes(w))
    h, doc, shape = np.concatenate(hashes), np.concatenate(docs), np.concatenate(shapes)
    vocab, counts = np.unique(h, return_counts=True)
    often = np.flatnonzero(counts >= min_count)
    vocab = np.sort(vocab[often[np.argsort(-counts[often], kind="stable")[:max_vocab]]])
    place = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
    ids = np.where((vocab[place] == h) & (shape != REPEAT), place + SHAPES, shape) if len(vocab) else shape
    model = Model(vocab, _random_indexing(ids, doc, len(vocab) + SHAPES, dims), None)
    del h, doc, shape, ids, place
    x = np.concatenate([model.pooled(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)])
    held = np.arange(len(labels)) % 5 == 4
    if len(np.unique(labels[~held])) < 2:
        held[:] = False
    model.net = _train(x[~held], labels[~held], hidden, epochs)
    if held.any():
        logit, y = model.logit(x[held]), labels[held]
        loss = lambda t: np.logaddexp(0, -np.where(y > 0, logit, -logit) / t).mean()
        model.temperature = min((0.5 * 1.15**k for k in range(24)), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, max_bytes: int = 1_000_000, sample_bytes: int = 128_000_000) -> Model:
    """Model of at most about max_rows labelled ids, one row of each (the shortest text, then the least), of texts up to max_bytes and about sample_bytes together."""
    y = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("y"))
    share = min(1.0, max_rows / max(1, y.count()))
    place = F.pmod(F.xxhash64("i"), F.lit(1_000_000)) + F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1_000_000)) / 1e6  # of an id, 0 to a million
    y = y.where(place < share * 1e6).groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(y), "i")  # max_rows bounds it
    least = rows.groupBy("i").agg(F.min(F.octet_length("text")).cast("long").alias("n"))  # about the bytes of an id's one row
    size = least.agg(F.sum("n")).first()[0] or 0
    rows = rows.where(place < min(share, share * sample_bytes / max(size, 1)) * 1e6)
    rows = rows.groupBy("i", "y").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t")).select("i", "y", "t.text")

    @lean
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("i", "ascending"), ("text", "ascending")]))
        order = np.random.default_rng(1).permutation(table.num_rows)
        table = table.take(pa.array(order))
        return pa.table({"model": pa.array([pickle.dumps(fit_rows(table["text"], table["y"].to_numpy()))], pa.binary())})

    got = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(lambda t: run(t), "model binary").collect()
    return pickle.loads(got[0].model) if got else fit_rows(pa.array([], pa.string()), np.zeros(0))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.3, only_predicted: bool = False) -> DataFrame:
    """doc_id, carried columns, score, predicted. only_predicted: of rows with predicted = 1."""
    carry = [c for c in carry or [] if c not in {"doc_id", "score", "predicted", id_col}]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_vocab
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))

    @lean
    def run(batches):
        for batch in batches:
            data, off = packed(batch.column("__text"))
            score = np.concatenate([np.zeros(0), *[shared.value.score(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]])
            good = pa.array(score >= threshold)
            out = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1 + len(carry))], pa.array(score, pa.float64()), good.cast(pa.int32())], names=["doc_id", *carry, "score", "predicted"])
            yield out.filter(good) if only_predicted else out

    return frame.mapInArrow(run, widened(frame.drop("__text").schema, "score double, predicted int"))
