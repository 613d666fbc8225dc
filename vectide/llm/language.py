"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Words are runs of letters. The script of a word's first character leaves as candidates the languages whose training words
use that script; a script never seen leaves all. A word's score in a language is the sum of log-probabilities of its hashed byte
trigrams; switching language between words costs ``penalty``. Viterbi runs over the words of many texts at once. A text's
language is that of most letters, its score their share.

The model is fitted on a bounded sample of labelled rows (``max_rows`` for each language, taken by a hash of the id).
Texts that are null or have no letter are ``und`` with score 0; rows with null language teach nothing; without any training rows all
texts are ``und``; very long texts are labelled whole; ties go to the language that sorts first; repeated rows are labelled one by one; empty tables
give empty results; carried columns whose name a result column has are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import lean, widened
from vectide.llm.textnp import Words, blocks, packed

BUCKETS, VITERBI_BYTES = 1 << 15, 8_000_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
#: Last code point of each script range, and its script. Fixed values.
SCRIPT_ENDS = np.array([0x02FF, 0x036F, 0x03FF, 0x052F, 0x058F, 0x05FF, 0x077F, 0x08FF, 0x097F, 0x09FF, 0x0E7F, 0x10FF, 0x11FF, 0x1DFF, 0x1EFF, 0x1FFF, 0x303F, 0x30FF, 0x318F, 0x4DBF, 0x9FFF, 0xABFF, 0xD7FF, 0x10FFFF])
SCRIPTS = np.array([0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11, 0, 1, 11, 12, 10, 13, 13, 11, 10, 11])


def _script(w: Words) -> np.ndarray:
    """Script number of the first character of each word."""
    d = np.append(w.data, np.zeros(3, np.uint8)).astype(np.int64)
    a, b, c, e = (d[w.start + k] for k in range(4))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | e & 63)))
    return SCRIPTS[np.minimum(np.searchsorted(SCRIPT_ENDS, point), len(SCRIPTS) - 1)]


def _trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte of a word, and the first trigram of each word."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.repeat(w.start - first, size) + np.arange(int(size.sum()))
    here = w.data[at].astype(np.uint32)
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first] = after[first + size - 1] = 32
    return ((((before << 16) | (here << 8) | after) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), first


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float):
        """counts: (languages, BUCKETS); scripts: words by (language, script)."""
        self.langs, self.penalty = langs, penalty
        p = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)
        self.table = np.ascontiguousarray(np.log(p).T, np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share > 0.01
        allowed[:, ~allowed.any(0)] = True
        self.mask = np.where(allowed.T, 0, -1000).astype(np.float32)

    def emissions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        w = Words(data, offsets, LETTER, lower=True)
        if not len(w):
            return w, np.zeros((0, len(self.langs)), np.float32)
        bucket, first = _trigrams(w)
        return w, np.add.reduceat(self.table[bucket], first, axis=0) + self.mask[_script(w)]

    def viterbi(self, e: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Label of each word; counts: words of each text."""
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        start, size = first[order], counts[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
        v = np.zeros((len(size), e.shape[1]), np.float32)
        best = np.zeros(len(e), np.int16)
        moved = np.zeros(e.shape, bool)
        rows = np.arange(len(size))
        for t in range(steps):
            n = live[t]
            at = start[:n] + t
            x = v[:n]
            top = x.argmax(1)
            high = x[rows[:n], top] - np.float32(self.penalty)
            best[at] = top
            if t:
                moved[at] = x < high[:, None]
                np.maximum(x, high[:, None], out=x)
            x += e[at]
            x -= x.max(1, keepdims=True)
        label = np.zeros(len(e), np.int16)
        state = v.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            at = start[:n] + t
            s = state[:n]
            label[at] = s
            state[:n] = np.where(moved[at, s], best[at], s)
        return label


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2000, penalty: float = 6.0, max_langs: int = 200) -> Model | None:
    """Model of the max_langs commonest languages (the model has one table each), of at most about max_rows rows of each."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1_000_000)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    langs = sorted(r.lang for r in counts.collect())
    if not langs:
        return None
    share = F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("n"))
    sample = rows.join(F.broadcast(counts), "lang").where(F.col("h") < share)  # max_langs rows

    @lean
    def count(batches):
        total, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), int(SCRIPTS.max()) + 1), np.int64)
        for batch in batches:
            data, off = packed(batch.column("text"))
            which = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in blocks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], LETTER, lower=True)
                if not len(w):
                    continue
                bucket, _ = _trigrams(w)
                of = which[i:j][w.doc]
                total += np.bincount(np.repeat(of, w.end - w.start) * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
                scripts += np.bincount(of * scripts.shape[1] + _script(w), minlength=scripts.size).reshape(scripts.shape)
        yield pa.RecordBatch.from_pydict({"a": [total.tobytes()], "b": [scripts.tobytes()]})

    got = sample.select("lang", "text").repartition(8).mapInArrow(count, "a binary, b binary").collect()  # eight tables of fixed size
    total = sum(np.frombuffer(r.a, np.int64) for r in got).reshape(len(langs), BUCKETS)
    scripts = sum(np.frombuffer(r.b, np.int64) for r in got).reshape(len(langs), -1)
    return Model(langs, total, scripts, penalty)


def labelled(model: Model | None, langs: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and spans of each text."""
    n, none = len(off) - 1, len(langs) - 1
    kinds = max(none, 1)
    start, end, doc, emissions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, kinds), np.float32)]
    for i, j in blocks(off) if model else ():
        w, x = model.emissions(data[off[i] : off[j]], off[i : j + 1] - off[i])
        start.append(w.start + off[i])
        end.append(w.end + off[i])
        doc.append(w.doc + i)
        emissions.append(x)
    start, end, doc = np.concatenate(start), np.concatenate(end), np.concatenate(doc)
    counts = np.bincount(doc, minlength=n)
    label = model.viterbi(np.concatenate(emissions), counts) if len(doc) else np.zeros(0, np.int16)
    mass = np.bincount(doc * kinds + label, end - start, n * kinds).reshape(n, kinds)
    pick, total = mass.argmax(1), mass.sum(1)
    plain = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    unsure = (plain[off[1:]] == plain[off[:-1]]) & (total > 0)
    for k in np.flatnonzero(unsure):
        if not any(c.isalpha() for c in data[off[k] : off[k + 1]].tobytes().decode()):
            total[k] = 0
    pick = np.where(total > 0, pick, none)
    score = np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0.0)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
    flat = pa.StructArray.from_arrays([pa.array(start[head] - off[doc[head]]), pa.array(end[tail] - off[doc[head]]), pa.array(langs[label[head].astype(int)], pa.string())], ["start", "end", "lang"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[head], np.arange(n + 1)), pa.int32()), flat)
    return pa.array(langs[pick], pa.string()), pa.array(score, pa.float64()), spans


SPANS = "array<struct<start:bigint,end:bigint,lang:string>>"


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, carried columns, lang_pred, score, spans (byte ranges of the text and their language)."""
    carry = [c for c in carry or [] if c not in {"doc_id", "lang_pred", "score", "spans", id_col}]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))

    @lean
    def run(batches):
        model = shared.value
        langs = np.array([*(model.langs if model else []), "und"], object)
        for batch in batches:
            data, off = packed(batch.column("__text"))
            for lo, hi in blocks(off, VITERBI_BYTES):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in range(1 + len(carry))], *labelled(model, langs, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])], names=["doc_id", *carry, "lang_pred", "score", "spans"])

    return frame.mapInArrow(run, widened(frame.drop("__text").schema, f"lang_pred string, score double, spans {SPANS}"))
