"""Quality rules as a short-circuit cascade.

Base counts are made for every text; texts that fail the base go no further. The other rules run in ascending order
of cost per rejection: each rule is timed, and its rejections counted, on a sample of rows (by a hash of id and text), and rules
with the most rejections per second come first. A rule is timed as the cascade pays for it: with what the base has counted at hand, on texts
that pass the base. A rule sees only texts that all rules before it kept; what was counted for them is kept, not made again. The verdict
doesn't depend on the order, only the time and ``failed_rule`` do.

Null texts count as empty and fail the base (too few words); very long texts are judged whole; rules with equal figures keep the order of RULES;
empty tables give empty results; repeated rows are judged one by one; input columns other than id, text and ``carry`` are not
read, and carried columns whose name a result column has are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import lean
from vectide.llm.textnp import Words, blocks, byte_hashes, covered, join64, mix64, packed

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = LETTERS[65:91] = LETTERS[97:123] = True


class Texts:
    """Texts of a block with counts made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, keep: np.ndarray) -> Texts:
        """Some of the texts, with all that was counted for them."""
        if keep.all():
            return self
        sizes = np.diff(self.offsets)
        out = Texts(self.data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
        for name, value in vars(self).items():
            if name == "words":
                out.words = value.take(keep, out.data, out.offsets)
            elif name not in ("data", "offsets"):
                setattr(out, name, tuple(v[keep] for v in value) if isinstance(value, tuple) else value[keep])
        return out

    def copy(self) -> Texts:
        out = Texts(self.data, self.offsets)
        vars(out).update(vars(self))
        return out

    def count(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[self.offsets])

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        w = self.words
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        return np.bincount(w.doc, points[w.end] - points[w.start], minlength=len(self)).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOLS[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those among them that an earlier one equals, by text."""
        n = len(self.data)
        start = np.unique(np.concatenate([self.offsets[:-1], np.flatnonzero(self.data == 10) + 1]))
        start = start[start < n]
        end = np.append(start[1:], n)[: len(start)]
        doc = np.searchsorted(self.offsets, start, "right") - 1
        end = np.minimum(end - ((self.data[end - 1] == 10) & (end > start)), self.offsets[doc + 1])
        full = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, start)
        start, end, doc = start[full], end[full], doc[full]
        key = byte_hashes(self.data, start, end)
        _, first = np.unique(mix64(key ^ mix64(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
        total = np.bincount(doc, minlength=len(self))
        return total, total - np.bincount(doc[first], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        at, h = w.windows(8)
        key = mix64(h ^ mix64(w.doc[at].astype(np.uint64) + np.uint64(1)))
        sorted_keys = np.sort(key)
        twice = np.unique(sorted_keys[1:][sorted_keys[1:] == sorted_keys[:-1]])
        if not len(twice):
            return np.zeros(len(self), np.int64)
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        return np.bincount(w.doc[covered(at[twice[place] == key], 8, len(w))], minlength=len(self)).astype(np.int64)


def _top_gram(t: Texts, n: int) -> np.ndarray:
    """Most places of one run of n words, by text."""
    w = t.words
    at, h = w.windows(n)
    doc = w.doc[at].astype(np.uint64)
    key, many = np.unique((doc << np.uint64(40)) | (join64(doc, h) >> np.uint64(24)), return_counts=True)
    top = np.zeros(len(t), np.int64)
    np.maximum.at(top, (key >> np.uint64(40)).astype(np.int64), many)
    return top


def _entropy(t: Texts) -> np.ndarray:
    """Bits a byte of each text's distribution of bytes."""
    size = np.diff(t.offsets)
    flat = np.bincount(np.repeat(np.arange(len(t)), size) * 256 + t.data, minlength=256 * len(t)).reshape(len(t), 256)
    p = flat / np.maximum(size, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


#: Name and test of each rule; a text for which the test is true is rejected.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words),
    "exclaiming": lambda t: 4 * t.count(t.data == 33) > t.n_words,
    "shouting": lambda t: 2 * t.count(UPPER[t.data]) > np.maximum(t.count(LETTERS[t.data]), 1),
    "few_letters": lambda t: 2 * t.count(LETTERS[t.data] | (t.data >= 128)) < np.diff(t.offsets),
    "dup_lines": lambda t: 10 * t.lines[1] > 3 * t.lines[0],
    "top_word": lambda t: 10 * _top_gram(t, 1) > 3 * t.n_words,
    "top_pair": lambda t: 10 * 2 * _top_gram(t, 2) > 3 * t.n_words,
    "top_triple": lambda t: 10 * 3 * _top_gram(t, 3) > 3 * t.n_words,
    "few_characters": lambda t: _entropy(t) < 2.5,
}


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < 20) | (100 * t.n_repeat_words > 30 * t.n_words)


def cascade(t: Texts, failed: np.ndarray, order: list[str]) -> np.ndarray:
    """Number of the rule in order that rejected each text; -1: none, -2: the base."""
    verdict = np.where(failed, -2, -1)
    left = np.flatnonzero(~failed)
    t = t.take(~failed)
    for k, name in enumerate(order):
        if not len(left):
            break
        bad = RULES[name](t)
        verdict[left[bad]] = k
        left, t = left[~bad], t.take(~bad)
    return verdict


@lean
def _measure(batches):
    for batch in batches:
        data, off = packed(batch.column(0))
        for i, j in blocks(off):
            t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
            t = t.take(~base_failed(t))
            t.word_chars, t.n_symbols, t.lines  # the output has them of every text
            for name, rule in RULES.items():
                own = t.copy()
                begun = time.thread_time()
                rejected = int(rule(own).sum()) if len(own) else 0
                yield pa.RecordBatch.from_pydict({"rule": [name], "cost": [time.thread_time() - begun], "rejected": [rejected]})


def rule_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> list[str]:
    """Rules by rejections per second on about sample_rows rows; only their order depends on the sample."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = rows.select(text.alias("text")).mapInArrow(_measure, "rule string, cost double, rejected long")
    got = {r.rule: (r.c, r.n) for r in rows.groupBy("rule").agg(F.sum("cost").alias("c"), F.sum("rejected").alias("n")).collect()}
    return sorted(RULES, key=lambda name: (got.get(name, (0.0, 0))[0] + 1e-6) / (got.get(name, (0.0, 0))[1] + 0.1))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, order: list[str] | None = None, sample_rows: int = 500) -> DataFrame:
    """doc_id, carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule."""
    new = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "failed_rule": pa.string()}
    carry = [c for c in carry or [] if c not in {*new, "doc_id", id_col, text_col}]
    order = order or rule_order(docs, id_col, text_col, sample_rows)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))

    @lean
    def run(batches):
        for batch in batches:
            data, off = packed(batch.column("__text"))
            for i, j in blocks(off):
                t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                failed = base_failed(t)
                t.word_chars, t.n_symbols, t.lines  # counted once for all texts, and carried along the cascade
                verdict = cascade(t, failed, order)
                names = pa.array(["base", None, *order], pa.string()).take(pa.array(verdict + 2))
                cols = [t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, failed, verdict == -1]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(k) for k in range(1 + len(carry))] + [pa.array(c, f) for c, f in zip(cols, new.values())] + [names], names=["doc_id", *carry, *new])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    schema = frame.drop("__text").schema
    for name, kind in new.items():
        schema = schema.add(name, kinds[kind])
    return frame.mapInArrow(run, schema)
