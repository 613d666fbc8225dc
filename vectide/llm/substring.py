"""Substring de-duplication by fixed-block anchors.

Every text is cut into non-overlapping blocks of ``block`` words; these are the index. Every rolling run of
``block`` words of every text probes the index. A run of ``window >= 2 * block - 1`` words holds exactly one whole
block of its own text at least, so a repeated window has an own block that some probe of another place hits.

1. Index and probes meet by hash range (see exchange): a chunk sends each distinct run once, with its count, and gets back
   whether it is hit, and whether it is hot. Hashes are short here, as a false hit only costs work.
2. Of the hits within a window the one with the least hash is its anchor, the same for all copies of the window. The places of
   an anchor, each with the words around it that windows of this anchor cover, are joined by anchor.
3. Hits are extended: all places of an anchor are sorted by the words from it on; for 0, 1, 2, ... words before it that places
   share, each is compared with its neighbours in that order, word for word. So every place gets its maximal exact
   repeats without pairs being listed. Repeats of ``window`` words or more count; all their copies are removed.
   The places of a hot anchor (over ``hot`` of them) would be too many for one task: each window over it becomes an anchor of
   its own, dealt by its hash to all key ranges.
4. Chunks remove the words of all repeated windows.

Copies of one stretch within a chunk, or a key range, are compared byte for byte and then handled as one stretch with many places.
Null texts have no words; an empty table gives an empty result; rows that repeat an id are documents of their own, and copies of
each other where their texts are; very long texts are handled whole; columns of the input other than id, text and ``carry``
are not read, and a carried column whose name a result column has is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import exchange as X
from vectide.llm.textnp import Words, blocks, covered, distinct_bytes, joined, mix64, packed, sliding_min, strings, unplanes, window_hashes, word_numbers

ANCHOR_BITS, COUNT_BITS, HOT, BATCH = 48, 8, 5000, 20_000
POSITION = np.uint64((1 << 28) - 1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: anchor, doc number in the chunk, first window, windows, words before the anchor, bytes, whether the chunk has more copies; the bytes follow
PLACE = ["u8", "u4", "u4", "u4", "u4", "u4", "u1"]


def _words(table: pa.Table):
    data, off = packed(table["text"])
    for i, j in blocks(off):
        yield i, j, Words(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _runs(table: pa.Table, block: int):
    """Hash of each rolling run, whether it is an own block, and the words of each block of texts with the runs' first words."""
    runs, own, spans = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], []
    for i, _, w in _words(table):
        at, h = w.windows(block)
        runs.append(h >> np.uint64(64 - ANCHOR_BITS))
        own.append((w.at()[at] % block) == 0)
        spans.append((i, w, at))
    return np.concatenate(runs), np.concatenate(own), spans


@X.lean
def _probe(table: pa.Table, r: int, block: int) -> pa.Table:
    chunk = table["chunk"][0].as_py()
    runs, own, _ = _runs(X.ordered(table), block)
    keys, counts = X.distinct(runs)
    indexed = np.zeros(len(keys), bool)
    indexed[np.searchsorted(keys, runs[own])] = True
    return X.rows(X.send(keys, indexed + 2 * np.log2(np.maximum(counts, 1)).astype(np.int64), r, ANCHOR_BITS, COUNT_BITS, chunk))


@X.lean
def _match(table: pa.Table, hot: int) -> pa.Table:
    """Two bits a key and chunk: whether it is indexed somewhere and has two places or more, and whether it has over hot (counts are known to a factor of 2)."""
    dest = table["dest"][0].as_py()
    width = (ANCHOR_BITS + COUNT_BITS) // 8
    parts = [(c, unplanes(p, width)) for _, c, p in X.by_kind(table, 0)]
    del table
    hits, crowds = [np.zeros(len(p), bool) for _, p in parts], [np.zeros(len(p), bool) for _, p in parts]
    for cut in X.subranges([p for _, p in parts], COUNT_BITS):
        full = np.concatenate([p[a:b] for (_, p), (a, b) in zip(parts, cut)])
        if not len(full):
            continue
        order = np.argsort(full >> np.uint64(COUNT_BITS))
        k, f = full[order] >> np.uint64(COUNT_BITS), (full[order] & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        total = np.add.reduceat(np.int64(1) << (f >> 1), new)
        hit = (total > 1) & (np.maximum.reduceat(f & 1, new) > 0)
        size = np.diff(np.append(new, len(k)))
        for found, to in ((hit, hits), (hit & (total > hot), crowds)):
            back = np.zeros(len(k), bool)
            back[order] = np.repeat(found, size)
            at = 0
            for own, (a, b) in zip(to, cut):
                own[a:b] = back[at : at + b - a]
                at += b - a
    return X.rows([(c, dest, kind, np.packbits(x).tobytes()) for kind, to in ((0, hits), (2, crowds)) for (c, _), x in zip(parts, to)])


@X.lean
def _places(table: pa.Table, answers: pa.Table, r: int, block: int, window: int) -> pa.Table:
    """Places of anchors with the words around them, one of each content, and the windows of all stretches that the chunk has twice."""
    if not table.num_rows:
        return X.rows([])
    chunk = table["chunk"][0].as_py()
    table = X.ordered(table)
    runs, _, spans = _runs(table, block)
    keys, _ = X.distinct(runs)
    at = np.searchsorted(keys, runs)
    hit, crowd = (X.answer_bits(keys, r, ANCHOR_BITS, X.replies(answers, kind))[at] if len(keys) else np.zeros(0, bool) for kind in (0, 2))
    del keys, at, answers
    cols, bodies, done, written = [], [], 0, 0
    for i, w, at in spans:
        n = len(w)
        hits = np.flatnonzero(hit[done : done + len(at)]) + done
        place = at[hits - done]
        done += len(at)
        if not len(hits):
            continue
        value, flag = np.full(n + window, NONE), np.zeros(n + block, bool)
        value[place] = (mix64(runs[hits]) & ~POSITION) | place.astype(np.uint64)
        flag[place] = True
        least = sliding_min(value, window - block + 1)[:n]
        p = np.flatnonzero((w.left() >= window) & flag[np.arange(n) + (-w.at()) % block])
        m = (least[p] & POSITION).astype(np.int64)
        head = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1))) if len(p) else p
        first, anchor, count = p[head], m[head], np.diff(np.append(head, len(p)))
        key, hot = np.zeros(n, np.uint64), np.zeros(n, bool)
        key[place], hot[place] = runs[hits], crowd[hits]
        key, hot = key[anchor], hot[anchor]
        if hot.any():
            size = count[hot]
            single = np.repeat(first[hot], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            own = window_hashes(w.hash, window)[single] >> np.uint64(64 - ANCHOR_BITS)
            first, anchor = np.concatenate([first[~hot], single]), np.concatenate([anchor[~hot], single])
            key, count = np.concatenate([key[~hot], own]), np.concatenate([count[~hot], np.ones(len(single), np.int64)])
        body, _ = joined(w, np.ones(n, bool))
        step = w.end - w.start + (w.left() > 1)
        begin = np.cumsum(step) - step
        last = first + count + window - 2
        start = begin[first]
        cols.append([key, w.doc[first] + i, w.at()[first], count, anchor - first, begin[last] + w.end[last] - w.start[last] - start, start + written])
        bodies.append(body)
        written += len(body)
    if not cols:
        return X.rows([])
    key, doc, first, count, before, size, start = (np.concatenate(c) for c in zip(*cols))
    body = np.concatenate(bodies)
    order, new = distinct_bytes(body, key, start, size)
    more = np.append(~new[1:], False) if len(new) else new
    twice = order[~new | more]
    out = [(chunk % r, chunk, 1, X.dump(*X.merged(doc[twice], first[twice], count[twice])))]
    one, more = order[new], more[new]
    ends = X.cuts(key[one], r, ANCHOR_BITS)
    for b in range(r):
        x, m = one[ends[b] : ends[b + 1]], more[ends[b] : ends[b + 1]]
        if len(x):
            flat = body[np.repeat(start[x] - (np.cumsum(size[x]) - size[x]), size[x]) + np.arange(int(size[x].sum()))]
            out.append((b, chunk, 0, X.dump(*[c.astype(t) for c, t in zip((key[x], doc[x], first[x], count[x], before[x], size[x], m), PLACE)]) + flat.tobytes()))
    return X.rows(out)


def extended(number: np.ndarray, bounds: np.ndarray, key: np.ndarray, before: np.ndarray, window: int) -> np.ndarray:
    """Which windows (by their words before the anchor) of each stretch stand in another stretch of its key too.

    number: words of all stretches, stretch k at bounds[k] : bounds[k + 1]; before: words before its anchor.
    """
    n, width = len(before), int(before.max(initial=0))
    anchor, end = bounds[:-1] + before, bounds[1:]
    cols = np.arange(window)
    padded = np.append(number, np.zeros(window, number.dtype))
    own = (int(number.max(initial=0)) + 1 + np.arange(n))[:, None]  # past the end, nothing is equal
    right = np.where(anchor[:, None] + cols < end[:, None], padded[np.minimum(anchor[:, None] + cols, len(number))], own).astype(">u4")
    by_right = np.argsort(np.ascontiguousarray(right).view(f"S{4 * window}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    right = right.astype(np.uint32)
    _, group = np.unique(key, return_inverse=True)
    found = np.zeros((n, width + 1), bool)
    live = np.arange(n)
    for left in range(width + 1):
        order = live[np.argsort(group[live] * n + rank[live])]
        same = group[order][1:] == group[order][:-1]
        equal = right[order[1:]] == right[order[:-1]]
        common = np.where(same, np.where(equal.all(1), window, equal.argmin(1)), 0)
        most = np.zeros(len(order), np.int64)
        np.maximum(most[1:], common, out=most[1:])
        np.maximum(most[:-1], common, out=most[:-1])
        found[order, left] = left + most >= window
        # one more word before the anchor, for places that have it and share what they have with others
        shared = np.append(same, False) | np.append(False, same)
        live = order[shared & (before[order] > left)]
        if not len(live):
            break
        word = number[anchor[live] - left - 1]
        _, group[live] = np.unique(group[live] * (int(number.max()) + 1) + word, return_inverse=True)
    return found


@X.lean
def _extend(table: pa.Table, window: int) -> pa.Table:
    dest = table["dest"][0].as_py()
    out = X.kept_rows(table, 1)
    got = X.by_kind(table, 0)
    del table
    if not got:
        return X.rows(out)
    (key, doc, first, count, before, size, more), bounds = X.load_all([b for *_, b in got], PLACE)
    width = sum(np.dtype(t).itemsize for t in PLACE)
    flat = np.concatenate([np.frombuffer(b, np.uint8, offset=8 + width * (bounds[k + 1] - bounds[k])) for k, (*_, b) in enumerate(got)])
    chunks = [c for _, c, _ in got]
    del got
    doc, first, count, before, size = (x.astype("i8") for x in (doc, first, count, before, size))
    start = np.cumsum(size) - size
    order, new = distinct_bytes(flat, key, start, size)
    number = np.cumsum(new) - 1
    many = np.bincount(number) + np.bincount(number, more[order])
    one = order[new]
    # Stretches with several places are repeats from end to end; the others, as far as they can be extended with any of their key.
    whole = order[many[number] > 1]
    rows, begin, windows = [whole], [first[whole]], [count[whole]]
    a = 0
    while a < len(one):
        b = min(a + BATCH, len(one))
        b = int(np.searchsorted(key[one], key[one[b - 1]], "right"))
        x, single = one[a:b], many[a:b] == 1
        near = single | np.isin(key[x], key[x[single]])
        x, single = x[near], single[near]
        if len(x) > 1:
            at = np.cumsum(size[x] + 1) - (size[x] + 1)
            text = np.full(int((size[x] + 1).sum()), 32, np.uint8)
            inner = np.arange(int(size[x].sum())) - np.repeat(np.cumsum(size[x]) - size[x], size[x])
            text[np.repeat(at, size[x]) + inner] = flat[np.repeat(start[x], size[x]) + inner]
            w = Words(text, np.append(at, len(text)))
            row, left = np.nonzero(extended(word_numbers(w)[0], w.bounds, key[x], before[x], window) & single[:, None])
            rows.append(x[row])
            begin.append(first[x[row]] + before[x[row]] - left)
            windows.append(np.ones(len(row), "i8"))
        a = b
    row, begin, windows = np.concatenate(rows), np.concatenate(begin), np.concatenate(windows)
    for c, at in X.split_by_chunk(chunks, bounds, row, positions=True):
        out.append((c, dest, 1, X.dump(*X.merged(doc[row[at]], begin[at], windows[at]))))
    return X.rows(out)


@X.lean
def _remove(table: pa.Table, answers: pa.Table, window: int, schema: pa.Schema) -> pa.Table:
    if not table.num_rows:
        return schema.empty_table()
    table = X.ordered(table)
    (doc, first, count), _ = X.load_all([p for *_, p in X.by_kind(answers, 1)], X.RANGE)
    order = np.argsort(doc, kind="stable")
    doc, first, count = (x[order].astype("i8") for x in (doc, first, count))
    words, removed, texts, spans = [], [], [], []
    for i, j, w in _words(table):
        lo, hi = np.searchsorted(doc, [i, j])
        gone = covered(w.bounds[:-1][doc[lo:hi] - i] + first[lo:hi], count[lo:hi] + window - 1, len(w))
        words.append(w.counts)
        removed.append(np.bincount(w.doc[gone], minlength=len(w.counts)))
        texts.append(strings(*joined(w, ~gone)))
        step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        inner = np.flatnonzero(gone[1:] & gone[:-1] & (w.doc[1:] != w.doc[:-1])) + 1  # a repeat ends with its text
        a, b = np.sort(np.concatenate([np.flatnonzero(step == 1), inner])), np.sort(np.concatenate([np.flatnonzero(step == -1), inner]))
        per = np.bincount(w.doc[a], minlength=len(w.counts))
        base = w.bounds[:-1][w.doc[a]]
        flat = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], ["start", "end"])
        spans.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), flat))
    cols = {"n_words": pa.array(np.concatenate(words)), "n_removed": pa.array(np.concatenate(removed)), "kept_text": pa.concat_arrays(texts), "spans": pa.concat_arrays(spans)}
    return pa.table([cols[f.name] if f.name in cols else table[f.name] for f in schema], names=schema.names).cast(schema)


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, n: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, carried columns, n_words, n_removed, kept_text (kept words joined by one space) and spans (removed word ranges)."""
    if window < 1:
        raise ValueError("window must be positive")
    (n, r), block = X.partitions(docs, n, text_col), (window + 1) // 2
    new = ["n_words", "n_removed", "kept_text", "spans"]
    carry = [c for c in carry or [] if c not in {*new, "doc_id", "text", "chunk", "h", id_col, text_col}]
    parts = X.chunked(docs, n, id_col, text_col, carry)
    by = lambda df, key: df.groupBy(key)
    hits = by(by(parts, "chunk").applyInArrow(lambda t: _probe(t, r, block), X.ROWS), "dest").applyInArrow(lambda t: _match(t, hot), X.ROWS)
    places = by(parts, "chunk").cogroup(by(hits, "dest")).applyInArrow(lambda a, b: _places(a, b, r, block, window), X.ROWS)
    repeats = by(places, "dest").applyInArrow(lambda t: _extend(t, window), X.ROWS)
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in carry])
    out = plain.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")).schema
    schema = to_arrow_schema(out)
    return by(parts, "chunk").cogroup(by(repeats, "dest")).applyInArrow(lambda a, b: _remove(a, b, window, schema), out)
