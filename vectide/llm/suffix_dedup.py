"""Suffix-array de-duplication of byte strings, distributed by minimizers.

All equal strings of ``length`` bytes have their least (by hash) ``K``-byte substring at the same place, so a text is cut
into segments, runs of windows with one minimizer occurrence, and a key range of minimizer hashes sees every copy of every window
of its keys. Two equal windows never lie in one segment.

1. A chunk of documents sends one record for each distinct segment, with its first place; further copies within the
   chunk, compared byte for byte, are its places too. So a text that fills a third of the table is one record a chunk.
2. A key range asks the chunks for the bytes of segments that can share a window: those with copies, and those which
   agree with another one of their key next to the minimizer on one side (by hash; a false agreement only costs work).
3. The bytes of a key range, one copy of each distinct segment, are concatenated into texts of bounded size that never
   part a key. On the Burrows-Wheeler transform of each, intervals are extended backward breadth-first, which finds the
   places where neighbouring suffixes share 0, 1, 2, ... bytes; the search stops at ``length``, and what is not parted by
   then are the groups of suffixes with equal windows. Of all places of a group the first stays. This decides for windows of different
   segments; further copies of one segment were found equal byte for byte in steps 1 and 2, and are places of its windows.
   A key with over ``hot`` different segments (a common passage in many surroundings) would make such a text large: its
   windows become segments and keys of their own, dealt by their hash to all key ranges, and are judged by the transform there.
4. Chunks remove the bytes of all repeated windows.

Null texts are empty; texts shorter than ``length`` keep all bytes; documents are ordered by id, null last, rows
that repeat an id by a hash of their text, then by it; an empty table gives an empty result; other columns are not read. Very
long texts are scanned whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm import exchange as X
from vectide.llm.textnp import blocks, byte_hashes, distinct_bytes, join64, lanes, mix64, packed, sliding_min

K, TEXT_BYTES = 32, 1_000_000
POSITION = np.uint64((1 << 28) - 1)
#: key, doc number in the chunk, first window, windows, left and right hashes, whether there are more copies
RECORD = ["u8", "u4", "u4", "u1", "u4", "u4", "u1"]
REQUEST = ["u4", "u4", "u1", "u1", "u8"]  # doc number, first window, windows, 1 for a hot key, key
BYTES = ["u8", "i8", "i8", "u4", "u4", "u1"]  # key, doc id, hash of the text, doc number, first window, windows; the bytes follow


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """Key, text, first byte, windows, left hash, right hash, hash of each segment."""
    k = min(K, length)
    span, n = length - k + 1, len(data)
    none = [np.zeros(0, t) for t in ("u8", "i8", "i8", "i8", "u8", "u8", "u8")]
    if n < length:
        return none
    h = _strings(data, k) if k >= 8 else mix64(lanes(data)[: n - k + 1] & np.uint64((1 << 8 * k) - 1))
    at = np.arange(len(h))
    least = sliding_min((h & ~POSITION) | at.astype(np.uint64), span) & POSITION
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int8)
    long = size >= length
    valid[offsets[:-1][long]] += 1
    valid[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(valid[: len(least)], dtype=np.int8) > 0
    p = np.flatnonzero(valid)
    if not len(p):
        return none
    m = least[p].astype(np.int64)
    head = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)))
    first, m = p[head], m[head]
    count = np.diff(np.append(head, len(p)))
    end = first + count - 1 + length
    doc = np.searchsorted(offsets, first, "right") - 1
    half = min((length - k) // 2, max(64 - k, 0))
    left, right = m - half, m + k + half
    short = lambda a, b, ok: np.where(ok, (byte_hashes(data, np.where(ok, a, 0), np.where(ok, b, 0)) & np.uint64(0xFFFFFFFF)) | np.uint64(1), np.uint64(0))
    whole = (m - first).astype(np.uint64)
    for step in range(0, 2 * length - k, k):
        whole = join64(whole, h[np.minimum(first + step, end - k)])
    # minimizer hashes are small, so they are mixed again
    return [mix64(h[m] ^ np.uint64(0x2545F4914F6CDD1D)), doc, first, count, short(left, m + k, left >= first), short(m, right, right <= end), whole]


def _strings(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes, 8 at least, from each place."""
    h, have = mix64(lanes(data)[: len(data) - 7]), 8
    while 2 * have <= k:
        h = join64(h[:-have], h[have:])
        have *= 2
    return join64(h[: len(h) - (k - have)], h[k - have :]) if have < k else h


@X.lean
def _scan(table: pa.Table, r: int, length: int) -> pa.Table:
    chunk = table["chunk"][0].as_py()
    table = X.ordered(table)
    data, off = packed(table["text"])
    parts = []
    for i, j in blocks(off):
        own = segments(data[off[i] : off[j]], off[i : j + 1] - off[i], length)
        parts.append([own[0], own[1] + i, own[2] + off[i], *own[3:]])
    if not sum(len(p[0]) for p in parts):
        return X.rows([])
    key, doc, start, count, left, right, whole = (np.concatenate(c) for c in zip(*parts))
    del parts
    order, new = distinct_bytes(data, key, start, count - 1 + length, whole)
    again = order[~new]
    out = [(chunk % r, chunk, 1, X.dump(*X.merged(doc[again], start[again] - off[doc[again]], count[again])))]
    more = np.append(~new[1:], False)[new] if len(new) else new
    first = order[new]
    cols = [c.astype(t) for c, t in zip((key[first], doc[first], start[first] - off[doc[first]], count[first], left[first], right[first], more), RECORD)]
    at = X.cuts(cols[0], r, 64)
    return X.rows(out + [(b, chunk, 0, X.dump(*[c[at[b] : at[b + 1]] for c in cols])) for b in range(r) if at[b + 1] > at[b]])


def _twice(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether another row of the same key has the same mark other than 0; keys are sorted."""
    x = join64(key, mark.astype(np.uint64))
    _, back, many = np.unique(x, return_inverse=True, return_counts=True)
    return (mark > 0) & (many[back] > 1)


@X.lean
def _compare(table: pa.Table, hot: int) -> pa.Table:
    dest = table["dest"][0].as_py()
    got = X.by_kind(table, 0)
    out = X.kept_rows(table, 1)
    if got:
        (key, doc, first, count, left, right, more), bounds = X.load_all([p for *_, p in got], RECORD)
        order = np.argsort(key, kind="stable")
        k = key[order]
        near = _twice(k, left[order]) | _twice(k, right[order]) | (more[order] > 0)
        order = order[near]
        _, back, many = np.unique(key[order], return_inverse=True, return_counts=True)
        crowd = np.zeros(len(key), "u1")
        crowd[order] = many[back] > hot
        for c, rows in X.split_by_chunk([c for _, c, _ in got], bounds, np.sort(order)):
            out.append((c, dest, 2, X.dump(*[x[rows] for x in (doc, first, count, crowd, key)])))
    return X.rows(out)


@X.lean
def _ship(table: pa.Table, answers: pa.Table, r: int, length: int) -> pa.Table:
    if not table.num_rows:
        return X.rows([])
    chunk = table["chunk"][0].as_py()
    table = X.ordered(table)
    data, off = packed(table["text"])
    ids, h = X.ids(table), table["h"].combine_chunks().to_numpy(zero_copy_only=False).astype("i8")
    ranges, _ = X.load_all([p for *_, p in X.by_kind(answers, 1)], X.RANGE)
    out, windows = [], []

    def sent(dest, key, doc, first, count):
        size = count - 1 + length
        flat = data[np.repeat(off[doc] + first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return (dest, chunk, 2, X.dump(*[c.astype(t) for c, t in zip((key, ids[doc], h[doc], doc, first, count), BYTES)]) + flat.tobytes())

    for dest, blob in X.replies(answers, 2).items():
        doc, first, count, hot, key = X.load(blob, REQUEST)
        doc, first, count = doc.astype("i8"), first.astype("i8"), count.astype("i8")
        cold, warm = hot == 0, hot > 0
        if cold.any():
            out.append(sent(dest, key[cold], doc[cold], first[cold], count[cold]))
        if warm.any():
            many = count[warm]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            windows.append(np.stack([np.repeat(doc[warm], many), np.repeat(first[warm], many) + inner]))
    if windows:
        doc, first = np.concatenate(windows, 1)
        order = np.lexsort([first, doc])
        doc, first = doc[order], first[order]
        start, size = off[doc] + first, np.full(len(doc), length)
        key = byte_hashes(data, start, start + length)
        order, new = distinct_bytes(data, key, start, size)
        again, order = order[~new], order[new]
        ranges = [np.concatenate(x) for x in zip(ranges, X.merged(doc[again], first[again], np.ones(len(again), "i8")))]
        at = X.cuts(key[order], r, 64)
        out += [sent(b, key[x], doc[x], first[x], np.ones(len(x), "i8")) for b in range(r) if len(x := order[at[b] : at[b + 1]])]
    out.append((chunk % r, chunk, 1, X.dump(*X.merged(*ranges))))
    return X.rows(out)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic suffixes in the order of their first bytes, depth of them at least, by prefix doubling; for texts of under 2**21 bytes.

    Keys and places share one number, as sorting numbers is faster than sorting places by them.
    """
    n = len(text)
    bits = np.uint64(21)
    if n >= 1 << 21:
        raise ValueError("a text of under 2**21 bytes is needed")
    key, have = np.zeros(n, np.uint64), 5
    for k in range(5):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    place, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << 21) - 1)
    rank = np.empty(n, np.uint64)
    while True:
        key <<= bits
        key |= place
        key.sort()
        order = (key & mask).astype(np.int64)
        if have >= depth:
            return order
        key >>= bits
        new = np.append(np.uint64(0), (key[1:] != key[:-1]).astype(np.uint64))
        rank[order] = np.cumsum(new)
        key = (rank << bits) | np.roll(rank, -have)
        have *= 2


def equal_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the number of the group that shares its first length bytes.

    Interval [lo, hi) holds the suffixes that begin with some word. For each byte before them (their BWT entries), the last
    such entry maps to the end of the interval of the longer word. An end first seen from words of l bytes is a
    place where neighbours share exactly l bytes; only its interval is extended further.
    """
    n = len(text)
    order = suffix_order(text, length)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")  # rank after a step to the left, inverted
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[by_byte[:-1][same]] = by_byte[1:][same]
    before[by_byte[1:][same]] = by_byte[:-1][same]
    parted = np.zeros(n + 1, bool)
    parted[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        last = at[after[at] >= np.repeat(hi, size)]
        first = at[before[at] < np.repeat(lo, size)]
        lo, hi = np.sort(step[first]), np.sort(step[last]) + 1
        new = ~parted[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        parted[hi] = True
    return order, np.cumsum(parted[:n])


@X.lean
def _transform(table: pa.Table, length: int) -> pa.Table:
    dest = table["dest"][0].as_py()
    out = X.kept_rows(table, 1)
    got = X.by_kind(table, 2)
    del table
    if got:
        (key, ids, h, doc, first, count), bounds = X.load_all([b for *_, b in got], BYTES)
        width = sum(np.dtype(t).itemsize for t in BYTES)
        flat = np.concatenate([np.frombuffer(b, np.uint8, offset=8 + width * (bounds[k + 1] - bounds[k])) for k, (*_, b) in enumerate(got)])
        chunks = [c for _, c, _ in got]
        del got
        size = count.astype("i8") - 1 + length
        start = np.cumsum(size) - size
        by_place = np.lexsort([first, doc, h, ids])
        order, new = distinct_bytes(flat, key[by_place], start[by_place], size[by_place])
        order = by_place[order]  # the first of each distinct segment has its first place
        one = order[new]
        room = np.cumsum(size[one] + 1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(one):  # texts of bounded size that hold all distinct segments of their keys
            b = max(int(np.searchsorted(room, (room[a - 1] if a else 0) + TEXT_BYTES, "right")), a + 1)
            b = int(np.searchsorted(key[one], key[one[b - 1]], "right"))
            found.append(_repeats(one[a:b], flat, start, size, count, (first, doc, h, ids), length))
            a = b
        row, window = (np.concatenate(c) for c in zip(*found))
        # Windows of further places of a segment are in the groups of its first place, which stands before them.
        more = order[~new]
        doc, first = doc.astype("i8"), first.astype("i8")
        rows = np.concatenate([row, more])
        begin, many = np.concatenate([first[row] + window, first[more]]), np.concatenate([np.ones(len(row), "i8"), count[more].astype("i8")])
        for c, at in X.split_by_chunk(chunks, bounds, rows, positions=True):
            out.append((c, dest, 1, X.dump(*X.merged(doc[rows[at]], begin[at], many[at]))))
    return X.rows(out)


def _repeats(rows, flat, start, size, count, place, length) -> tuple[np.ndarray, np.ndarray]:
    """Rows and windows within them that are not the first of their equals, by the transform; place: sort keys of rows, the first the weakest."""
    own = size[rows]
    begin = np.cumsum(own + 1) - (own + 1)
    text = np.zeros(int((own + 1).sum()), np.uint8)
    inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    text[np.repeat(begin, own) + inner] = flat[np.repeat(start[rows], own) + inner]
    order, group = equal_groups(text, length)
    of = np.empty(len(text), np.int64)
    of[order] = group
    many = count[rows].astype("i8")
    window = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    g = of[np.repeat(begin, many) + window]
    _, back, members = np.unique(g, return_inverse=True, return_counts=True)
    shared = members[back] > 1
    row, window, g = np.repeat(rows, many)[shared], window[shared], g[shared]
    first, *rest = place
    by = np.lexsort([first[row] + window, *[x[row] for x in rest], g])
    again = by[np.append(False, g[by][1:] == g[by][:-1])] if len(by) else by
    return row[again], window[again]


@X.lean
def _remove(table: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    if not table.num_rows:
        return SCHEMA.empty_table()
    table = X.ordered(table)
    data, off = packed(table["text"])
    (doc, first, count), _ = X.load_all([p for *_, p in X.by_kind(answers, 1)], X.RANGE)
    order = np.argsort(doc, kind="stable")
    doc, a = doc[order], off[doc[order]] + first[order]
    b = a + count[order].astype("i8") - 1 + length
    removed, spans, kept = [], [], []
    for i, j in blocks(off):
        lo, hi = np.searchsorted(doc, [i, j])
        n = int(off[j] - off[i])
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, a[lo:hi] - off[i], 1)
        np.add.at(edge, b[lo:hi] - off[i], -1)
        gone = np.cumsum(edge[:n]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        heads = off[i:j] - off[i]
        heads = heads[heads < n]
        begin[heads] |= gone[heads]
        for mask, to in ((gone, removed), (begin, spans)):
            to.append(np.diff(np.concatenate([[0], np.cumsum(mask)])[off[i : j + 1] - off[i]]))
        ends = np.concatenate([[0], np.cumsum(~gone)])[off[i : j + 1] - off[i]]
        kept.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[off[i] : off[j]][~gone])]).cast(pa.binary()))
    cols = [pa.array(np.diff(off)), pa.array(np.concatenate(removed)), pa.array(np.concatenate(spans)), pa.chunked_array(kept, pa.binary())]
    return pa.table([table["doc_id"], *cols], schema=SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def dedup_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", n: int | None = None, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes). hot: segments of one key for one text at most."""
    if not 2 <= length <= 255:
        raise ValueError("length must be 2 to 255 bytes")
    n, r = X.partitions(docs, n, text_col)
    hot = hot or max(TEXT_BYTES // (2 * length), 2)
    if (hot + 1) * 2 * length + TEXT_BYTES >= 1 << 21:
        raise ValueError("the segments of one key would not fit a text")
    parts = X.chunked(docs, n, id_col, text_col)
    records = parts.groupBy("chunk").applyInArrow(lambda t: _scan(t, r, length), X.ROWS)
    answers = records.groupBy("dest").applyInArrow(lambda t: _compare(t, hot), X.ROWS)
    texts = parts.groupBy("chunk").cogroup(answers.groupBy("dest")).applyInArrow(lambda a, b: _ship(a, b, r, length), X.ROWS)
    repeats = texts.groupBy("dest").applyInArrow(lambda t: _transform(t, length), X.ROWS)
    return parts.groupBy("chunk").cogroup(repeats.groupBy("dest")).applyInArrow(lambda a, b: _remove(a, b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
