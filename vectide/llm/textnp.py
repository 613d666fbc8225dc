"""Vectorised helpers on blocks of whole texts, used inside Arrow tasks.

A block is one uint8 array of concatenated UTF-8 texts with int64 offsets. Hashes read eight bytes at a time and mix after each
step, so no arithmetic structure of a text survives (sums of powers modulo 2**64 collide on Thue-Morse texts); runs of up
to eight bytes of one length never collide. The hash of a run of k words is made from those of shorter runs, by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 500_000
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def join64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes, one to one in each of them."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (and from the end, where zeros follow) as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PIECE = 64


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever a run stands; long runs are hashed by pieces, then over the pieces' hashes."""
    view, size = lanes(data), end - start
    h = mix64((view[start] & LANE_MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    live, at = np.flatnonzero((size > 8) & (size <= PIECE)), 8
    while len(live):
        left = size[live] - at
        h[live] = join64(h[live], view[start[live] + at] & LANE_MASKS[np.minimum(left, 8)])
        at += 8
        live = live[left > 8]
    long = np.flatnonzero(size > PIECE)
    if len(long):
        count = -(-size[long] // PIECE)
        first = np.cumsum(count) - count
        a = np.repeat(start[long] - PIECE * first, count) + PIECE * np.arange(int(count.sum()))
        pieces = byte_hashes(data, a, np.minimum(a + PIECE, np.repeat(end[long], count)))
        h[long] = join64(byte_hashes(pieces.view(np.uint8), 8 * first, 8 * (first + count)), size[long].astype(np.uint64))
    return h


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i : i + k] for each i at which k values are left."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    h, have = values, 1
    while 2 * have <= k:
        h = join64(h[:-have], h[have:])
        have *= 2
    return join64(h[: len(h) - (k - have)], h[k - have :]) if have < k else h


def same_bytes(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals other[b : b + size]."""
    x, y, same = lanes(data), lanes(other), np.ones(len(a), bool)
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        mask = LANE_MASKS[np.minimum(size[live] - at, 8)]
        equal = (x[a[live] + at] & mask) == (y[b[live] + at] & mask)
        same[live[~equal]] = False
        at += 8
        live = live[equal]
        live = live[size[live] > at]
    return same


def distinct_bytes(data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and content (equal ones as they come), and whether each in that order is the first of its equals; bytes are compared."""
    order = np.argsort(join64(key, byte_hashes(data, start, start + size) if hashes is None else hashes), kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    new = np.ones(len(order), bool)
    if len(order):
        a, b = order[:-1], order[1:]
        maybe = (key[a] == key[b]) & (size[a] == size[b])
        near = np.flatnonzero(maybe)
        maybe[near] = same_bytes(data, start[a[near]], data, start[b[near]], size[b[near]])
        new[1:] = ~maybe
    return order, new


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow column; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """The inverse of packed()."""
    big = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8)))
    return big.cast(kind or pa.string())


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words of the texts of a block: byte ranges, text numbers, numbers within the text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES, lower: bool = False):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n, texts = len(data), len(offsets) - 1
        kind = table[data]  # of a number table, runs of one number over 0 are words
        inside = kind > 0
        first = inside.copy()
        first[1:] &= kind[1:] != kind[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        first[heads] |= inside[heads]
        last = inside.copy()
        last[:-1] &= kind[1:] != kind[:-1]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] |= inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # word range of each text
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(texts), self.counts)
        self.hash = byte_hashes(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def take(self, keep: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The words of some texts, whose bytes and offsets are given."""
        out = object.__new__(Words)
        own = keep[self.doc]
        number = np.cumsum(keep) - 1
        out.data, out.offsets, out.doc = data, offsets, number[self.doc[own]]
        shift = offsets[out.doc] - self.offsets[self.doc[own]]
        out.start, out.end, out.hash = self.start[own] + shift, self.end[own] + shift, self.hash[own]
        out.counts = self.counts[keep]
        out.bounds = np.concatenate([[0], np.cumsum(out.counts)])
        return out

    def at(self) -> np.ndarray:
        """Number of each word within its text."""
        return np.arange(len(self)) - self.bounds[:-1][self.doc]

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.bounds[1:][self.doc] - np.arange(len(self))

    def run_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words of any length."""
        return byte_hashes(self.hash.view(np.uint8), 8 * start, 8 * end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words within one text."""
        at = np.flatnonzero(self.left() >= k)
        return at, window_hashes(self.hash, k)[at]


def word_numbers(w: Words) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """A number for each word, equal for equal bytes only; the first word of each hash; numbers of words whose hash another word has."""
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    size, like = w.end - w.start, first[back]
    odd = np.flatnonzero((size != size[like]) | ~same_bytes(w.data, w.start, w.data, w.start[like], size))
    extra: dict[bytes, int] = {}
    for k in odd:
        back[k] = extra.setdefault(w.data[w.start[k] : w.end[k]].tobytes(), len(first) + len(extra))
    return back, first, extra


def word_counts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES) -> np.ndarray:
    """Words of each text."""
    first = table[data]
    inside = first.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] |= inside[heads]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [start, start + width)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every text, joined by one space."""
    n = len(words.data)
    kept = np.flatnonzero(keep)
    doc = words.doc[kept]
    final = np.ones(len(kept), bool)
    final[:-1] = doc[1:] != doc[:-1]
    ends = words.end[kept] + ~final
    edge = np.zeros(n + 2, np.int8)
    edge[words.start[kept]] += 1
    edge -= np.bincount(ends, minlength=n + 2).astype(np.int8)
    mask = np.cumsum(edge[:n], dtype=np.int8) > 0
    body = words.data.copy()
    body[words.end[kept][~final]] = 32
    total = np.concatenate([[0], np.cumsum(ends - words.start[kept])])
    return body[mask], total[np.searchsorted(doc, np.arange(len(words.offsets)))]


def planes(values: np.ndarray, width: int) -> bytes:
    """Sorted integers as byte planes, high bytes first: the high planes compress well."""
    raw = np.ascontiguousarray(values, ">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return np.ascontiguousarray(raw.T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, 8 - width :] = raw.T
    return out.view(">u8").ravel().astype(np.uint64)
