"""Byte-level BPE ids of whole texts, with every distinct pre-token encoded once a worker.

Pre-token borders of the GPT-2 split pattern are found with array operations on character classes; pre-tokens are
hashed, and only those not yet in the worker's bounded cache go to the tokenizer. What has an equal hash is compared byte for
byte. Texts with a special token's string, and all texts of a tokenizer with another split, are encoded by the tokenizer as they are.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from vectide.llm.textnp import byte_hashes, same_bytes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHE_LIMIT = 1_500_000
_TABLES: dict[str, np.ndarray] = {}
_ENCODERS: dict[str, Encoder] = {}


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point: white space, letter, number, other."""
    if not _TABLES:
        table = np.full(0x110000, OTHER, np.uint8)
        for p in range(0x110000):
            c = unicodedata.category(chr(p))[0]
            if c == "L":
                table[p] = LETTER
            elif c == "N":
                table[p] = NUMBER
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _TABLES["class"] = table
    return _TABLES["class"][points]


def borders(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in code points; starts: of the texts."""
    n = len(points)
    kind = classes(points)
    fresh = np.zeros(n + 1, bool)
    fresh[starts[starts < n]] = True
    fresh[n] = True
    begin = fresh.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin[:n])
    ends = np.append(runs[1:], n)
    out = begin.copy()
    # A run of white space before something else gives up its last character; a plain space joins what follows.
    space = kind[runs] == SPACE
    inner = space & ~fresh[ends]
    last = ends[inner] - 1
    out[last] = True
    out[ends[inner][points[last] == 32]] = False
    # 's 't 're 've 'm 'll 'd where a match can start at the apostrophe.
    quote = (kind[runs] == OTHER) & (ends - runs == 1) & (points[runs] == 39) & ~fresh[ends] & out[runs]
    q = runs[quote]
    q = q[kind[np.minimum(q + 1, n - 1)] == LETTER]
    if len(q):
        a = points[q + 1]
        two = (q + 2 < n) & ~fresh[np.minimum(q + 2, n)]
        b = np.where(two, points[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        size = np.where(one, 1, np.where(pair, 2, 0))
        q, size = q[size > 0], size[size > 0]
        out[q + 1] = False
        rest = q + 1 + size
        rest = rest[rest < n]
        out[rest] = True
    return np.flatnonzero(out[:n])


class Encoder:
    """encode(data, offsets) gives flat ids and their offsets."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        self.known = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.body, self.begin, self.width = np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        ids = self.plain([t.decode() for t in texts])
        size, width = np.array([len(x) for x in ids], np.int64), np.array([len(t) for t in texts], np.int64)
        new = [keys, len(self.flat) + np.cumsum(size) - size, size, len(self.body) + np.cumsum(width) - width, width]
        self.flat = np.concatenate([self.flat, np.array([y for x in ids for y in x], np.uint32)])
        self.body = np.concatenate([self.body, np.frombuffer(b"".join(texts), np.uint8)])
        cols = [np.concatenate(c) for c in zip((self.keys, self.at, self.size, self.begin, self.width), new)]
        order = np.argsort(cols[0], kind="stable")
        self.keys, self.at, self.size, self.begin, self.width = (c[order] for c in cols)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if not self.known or any(s in raw for s in self.special):
            ids = self.plain([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.array([y for x in ids for y in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        head = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        start = borders(points, np.searchsorted(head, offsets[:-1]))
        first = head[start]
        last = np.append(first[1:], len(data))
        key = byte_hashes(data, first, last)
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_LIMIT:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            self.learn(distinct[new], [raw[first[w] : last[w]] for w in where[new]])
            place = np.searchsorted(self.keys, distinct)
        place = place[back]
        width, size, at = last - first, self.size[place], self.at[place]
        same = width == self.width[place]
        same[same] = same_bytes(data, first[same], self.body, self.begin[place[same]], width[same])
        if not same.all():  # equal hashes of different pre-tokens
            odd = np.flatnonzero(~same)
            ids = self.plain([raw[first[k] : last[k]].decode() for k in odd])
            size[odd] = [len(x) for x in ids]
            at[odd] = len(self.flat) + np.cumsum(size[odd]) - size[odd]
            flat = np.concatenate([self.flat, np.array([y for x in ids for y in x], np.uint32)])
        else:
            flat = self.flat
        ends = np.cumsum(size)
        flat = flat[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(first, offsets)]
        return flat, bounds


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
