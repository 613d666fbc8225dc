"""Components of texts whose sets of word shingles are similar, by a size-aware heavy-light join.

Two texts link when 100 * |A & B| >= percent * |A | B|. Texts of the same words in the same order are one node, kept as their least id.

Light: for small sets, all subsets of the size that a link needs are enumerated (for each size of the partner); two small
sets that link share one. Heavy: for other sets, inverted lists are scanned. A set enters the lists of its
prefix only, the rarest of its shingles, as many as let no link escape; shingles of one node enter none. Sets that can
link across the boundary take part in both. The boundary is the size at which, over the histogram of set sizes, the
estimated number of rows moved is least.

Hashes (48 bits) only name lists and order shingles. Words are compared before a shingle counts as common to two texts, or as a repeat within
one, so sizes and links are exact whatever collides. Nodes are told apart by 128 bits of the SHA-256 of their words.

Each list has one hub, tested against all its members; members that link with it are connected. Where a list has other members, the
test leaves a sketch of each: the hub's shingles that it has, one bit each, and 16 bits of the hash of every other one. Sketches of a hub come
together, and give for each member that doesn't link with the hub and each other one a number of common shingles that is never too small. Only pairs
for which that is enough are tested. Texts travel to the chunks of list members (once a chunk, not once a member), and tests compare whole sets.
A task reports its links as stars that connect the same nodes, so a large group leaves fewer edges than it has members and hubs.

Words are runs of other than white space after lower-casing A-Z; a text with fewer words than ``width`` is one
shingle of all of them. Texts that are null or have no words have an empty set and link with nothing. Repeated rows are nodes
like others; a null id counts as the largest; very long texts are sets of any size; of equal texts the least id, then the first place,
stands for all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.llm import exchange as X
from vectide.llm.components import components, forest
from vectide.llm.textnp import LOWER, Words, blocks, joined, mix64, packed, same_bytes, word_counts

LOW32, LOW48 = np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1)
POSTINGS, EDGES, HUBS, TESTS, SHIPS, SETS, UNLINKED, DIGESTS, REPS, DOCS, PAIRS = range(11)
DOC = ["u8", "u8", "i8", "u4"]  # digest of the words in two halves, id, size of the set
SKETCH = ["u8", "u8", "u4", "u1", "u4", "u4"]  # hub, member, size of its set, flags, bytes of bits, number of further hashes
MAX_LIGHT, TESTED = 64, 1 << 20  # sizes that the histogram tells apart (subsets of larger sets cost over 10**9 rows each); pairs or shingles compared at a time
SHIPPED = 4_000_000  # bytes of shipped texts whose sets are held at a time


def needed(n: int, m: int, percent: int) -> int:
    """Least intersection of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def boundary(hist: dict[int, int], percent: int) -> int:
    """Largest size of light sets, by rows moved: subset keys for light sets; shingles and prefixes for those that may link with heavy ones."""
    best = (float("inf"), 0)
    for x in range(MAX_LIGHT + 1):
        light = sum(c * sum(comb(n, needed(n, m, percent)) for m in partners(n, percent) if m <= x and needed(n, m, percent) <= min(n, m)) for n, c in hist.items() if 0 < n <= x)
        heavy = sum(c * (n + int(prefix_size(np.array(n), percent))) for n, c in hist.items() if 100 * n // percent > x)
        best = min(best, (light + heavy, x))
    return best[1]


def _sizes(docs: DataFrame, width: int, text_col: str, most: int = MAX_LIGHT) -> dict[int, int]:
    """Texts by shingles (counted with repeats), up to most."""

    def run(batches):
        for batch in batches:
            data, off = packed(batch.column(0))
            for i, j in blocks(off):
                words = word_counts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                many = np.bincount(np.minimum(np.where(words > 0, np.maximum(words - width + 1, 1), 0), most + 1), minlength=most + 2)
                yield pa.RecordBatch.from_pydict({"k": np.arange(1, most + 1), "n": many[1 : most + 1]})

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "k long, n long")
    return {r.k: r.n for r in rows.groupBy("k").agg(F.sum("n").alias("n")).where("n > 0").collect()}  # 64 rows at most


class Sets:
    """Distinct shingles of some texts: flat (48 bits of their hashes, sorted in each text), and with words the places of their words.

    Shingles of one text with one hash are compared: repeats are dropped, different ones stay both (odd texts). With digests,
    128 bits of the SHA-256 of each text's words, joined by one space, are made from the same words.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int, words: bool = False, digests: bool = False):
        flat, sizes, odd = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        places: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]  # first word and number of words of shingles; starts and ends of words
        seen, sums = 0, []
        for i, j in blocks(off):
            for a in range(i, j, 60_000):
                b = min(a + 60_000, j)
                w = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
                at, h = w.windows(width)
                short = np.flatnonzero((w.counts > 0) & (w.counts < width))
                first = np.concatenate([at, w.bounds[:-1][short]])
                many = np.concatenate([np.full(len(at), width), w.counts[short]])
                doc = np.concatenate([w.doc[at], short]).astype(np.uint64)
                h = np.concatenate([h, w.run_hash(w.bounds[:-1][short], w.bounds[1:][short])])
                keys = (doc << np.uint64(48)) | (h >> np.uint64(16))
                order = np.argsort(keys)
                keys, first, many = keys[order], first[order], many[order]
                twice = np.flatnonzero(keys[1:] == keys[:-1])
                bad = np.zeros(b - a, bool)
                if len(twice):
                    keep = np.ones(len(keys), bool)
                    keep[twice + 1] = ~_same_words(w, first[twice], many[twice], w, first[twice + 1], many[twice + 1])
                    for d in np.unique((keys[twice + 1][keep[twice + 1]] >> np.uint64(48)).astype(np.int64)):  # each against all of its hash
                        bad[d] = True
                        mine = np.flatnonzero(keys >> np.uint64(48) == np.uint64(d))
                        got = [tuple(_words(w, first[x], many[x])) for x in mine]
                        keep[mine] = [x not in got[:k] for k, x in enumerate(got)]
                    keys, first, many = keys[keep], first[keep], many[keep]
                if digests:
                    body, ends = joined(w, np.ones(len(w), bool))
                    raw = memoryview(body)
                    sums += [hashlib.sha256(raw[x:y]).digest()[:16] for x, y in zip(ends[:-1], ends[1:])]
                flat.append(keys & LOW48)
                sizes.append(np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=b - a))
                odd.append(bad)
                if words:
                    for to, x in zip(places, (first + seen, many, w.start + off[a], w.end + off[a])):
                        to.append(x)
                    seen += len(w)
        self.flat, self.sizes, self.odd = np.concatenate(flat), np.concatenate(sizes), np.concatenate(odd)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.digests = np.frombuffer(b"".join(sums), "<u8").reshape(-1, 2)
        if words:
            self.data = LOWER[data]
            self.first, self.many, self.start, self.end = (np.concatenate(x) for x in places)

    def exact(self, doc: int) -> set[tuple[bytes, ...]]:
        return {tuple(_words(self, self.first[k], self.many[k])) for k in range(self.bounds[doc], self.bounds[doc + 1])}


def _words(w, first: int, many: int) -> list[bytes]:
    return [w.data[w.start[k] : w.end[k]].tobytes() for k in range(first, first + many)]


def _same_words(w, a: np.ndarray, n: np.ndarray, other, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether n words of w from word a are m words of other from word b: as one run of bytes, else word for word."""
    start, at = w.start[a], other.start[b]
    size, there = w.end[a + n - 1] - start, other.end[b + m - 1] - at
    same = (n == m) & (size == there)
    some = np.flatnonzero(same)
    same[some] = same_bytes(w.data, start[some], other.data, at[some], size[some])
    left = np.flatnonzero(~same & (n == m))
    for k in range(int(n[left].max(initial=0))):
        live = left[n[left] > k]
        x, y = a[live] + k, b[live] + k
        size = w.end[x] - w.start[x]
        equal = size == other.end[y] - other.start[y]
        equal[equal] = same_bytes(w.data, w.start[x[equal]], other.data, other.start[y[equal]], size[equal])
        left = np.setdiff1d(left, live[~equal], assume_unique=True)
    same[left] = True
    return same


def _texts(table: pa.Table, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    return packed(table["text"] if which is None else table["text"].take(pa.array(which)))


def node(chunk: int, idx: np.ndarray) -> np.ndarray:
    return (np.uint64(chunk) << np.uint64(32)) | idx.astype(np.uint64)


def _chunk_of(nodes: np.ndarray) -> np.ndarray:
    return (nodes >> np.uint64(32)).astype(np.int64)


def _sent(keys: np.ndarray, columns: list[np.ndarray], bits: int, n: int, chunk: int, kind: int) -> list:
    """Rows of sorted keys and their columns, to the key ranges."""
    at = X.cuts(keys, n, bits)
    return [(b, chunk, kind, X.dump(keys[at[b] : at[b + 1]], *[c[at[b] : at[b + 1]] for c in columns])) for b in range(n) if at[b + 1] > at[b]]


@X.lean
def _digests(table: pa.Table, n: int, width: int) -> pa.Table:
    chunk = table["chunk"][0].as_py()
    table = X.ordered(table)
    s = Sets(*_texts(table), width, digests=True)
    ids = X.ids(table)
    a, b = (s.digests[:, k].copy() for k in (0, 1))
    out = [(chunk, chunk, DOCS, X.dump(a, b, ids, s.sizes.astype("u4")))]
    full = np.flatnonzero(s.sizes)
    order = full[np.lexsort([full, b[full], a[full]])]
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else order.astype(bool)
    first = order[new]  # in the order of ids
    return X.rows(out + _sent(a[first], [b[first], ids[first], node(chunk, first)], 64, n, chunk, DIGESTS))


@X.lean
def _representatives(table: pa.Table) -> pa.Table:
    dest = table["dest"][0].as_py()
    out = [(d, c, DOCS, p) for d, c, p in X.by_kind(table, DOCS, raw=True)]
    got = X.by_kind(table, DIGESTS)
    if got:
        (a, b, ids, nodes), bounds = X.load_all([p for *_, p in got], ["u8", "u8", "i8", "u8"])
        order = np.lexsort([nodes, ids, b, a])
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        head = order[new]
        back = np.empty(len(a), np.int64)
        back[order] = np.cumsum(new) - 1
        for k, (_, c, _) in enumerate(got):
            r = head[back[bounds[k] : bounds[k + 1]]]
            out.append((c, dest, REPS, X.dump(nodes[r], ids[r])))
    return X.rows(out)


class State:
    """Ids, sizes and representatives of the documents of a chunk."""

    def __init__(self, answers: pa.Table, n: int):
        got = X.by_kind(answers, DOCS)
        a, b, self.ids, self.sizes = X.load_all([p for *_, p in got], DOC)[0]
        self.chunk = got[0][0] if got else 0
        full = np.flatnonzero(self.sizes)
        order = full[np.lexsort([full, b[full], a[full]])]
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else order.astype(bool)
        first, local = order[new], np.cumsum(new) - 1
        at = X.cuts(a[first], n, 64)
        nodes, ids = np.zeros(len(first), "u8"), np.zeros(len(first), "i8")
        for d, blob in X.replies(answers, REPS).items():
            nodes[at[d] : at[d + 1]], ids[at[d] : at[d + 1]] = X.load(blob, ["u8", "i8"])
        self.rep, self.rep_id = node(self.chunk, np.arange(len(self.ids))), self.ids.copy()
        self.rep[order], self.rep_id[order] = nodes[local], ids[local]
        self.nodes = np.flatnonzero((self.sizes > 0) & (self.rep == node(self.chunk, np.arange(len(self.ids)))))


def _heavy(state: State, light: int, percent: int) -> np.ndarray:
    return state.nodes[100 * state.sizes[state.nodes].astype(np.int64) // percent > light]


@X.lean
def _shingles(table: pa.Table, answers: pa.Table, n: int, width: int, light: int, percent: int) -> pa.Table:
    """Distinct shingles of a chunk's heavy nodes, with counts up to 255."""
    if not table.num_rows:
        return X.rows([])
    state = State(answers, n)
    s = Sets(*_texts(X.ordered(table), _heavy(state, light, percent)), width)
    keys, many = X.distinct(s.flat)
    return X.rows(_sent(keys, [np.minimum(many, 255).astype("u1")], 48, n, state.chunk, POSTINGS))


@X.lean
def _frequencies(table: pa.Table) -> pa.Table:
    """For each chunk's shingles, 0 if one node has it, else the number of bits of the count."""
    dest = table["dest"][0].as_py()
    got = X.by_kind(table, POSTINGS)
    parts = [X.load(p, ["u8", "u1"]) for *_, p in got]
    back = [np.zeros(len(k), "u1") for k, _ in parts]
    for cut in X.subranges([k for k, _ in parts]):
        keys, many = (np.concatenate([p[c][a:b] for p, (a, b) in zip(parts, cut)]) for c in (0, 1))
        if not len(keys):
            continue
        order = np.argsort(keys)
        k = keys[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        total = np.add.reduceat(many[order].astype(np.int64), new)
        level = np.where(total > 1, np.ceil(np.log2(np.maximum(total, 2))).astype("u1"), 0).astype("u1")
        own = np.empty(len(keys), "u1")
        own[order] = np.repeat(level, np.diff(np.append(new, len(k))))
        for to, (a, b), piece in zip(back, cut, np.split(own, np.cumsum([b - a for a, b in cut])[:-1])):
            to[a:b] = piece
    return X.rows([(c, dest, POSTINGS, x.tobytes()) for (_, c, _), x in zip(got, back)])


@X.lean
def _post(table: pa.Table, answers: pa.Table, n: int, width: int, light: int, percent: int) -> pa.Table:
    """Prefix postings and subset keys of a chunk's nodes; answers hold its state and the frequencies."""
    if not table.num_rows:
        return X.rows([])
    state = State(answers, n)
    table, chunk = X.ordered(table), state.chunk
    out = [(d, c, k, p) for k in (DOCS, REPS) for d, c, p in X.by_kind(answers, k, raw=True)]
    which = _heavy(state, light, percent)
    s = Sets(*_texts(table, which), width)
    by = np.argsort(s.flat)
    new = np.append(True, s.flat[by][1:] != s.flat[by][:-1]) if len(by) else np.zeros(0, bool)
    level, at = np.zeros(int(new.sum()), "u1"), X.cuts(s.flat[by][new], n, 48)
    for d, blob in X.replies(answers, POSTINGS).items():
        level[at[d] : at[d + 1]] = np.frombuffer(blob, "u1")
    own = np.empty(len(by), "u1")
    own[by] = level[np.cumsum(new) - 1]
    order = np.flatnonzero(own)  # those that one node has come first and enter no list
    order = order[np.lexsort([s.flat[order], own[order], s.doc[order]])]
    listed = np.bincount(s.doc[order], minlength=len(which))
    place = np.arange(len(order)) + (s.sizes - np.cumsum(listed))[s.doc[order]]
    again = np.zeros(len(order), bool)  # different shingles of one hash are in one list
    again[1:] = (s.flat[order][1:] == s.flat[order][:-1]) & (s.doc[order][1:] == s.doc[order][:-1])
    chosen = order[(place < prefix_size(s.sizes, percent)[s.doc[order]]) & ~again]
    keys, owners = [s.flat[chosen]], [which[s.doc[chosen]]]
    small = state.nodes[state.sizes[state.nodes] <= light]
    s = Sets(*_texts(table, small), width)
    for size in np.unique(s.sizes):  # the subsets that links of small sets need are lists like others
        rows = np.flatnonzero(s.sizes == size)
        values = mix64(s.flat[s.bounds[rows][:, None] + np.arange(size)])
        for m in partners(int(size), percent):
            o = needed(int(size), m, percent)
            if m > light or o > min(size, m):
                continue
            tag = np.uint64(min(size, m) * 1000 + max(size, m))
            for pick in combinations(range(size), o):
                keys.append(mix64(values[:, pick].sum(1, dtype=np.uint64) * np.uint64(1000003) + tag) >> np.uint64(16))
                owners.append(small[rows])
    h, idx = np.concatenate(keys), np.concatenate(owners)
    by = np.lexsort([mix64(node(chunk, idx)), h])  # hubs are least in this order
    h, idx = h[by], idx[by]
    new = np.append(True, (h[1:] != h[:-1]) | (idx[1:] != idx[:-1])) if len(h) else np.zeros(0, bool)
    h, idx = h[new], idx[new]
    out.append((chunk, chunk, POSTINGS, X.dump(h, idx.astype("u4"))))
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    many = np.minimum(np.diff(np.append(head, len(h))), 2).astype("u1")
    out += _sent(h[head], [node(chunk, idx[head]), many], 48, n, chunk, HUBS)
    return X.rows(out)


def _probes(columns: list[np.ndarray], probe: np.ndarray, to: np.ndarray, dest: int, kind: int) -> list:
    """Tests (columns) to the chunks of members, and requests to ship the probes' texts there."""
    out = []
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(ends, np.append(ends[1:], len(to))):
        part = order[a:b]
        out.append((int(to[part[0]]), dest, kind, X.dump(*[c[part] for c in columns])))
    order = np.lexsort([to, probe])
    probe, to = probe[order], to[order]
    if len(to):
        new = np.append(True, (probe[1:] != probe[:-1]) | (to[1:] != to[:-1]))
        probe, to = probe[new], to[new]
    home, ends = _chunk_of(probe), np.flatnonzero(np.append(True, _chunk_of(probe)[1:] != _chunk_of(probe)[:-1])) if len(to) else np.zeros(0, np.int64)
    for a, b in zip(ends, np.append(ends[1:], len(to))):
        out.append((int(home[a]), dest, SHIPS, X.dump((probe[a:b] & LOW32).astype("u4"), to[a:b].astype("u4"))))
    return out


@X.lean
def _hubs(table: pa.Table) -> pa.Table:
    """The hub of each list, to every chunk with members, and whether there are members beside two."""
    dest, out = table["dest"][0].as_py(), []
    got = X.by_kind(table, HUBS)
    if got:
        (h, nodes, many), bounds = X.load_all([p for *_, p in got], ["u8", "u8", "u1"])
        order = np.lexsort([mix64(nodes), h])
        head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        size = np.diff(np.append(head, len(order)))
        hub = np.repeat(nodes[order][head], size)
        total = np.repeat(np.add.reduceat(many[order].astype(np.int64), head), size)
        keep = total > 1
        to = np.searchsorted(bounds, order, "right") - 1
        chunks = np.array([c for _, c, _ in got])
        out += _probes([h[order][keep], hub[keep], (total[keep] > 2).astype("u1")], hub[keep], chunks[to][keep], dest, TESTS)
    return X.rows(out)


@X.lean
def _rest(table: pa.Table, percent: int = 75) -> pa.Table:
    """Pairs of members of one hub that may link, one of them not linked with the hub, to the chunk of the other."""
    dest = table["dest"][0].as_py()
    hub, member, n, flags, bits, outs = _read_sketches([p for *_, p in X.by_kind(table, UNLINKED)])
    order = np.argsort(hub, kind="stable")
    head = np.flatnonzero(np.append(True, hub[order][1:] != hub[order][:-1])) if len(hub) else np.zeros(0, np.int64)
    found = [np.zeros((0, 2), np.uint64)]
    for a, b in zip(head, np.append(head[1:], len(hub))):
        rows = order[a:b]
        if b - a > 1 and not (flags[rows] & 1).all():
            found += [np.stack([member[rows[u]], member[rows[m]]], 1) for u, m in _close(n[rows], flags[rows], _sliced(bits, rows), _sliced(outs, rows), percent)]
    pair = np.concatenate(found)
    return X.rows(_probes([pair[:, 0], (pair[:, 1] & LOW32).astype("u4")], pair[:, 0], _chunk_of(pair[:, 1]), dest, PAIRS))


def _close(n: np.ndarray, flags: np.ndarray, bits: tuple, outs: tuple, percent: int):
    """Pairs (u, m) of one hub's members that 100 * |A & B| >= percent * |A | B| may hold for, u not linked with the hub.

    Of each member are known the hub's shingles that it has (bits) and 16 bits of the hash of each other one (outs). Those
    that many members have become further bits, all others share some bits. Common bits are counted for all pairs, and the fewer of the
    elements that have no bit of their own are added; where that is enough, those with shared bits are compared. No count is less than that of the common shingles.
    """
    size, owner = len(n), np.repeat(np.arange(len(n)), np.diff(outs[1]))
    wide = -(-int(np.diff(bits[1])[0]) // 8)
    full = np.zeros((size, 8 * wide), np.uint8)
    full[:, : int(np.diff(bits[1])[0])] = bits[0].reshape(size, -1)
    code = np.sort(owner.astype(np.uint64) << np.uint64(16) | outs[0])
    new = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    again = np.arange(len(code)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(code) else np.zeros(0, np.int64)  # equal ones of a member stay apart
    value, owner = (code & np.uint64(0xFFFF)).astype(np.int64), (code >> np.uint64(16)).astype(np.int64)
    rare = np.ones(len(code), bool)
    if size > 16:
        held = np.bincount(value[new], minlength=1 << 16)
        often = np.flatnonzero(held >= max(size // 32, 4))
        often = often[np.argsort(-held[often], kind="stable")[:1024]]
        column = np.full(1 << 16, -1)
        column[often] = np.arange(len(often))
        rare = ~new | (column[value] < 0)
        full = np.concatenate([full, _columns(owner[~rare], column[value[~rare]], size, len(often))], 1)
    words = np.ascontiguousarray(full).view(np.uint64)
    alike, kept = min(1024 * max(1, int(rare.sum()) // (64 * size)), 8192), value[rare]
    shared = _columns(owner[rare], kept % alike, size, alike).view(np.uint64) if size > 16 else np.zeros((size, 0), np.uint64)
    owner, rest = owner[rare], (again[rare] << 16 | value[rare]).astype(np.uint64)
    at = np.searchsorted(owner, np.arange(size + 1))
    left = np.diff(at)
    crowd = left - np.bitwise_count(shared).sum(1, dtype=np.int64)  # elements beyond one a shared bit
    free, apart = flags & 2 > 0, flags & 1 == 0
    rest = np.sort(owner.astype(np.uint64) << np.uint64(48) | rest) & LOW48 if size < 1 << 16 else rest[np.lexsort([rest, owner])]
    probes, step = np.flatnonzero(apart), max((1 << 17) // size, 1)
    for a in range(0, len(probes), step):
        u = probes[a : a + step]
        common = np.zeros((len(u), size), np.int32)
        for k in range(words.shape[1]):
            common += np.bitwise_count(words[u, k][:, None] & words[None, :, k])
        most = common + np.minimum(crowd[u][:, None], crowd[None, :])
        for k in range(shared.shape[1]):
            most += np.bitwise_count(shared[u, k][:, None] & shared[None, :, k])
        need = -(-percent * (n[u][:, None] + n[None, :]) // (100 + percent))
        ok = (most >= need) | free[u][:, None] | free[None, :]
        ok &= need <= np.minimum(n[u][:, None], n[None, :])
        ok &= ~apart[None, :] | (np.arange(size)[None, :] > u[:, None])
        i, m = np.nonzero(ok)
        sure = free[u[i]] | free[m] | (common[i, m] >= need[i, m]) | (left[u[i]] == 0) | (left[m] == 0)
        yield u[i[sure]], m[sure]
        i, m = i[~sure], m[~sure]
        total = np.cumsum(left[u[i]] + left[m])
        for part in _runs(total):
            tag = np.arange(len(part), dtype=np.uint64) << np.uint64(48)
            x, y = (np.repeat(tag, left[d]) | rest[_spread(at[:-1][d], left[d])] for d in (u[i[part]], m[part]))
            hit = y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y]
            many = common[i[part], m[part]] + np.bincount((hit >> np.uint64(48)).astype(np.int64), minlength=len(part))
            yes = part[many >= need[i[part], m[part]]]
            yield u[i[yes]], m[yes]


def _columns(owner: np.ndarray, column: np.ndarray, size: int, columns: int) -> np.ndarray:
    """Rows of bits, whole words of 64, from sorted owners and their columns; some rows at a time."""
    out, step = np.zeros((size, 8 * -(-columns // 64)), np.uint8), 4096
    for a in range(0, size, step):
        x, y = np.searchsorted(owner, [a, a + step])
        block = np.zeros((min(step, size - a), 8 * out.shape[1]), bool)
        block[owner[x:y] - a, column[x:y]] = True
        out[a : a + step] = np.packbits(block, axis=1)
    return out


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _runs(total: np.ndarray):
    """Places of pairs, some at a time, from the running sum of their elements."""
    a = 0
    while a < len(total):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + TESTED, "right")), a + 1)
        b = min(b, a + 60_000)
        yield np.arange(a, b)
        a = b


def _sliced(ragged: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of values with bounds."""
    values, bounds = ragged
    many = np.diff(bounds)[rows]
    return values[_spread(bounds[:-1][rows], many)], np.concatenate([[0], np.cumsum(many)])


@X.lean
def _ship(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Texts to the chunks that test against them."""
    out = [(d, c, k, p) for k in (TESTS, PAIRS, EDGES, POSTINGS) for d, c, p in X.by_kind(answers, k, raw=True)]
    got = X.by_kind(answers, SHIPS)
    if got and table.num_rows:
        chunk = got[0][0]
        (idx, to), _ = X.load_all([p for *_, p in got], ["u4", "u4"])
        pair = np.unique(to.astype(np.uint64) << np.uint64(32) | idx)
        to, idx = (pair >> np.uint64(32)).astype(np.int64), (pair & LOW32).astype(np.int64)
        data, off = _texts(X.ordered(table))
        ends = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for a, b in zip(ends, np.append(ends[1:], len(to))):
            which = idx[a:b]
            out.append((int(to[a]), chunk, SETS, X.dump(node(chunk, which), np.diff(off)[which].astype("u4")) + b"".join(data[off[k] : off[k + 1]].data for k in which)))
    return X.rows(out)


def _shipped(packets: list):
    """Nodes, bytes and offsets of shipped texts, some at a time."""
    held: list[tuple] = []

    def all_held():
        nodes, size, data = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return nodes, data, np.concatenate([[0], np.cumsum(size.astype(np.int64))])

    total = 0
    for *_, packet in packets:
        blob = X.unpacked(packet)
        own, size = X.load(blob, ["u8", "u4"])
        off = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        data = np.frombuffer(blob, np.uint8, int(off[-1]), 8 + 12 * len(own))
        for i, j in blocks(off, SHIPPED):
            held.append((own[i:j], size[i:j], data[off[i] : off[j]]))
            total += int(off[j] - off[i])
            if total >= SHIPPED:
                yield all_held()
                total = 0
    if held:
        yield all_held()


@X.lean
def _test(table: pa.Table, answers: pa.Table, r: int, width: int, percent: int) -> pa.Table:
    """Verified edges, and sketches of members of lists for the key ranges of their hubs."""
    out = [(d, c, EDGES, p) for d, c, p in X.by_kind(answers, EDGES, raw=True)]
    sets = X.by_kind(answers, SETS, raw=True)
    if not (sets and table.num_rows):
        return X.rows(out)
    chunk = sets[0][0]
    probes, code = _pairs(answers, chunk)
    which = np.unique((code >> np.uint64(1) & LOW32).astype(np.int64))
    s = Sets(*_texts(X.ordered(table), which), width, words=True)
    edges, sketches = [], []
    for own, data, off in _shipped(sets):  # texts are unpacked, and their sets made, some at a time
        theirs = Sets(data, off, width, words=True)
        lo, hi = np.searchsorted(probes, own[0]), np.searchsorted(probes, own[-1], "right")
        some = code[np.searchsorted(code, np.uint64(lo) << np.uint64(33)) : np.searchsorted(code, np.uint64(hi) << np.uint64(33))]
        of = np.searchsorted(own, probes[(some >> np.uint64(33)).astype(np.int64)])
        member = (some >> np.uint64(1) & LOW32).astype(np.int64)
        local, wanted = np.searchsorted(which, member), some & np.uint64(1) == 0
        total = np.cumsum(s.sizes[local] + theirs.sizes[of])
        for part in _runs(total):
            linked = _linked(s, local[part], theirs, of[part], percent, wanted[part], own, node(chunk, member[part]), sketches)
            edges.append(np.stack(forest(own[of[part[linked]]], node(chunk, member[part[linked]]))) if linked.any() else np.zeros((2, 0), np.uint64))
    x, y = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.uint64)
    out.append((chunk, chunk, EDGES, X.dump(*forest(x, y))))
    return X.rows(out + _sent_sketches(sketches, r, chunk))


def _pairs(answers: pa.Table, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Shipped nodes, and pairs to test: number of the node, member (32 bits), 0 where a sketch of the member is wanted; sorted, each pair once."""
    code = [np.zeros(0, np.uint64)]
    if tests := X.by_kind(answers, PAIRS):
        (node_, idx), _ = X.load_all([p for *_, p in tests], ["u8", "u4"])
        probes, back = np.unique(node_, return_inverse=True)
        code.append(back.astype(np.uint64) << np.uint64(33) | idx.astype(np.uint64) << np.uint64(1) | np.uint64(1))
    else:
        (h, idx), _ = X.load_all([p for *_, p in X.by_kind(answers, POSTINGS)], ["u8", "u4"])
        (k, probe, more), _ = X.load_all([p for *_, p in X.by_kind(answers, TESTS)], ["u8", "u8", "u1"])
        probes, back = np.unique(probe, return_inverse=True)
        a = np.searchsorted(h, k, "left")
        many = np.searchsorted(h, k, "right") - a
        for part in _runs(np.cumsum(many)):  # a list's members in slices of bounded size
            n = many[part]
            flat = idx[_spread(a[part], n)].astype(np.uint64)
            code.append(np.unique(np.repeat(back[part].astype(np.uint64) << np.uint64(33) | np.uint64(1) - more[part], n) | flat << np.uint64(1)))
    pairs = np.unique(np.concatenate(code))
    pairs = pairs[np.append(True, pairs[1:] >> np.uint64(1) != pairs[:-1] >> np.uint64(1))] if len(pairs) else pairs
    return probes, pairs[probes[(pairs >> np.uint64(33)).astype(np.int64)] != node(chunk, pairs >> np.uint64(1) & LOW32)]


def _linked(s: Sets, local: np.ndarray, theirs: Sets, of: np.ndarray, percent: int, wanted: np.ndarray, own: np.ndarray, members: np.ndarray, sketches: list) -> np.ndarray:
    """Whether pairs of texts link; sketches of the wanted ones are added to a list."""
    m, size = s.sizes[local], theirs.sizes[of]
    fits = (100 * m >= percent * size) & (100 * size >= percent * m)
    tag = np.arange(len(local), dtype=np.uint64) << np.uint64(48)
    (mine, x), (their, y) = (_gathered(t, d, tag) for t, d in ((s, local), (theirs, of)))
    at = np.minimum(np.searchsorted(mine, their), max(len(mine) - 1, 0))
    has = mine[at] == their
    pair = (their >> np.uint64(48)).astype(np.int64)
    common = np.bincount(pair[has], minlength=len(local))
    enough = lambda n: fits & (100 * n >= percent * (m + size - n))
    odd = s.odd[local] | theirs.odd[of]
    hit = np.flatnonzero(has & (enough(common) & ~odd)[pair])  # words can only make them fewer
    a, b = x[at[hit]], y[hit]
    hit = hit[_same_words(s, s.first[a], s.many[a], theirs, theirs.first[b], theirs.many[b])]
    common = np.bincount(pair[hit], minlength=len(local))
    for p in np.flatnonzero(odd & fits):
        common[p] = len(s.exact(local[p]) & theirs.exact(of[p]))
    linked = enough(common)
    if wanted.any():
        outside = np.ones(len(mine), bool)
        outside[at[has]] = False
        keep = np.flatnonzero(wanted)
        room = -(-size // 8)
        first = 8 * (np.cumsum(room * wanted) - room * wanted)  # bits of unwanted pairs have no room
        bits, of_wanted = np.zeros(8 * int(room[keep].sum()), bool), wanted[pair]
        bits[(first[pair] + np.arange(len(their)) - (np.cumsum(size) - size)[pair])[of_wanted]] = has[of_wanted]
        away = (mine >> np.uint64(48)).astype(np.int64)
        outside &= wanted[away]
        count = np.bincount(away[outside], minlength=len(local))
        sketches.append((own[of[keep]], members[keep], m[keep].astype("u4"), linked[keep].astype("u1") | odd[keep].astype("u1") << 1, room[keep].astype("u4"), count[keep].astype("u4"), np.packbits(bits), mine[outside].astype("u2")))
    return linked


def _sent_sketches(parts: list, r: int, chunk: int) -> list:
    """Rows of sketches to the key ranges of their hubs."""
    if not parts:
        return []
    hub, member, n, flags, room, count, bits, outs = (np.concatenate(x) for x in zip(*parts))
    key = mix64(hub) >> np.uint64(16)
    order = np.argsort(key, kind="stable")
    at = X.cuts(key[order], r, 48)
    bits, outs = (bits, np.concatenate([[0], np.cumsum(room, dtype=np.int64)])), (outs, np.concatenate([[0], np.cumsum(count, dtype=np.int64)]))
    out = []
    for d in range(r):
        rows = order[at[d] : at[d + 1]]
        if len(rows):
            columns = [c[rows] for c in (hub, member, n, flags, room, count)]
            out.append((d, chunk, UNLINKED, X.dump(*columns) + _sliced(bits, rows)[0].tobytes() + _sliced(outs, rows)[0].tobytes()))
    return out


def _read_sketches(blobs: list) -> tuple:
    """Hubs, members, sizes, flags (1: linked, 2: nothing known), bits and further hashes, with their bounds."""
    parts, bits, outs = [], [np.zeros(0, np.uint8)], [np.zeros(0, "u2")]
    for blob in blobs:
        parts.append(X.load(blob, SKETCH))
        at, room, count = 8 + 29 * len(parts[-1][0]), int(parts[-1][4].sum(dtype=np.int64)), int(parts[-1][5].sum(dtype=np.int64))
        bits.append(np.frombuffer(blob, np.uint8, room, at))
        outs.append(np.frombuffer(blob, "u2", count, at + room))
    hub, member, n, flags, room, count = (np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in enumerate(SKETCH))
    ends = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return hub, member, n.astype(np.int64), flags, (np.concatenate(bits), ends(room)), (np.concatenate(outs), ends(count))


def _gathered(s: Sets, docs: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts one after the other, each with its text's tag, and their places in s."""
    n = s.sizes[docs]
    at = _spread(s.bounds[:-1][docs], n)
    return s.flat[at] | np.repeat(tag, n), at


@X.lean
def _edges(batches):
    for batch in batches:
        (a, b), _ = X.load_all([X.unpacked(p.as_buffer()) for p in batch.column("payload")], ["u8", "u8"])
        yield pa.RecordBatch.from_pydict({"a": a.astype("i8"), "b": b.astype("i8")})


@X.lean
def _members(table: pa.Table, n: int) -> pa.Table:
    s = State(table, n)
    null = lambda x: pa.array(x, pa.int64(), mask=x == X.LAST)
    return pa.table({"doc_id": null(s.ids), "n_shingles": pa.array(s.sizes, pa.int64()), "node": pa.array(s.rep.astype("i8")), "rep_id": null(s.rep_id)})


@X.lean
def _own_nodes(table: pa.Table, n: int) -> pa.Table:
    """Nodes (one of each set) with their ids; a null id is the largest."""
    s = State(table, n)
    own = s.rep == node(s.chunk, np.arange(len(s.ids)))
    return pa.table({"node": pa.array(s.rep[own].astype("i8")), "rep_id": pa.array(s.ids[own], pa.int64())})


@X.lean
def _taken(table: pa.Table, kept: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows of a chunk at the places of the kept nodes, without those equal to the row before in id and text."""
    if not (table.num_rows and kept.num_rows):
        return schema.empty_table()
    table = X.ordered(table)
    last, again = (None, None), np.zeros(table.num_rows, bool)
    for k, row in enumerate(zip(table["doc_id"].to_pylist(), table["text"])):
        again[k], last = k > 0 and row[0] == last[0] and row[1].equals(last[1]), row
    at = np.sort(kept["node"].to_numpy().astype("u8") & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return table.take(pa.array(at[~again[at]])).select(schema.names).cast(schema)


def _graph(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, n: int | None) -> tuple[int, int, DataFrame, DataFrame]:
    """Numbers of chunks and key ranges, documents and representatives by chunk, node and root of all nodes that are tested."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    n, r = X.partitions(docs, n, text_col)
    light = boundary(_sizes(docs, width, text_col), percent)
    parts = X.checkpointed(X.chunk_rows(docs, n, id_col, text_col)).repartition(n, "chunk")  # packed once, dealt anew in each of four jobs
    text = parts.groupBy("chunk")
    # Exchanges that end in a checkpoint or are used twice come after the work, which is then done once.
    state = text.applyInArrow(lambda t: _digests(t, r, width), X.ROWS).groupBy("dest").applyInArrow(lambda t: _representatives(t), X.ROWS).repartition(n, "dest")
    shingles = text.cogroup(state.groupBy("dest")).applyInArrow(lambda a, b: _shingles(a, b, r, width, light, percent), X.ROWS)
    levels = shingles.groupBy("dest").applyInArrow(lambda t: _frequencies(t), X.ROWS)
    levels = X.checkpointed(levels.union(state))  # small; the shingles' shuffle can go
    X.release(docs)
    posts = text.cogroup(levels.groupBy("dest")).applyInArrow(lambda a, b: _post(a, b, r, width, light, percent), X.ROWS)
    posts = X.checkpointed(posts.repartition(n, "dest"))
    X.release(docs)
    own, lists = posts.where(f"kind = {POSTINGS}"), posts.where(f"kind = {HUBS}")

    def tested(probes: DataFrame, *more: DataFrame) -> DataFrame:
        sets = text.cogroup(probes.groupBy("dest")).applyInArrow(lambda a, b: _ship(a, b), X.ROWS)
        for x in more:
            sets = sets.union(x)
        return text.cogroup(sets.groupBy("dest")).applyInArrow(lambda a, b: _test(a, b, r, width, percent), X.ROWS)

    # Checkpointed, as filters on its rows would else go below an exchange and have it made twice.
    first = X.checkpointed(tested(lists.repartition(r, "dest").groupBy("dest").applyInArrow(lambda t: _hubs(t), X.ROWS), own))
    X.release(docs)
    left = first.where(f"kind = {UNLINKED}").repartition(r, "dest")
    second = tested(left.groupBy("dest").applyInArrow(lambda t: _rest(t, percent), X.ROWS))
    few = max(n // 4, 16)  # edges are small
    second = second.where(f"kind = {EDGES}").repartition(few, "dest")  # so that no task runs two Python workers
    edges = first.where(f"kind = {EDGES}").coalesce(few).union(second).mapInArrow(_edges, "a long, b long")
    return n, r, posts.where(f"kind in ({DOCS}, {REPS})").groupBy("dest"), components(edges)


def similar_components(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", n: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the component)."""
    n, r, states, roots = _graph(docs, percent, width, id_col, text_col, n)
    members = states.applyInArrow(lambda t: _members(t, r), "doc_id long, n_shingles long, node long, rep_id long")
    nodes = members.groupBy("node").agg(F.min("rep_id").alias("rep_id"))
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("rep_id").alias("least"))
    labels = roots.join(least, "root").select("node", "least")
    return members.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "rep_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, n: int | None = None) -> DataFrame:
    """doc_id, text, carried columns of one row of each component, that of the least id and of those a fixed one (by hashes of their texts).

    Rows are told apart by their places in their chunk, not by id: rows of one id can be of several components, or one
    component. Rows without words are components of their own, but those equal in id and text are one row.
    """
    n, r, states, roots = _graph(docs, percent, width, id_col, text_col, n)
    kind = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry or []]).schema
    schema = to_arrow_schema(kind)
    nodes = states.applyInArrow(lambda t: _own_nodes(t, r), "node long, rep_id long")
    least = roots.join(nodes, "node").groupBy("root").agg(F.min(F.struct("rep_id", "node")).alias("least"))
    kept = nodes.join(roots, "node", "left_anti").select("node").union(least.select("least.node"))
    kept = kept.withColumn("chunk", F.shiftright("node", 32).cast("int"))
    parts = X.chunked(docs, n, id_col, text_col, carry)
    return parts.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(lambda a, b: _taken(a, b, schema), kind)
