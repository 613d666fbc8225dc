"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is some whole documents of one task, as numbers of their own words. Its suffix array is made by prefix doubling, once,
whatever the size of the benchmark. Every suffix of every test item is binary-searched in it, word by word: the interval of shard suffixes
that share its first words narrows until ``window`` words (all words of a shorter item) agree; the interval then lists
all places. Places at which the word before differs begin a longest verbatim match, which is followed to its end. Test suffixes
that begin with the same window share one search; those with a word that the shard lacks need none. Documents are never shuffled.

Tasks cut the benchmark into blocks of ``index_bytes`` of characters, make an index of each and write it to a table in the shared
folder of checkpoints, a file each; the driver sees the files' names only. A worker reads one index at a time (some ten times its block) and
searches it in all shards of ``GROUP_BYTES`` of text before it reads the next; a benchmark of one block stays loaded. Words are runs of a-z, 0-9
and non-ASCII bytes after lower-casing A-Z; they are compared by their bytes.

Null texts have no words; items without words are never found; a null item id counts as the empty string; repeated rows
are judged one by one; empty tables give empty results (documents) or no hits (benchmark); very long texts are shards of their
own; carried columns whose name a result column has are dropped.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import lean, shared_folder, widened
from vectide.llm.textnp import ALNUM, Words, blocks, covered, packed, same_bytes, word_numbers

END, UNKNOWN, FIRST = 0, 1, 2
PAIRS, SHARD_BYTES, GROUP_BYTES = 1 << 20, 2_000_000, 32_000_000


def suffix_array(number: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first words, depth of them at least; a number below FIRST differs from all others."""
    n = len(number)
    first = np.where(number < FIRST, np.arange(n), number.astype(np.int64) + n)
    sa = np.argsort(first)
    new = np.append(True, first[sa][1:] != first[sa][:-1])[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots, have = np.flatnonzero(~(new & np.append(new[1:], True)[:n])), 1
    while len(slots) and have < depth:  # only suffixes that still share a rank are sorted again
        live = sa[slots]
        key = rank[live] * (n + 2) + rank[np.minimum(live + have, n)] + 1
        order = np.argsort(key)
        key, live = key[order], live[order]
        new = np.append(True, key[1:] != key[:-1])
        sa[slots] = live
        rank[live] = slots[new][np.cumsum(new) - 1]
        slots = slots[~(new & np.append(new[1:], True))]
        have *= 2
    return sa


class Vocabulary:
    """Distinct words, numbered from FIRST in the order of their hashes; words of a hash that another one has come last."""

    def __init__(self, w: Words):
        number, first, extra = word_numbers(w)
        self.number, self.extra = number, {k: v + FIRST for k, v in extra.items()}
        place = np.zeros(len(first) + len(extra), np.int64)
        place[number[::-1]] = np.arange(len(w))[::-1]
        self.hashes, self.size = w.hash[place], w.end[place] - w.start[place]
        self.at = np.cumsum(self.size) - self.size
        self.letters = w.data[np.repeat(w.start[place] - self.at, self.size) + np.arange(int(self.size.sum()))]

    def numbers(self, places: np.ndarray, size: int) -> np.ndarray:
        """Words at their places among so many, END elsewhere; may be called once."""
        out = np.zeros(size, np.int32)
        out[places] = self.number + FIRST
        del self.number
        return out

    def numbers_of(self, other: Vocabulary) -> np.ndarray:
        """By number of another vocabulary, the number here of its word; UNKNOWN for those that are not here."""
        out = np.full(len(other.hashes) + FIRST, UNKNOWN, np.int32)
        out[END] = END
        base = len(self.hashes) - len(self.extra)
        if not base:
            return out
        at = np.minimum(np.searchsorted(self.hashes[:base], other.hashes), base - 1)
        live = np.flatnonzero(self.hashes[at] == other.hashes)
        k = at[live]
        size = other.size[live]
        same = size == self.size[k]
        same[same] = same_bytes(other.letters, other.at[live[same]], self.letters, self.at[k[same]], size[same])
        out[live[same] + FIRST] = k[same] + FIRST
        for x in live[~same]:
            out[x + FIRST] = self.extra.get(other.letters[other.at[x] : other.at[x] + other.size[x]].tobytes(), UNKNOWN)
        return out


class Index:
    """Words of some test items as numbers, and their suffixes, those that share their first words together."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = Words(*packed(pa.array(texts, pa.string())), ALNUM, lower=True)
        self.ids, self.window, self.words = ids, window, Vocabulary(w)
        need = np.minimum(w.counts, window)[w.doc]
        # An END after each item; places of words move by the number of items before them.
        place = np.arange(len(w)) + w.doc
        self.number = self.words.numbers(place, len(w) + len(w.counts) + 1)
        starts = np.flatnonzero(w.left() >= need)
        item, word, at, need = (x[starts].astype(np.int32) for x in (w.doc, w.at(), place, need))
        order = np.lexsort([word, item])
        for k in range(window - 1, -1, -1):
            order = order[np.argsort(np.where(k < need, self.number[np.minimum(at + k, len(self.number) - 1)], END)[order], kind="stable")]
        self.item, self.word, self.place, self.need = item[order], word[order], at[order], need[order]
        new = np.ones(len(order), bool)
        if len(order):
            same = self.need[1:] == self.need[:-1]
            for k in range(window):
                same &= (k >= self.need[1:]) | (self.number[np.minimum(self.place[1:] + k, len(self.number) - 1)] == self.number[np.minimum(self.place[:-1] + k, len(self.number) - 1)])
            new[1:] = ~same
        self.head = np.flatnonzero(new)
        self.many = np.diff(np.append(self.head, len(order)))


class Shard:
    """Documents of a shard as numbers of their words, an END before and after each, and their suffix array, sorted by ``window`` words at least."""

    def __init__(self, w: Words, window: int):
        self.counts, self.bounds = w.counts, w.bounds
        self.words = Vocabulary(w)
        self.number = self.words.numbers(np.arange(len(w)) + w.doc + 1, len(w) + len(w.counts) + 1)
        self.sa = suffix_array(self.number, window).astype(np.int32)
        many = np.bincount(self.number, minlength=FIRST)
        self.first = np.cumsum(many) - many  # of the suffixes that begin with a word

    def search(self, index: Index, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct beginning of test suffixes, the interval of the suffix array that shares all its needed words."""
        at, need = index.place[index.head], index.need[index.head]
        lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        unknown = np.concatenate([[0], np.cumsum(number == UNKNOWN)])
        live = np.flatnonzero(unknown[at + need] == unknown[at])
        word = number[at[live]]
        lo[live], hi[live] = self.first[word], np.append(self.first, len(self.sa))[word + 1]
        for k in range(1, index.window):
            live = live[(need[live] > k) & (hi[live] > lo[live])]
            if not len(live):
                break
            target = number[at[live] + k]
            a, b = lo[live], hi[live]
            lo[live] = self._bound(a, b, k, target, False)
            hi[live] = self._bound(lo[live], b, k, target, True)
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, k: int, target: np.ndarray, past: bool) -> np.ndarray:
        """First of [lo, hi), or hi, whose k-th word is not below target (past: is above it)."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            word = self.number[np.minimum(self.sa[mid] + k, len(self.number) - 1)]
            right = word <= target[live] if past else word < target[live]
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo


def _expanded(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _slices(many: np.ndarray):
    """Ranges of rows of about PAIRS entries together; one row of more is one range."""
    total, a = np.concatenate([[0], np.cumsum(many)]), 0
    while a < len(many):
        b = max(int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1, a + 1)
        yield a, b
        a = b


def found(index: Index, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a shard that are hit; (document, item) pairs; all longest matches as rows of document, item, item place, place, words."""
    none = np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64)
    words = int(shard.bounds[-1])
    if not (words and len(index.head)):
        return np.zeros(words, bool), *none
    number = shard.words.numbers_of(index.words)[index.number]
    lo, hi = shard.search(index, number)
    group = np.flatnonzero(hi > lo)
    if not len(group):
        return np.zeros(words, bool), *none
    many = (hi - lo)[group]
    spot = shard.sa[_expanded(lo[group], many)]  # in the numbers; words are shift places before
    text = np.searchsorted(np.arange(len(shard.counts)) + shard.bounds[:-1], spot, "right") - 1
    hit = covered(spot - text - 1, np.repeat(index.need[index.head[group]], many), words)
    pairs, matches = [none[0]], [none[1]]
    row = np.repeat(group, many)
    tests = index.many[row]
    for a, b in _slices(tests):
        size = tests[a:b]
        test = _expanded(index.head[row[a:b]], size)
        at, doc = np.repeat(spot[a:b], size), np.repeat(text[a:b], size)
        pairs.append(np.unique(np.stack([doc, index.item[test]], 1), axis=0))
        # A match begins where the words before differ, or at an end; an item of fewer words than a window has one suffix only.
        before = np.where(index.word[test] > 0, number[index.place[test] - 1], END)
        begins = (before != shard.number[at - 1]) | (before < FIRST) | (index.need[test] < index.window)
        test, at, doc = test[begins], at[begins], doc[begins]
        length = index.need[test].copy()
        live = np.arange(len(test))
        while len(live):
            mine, theirs = number[index.place[test[live]] + length[live]], shard.number[np.minimum(at[live] + length[live], len(shard.number) - 1)]
            live = live[(mine == theirs) & (mine >= FIRST)]
            length[live] += 1
        matches.append(np.stack([doc, index.item[test], index.word[test], at - doc - 1 - shard.bounds[:-1][doc], length], 1))
    return hit, np.unique(np.concatenate(pairs), axis=0), np.concatenate(matches)


MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])
MATCH_FIELDS = [f.name for f in MATCH]


_LOADED: dict[str, Index] = {}  # the index that a worker read last


def _loaded(file: str) -> Index:
    if file not in _LOADED:
        _LOADED.clear()
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            _LOADED[file] = pickle.loads(pq.read_table(source)["index"][0].as_buffer())
    return _LOADED[file]


def _indexes(benchmark: DataFrame, window: int, id_col: str, text_col: str, index_bytes: int) -> list[str]:
    """Files of the benchmark's indexes, a block each."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))

    @lean
    def run(batches):
        def written():
            return pa.RecordBatch.from_pydict({"index": pa.array([pickle.dumps(Index(ids, texts, window), 5)], pa.binary())})

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("i"), batch.column("t")):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1]) + 16
                if size >= index_bytes:
                    yield written()
                    ids, texts, size = [], [], 0
        if ids:
            yield written()

    size = rows.agg(F.sum(F.length("t").cast("long") + 16)).first()[0] or 0
    tasks = -(-size // (4 * index_bytes)) or 1  # some blocks a task, so that few of them are small
    folder = f"{shared_folder(benchmark)}/indexes-{uuid.uuid4().hex}"
    rows.repartition(tasks, F.xxhash64("i", "t")).mapInArrow(run, "index binary").write.option("maxRecordsPerFile", 1).parquet(folder)
    return [r.file_path for r in benchmark.sparkSession.read.parquet(folder).select("_metadata.file_path").distinct().orderBy("file_path").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, index_bytes: int = 8_000_000, only_clean: bool = False) -> DataFrame:
    """doc_id, carried columns, n_words, n_hit, items (ids sorted as strings), matches, contaminated. only_clean: of documents without hits."""
    new = ["n_words", "n_hit", "items", "matches", "contaminated"]
    carry = [c for c in carry or [] if c not in {*new, "doc_id", id_col}]
    files = _indexes(benchmark, window, item_id_col, item_text_col, index_bytes)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def judged(shards: list[Shard]):
        """Hit words, items and matches of the documents of each shard."""
        results = [(np.zeros(int(s.bounds[-1]), bool), [set() for _ in s.counts], [[] for _ in s.counts]) for s in shards]
        for file in sorted(files, key=lambda f: f not in _LOADED):
            index = _loaded(file)
            for shard, (gone, items, places) in zip(shards, results):
                hit, pairs, matches = found(index, shard)
                gone |= hit
                for doc, item in pairs.tolist():
                    items[doc].add(index.ids[item])
                for doc, item, *place in matches.tolist():
                    places[doc].append((index.ids[item], *place))
            del index
        return results

    @lean
    def run(batches):
        for batch in batches:
            data, off = packed(batch.column("__text"))
            for first, last in blocks(off, GROUP_BYTES):
                spans = [(first + i, first + j) for i, j in blocks(off[first : last + 1], SHARD_BYTES)]
                shards = [Shard(Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM, lower=True), window) for i, j in spans]
                for (i, j), shard, (gone, items, places) in zip(spans, shards, judged(shards)):
                    hits = np.diff(np.concatenate([[0], np.cumsum(gone)])[shard.bounds])
                    own = batch.slice(i, j - i)
                    found_at = pa.array([[dict(zip(MATCH_FIELDS, m)) for m in sorted(x)] for x in places], pa.list_(MATCH))
                    cols = [*[own.column(k) for k in range(1 + len(carry))], pa.array(shard.counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), found_at, pa.array(hits > 0)]
                    out = pa.RecordBatch.from_arrays(cols, names=["doc_id", *carry, *new])
                    yield out.filter(pa.array(hits == 0)) if only_clean else out
                    del own, cols, out, found_at
                del shards

    return frame.mapInArrow(run, widened(frame.drop("__text").schema, "n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,item_start:bigint,doc_start:bigint,length:bigint>>, contaminated boolean"))
