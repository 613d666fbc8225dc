"""Packing of tokenized documents into sequences of a fixed size, by length patterns.

Documents become ids plus an end id; longer ones are cut from the end into full pieces, so that only the first piece
is short. The histogram of piece lengths (bounded by the sequence size) goes to the driver. Patterns of two and three
lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares,
rounded down, and what is left is packed by best fit over the histogram. Pieces of one length are interchangeable: each
gets a rank among them (counted by task, then summed over tasks, so a common length is no hot key), and the rank alone
says which sequence and place it gets. The sums before each task are broadcast where they are small, else joined.

``max_patterns`` bounds the driver's work for sequences of over 1024 (all 87,381 triples of that size are under it): beyond it
triples are taken of every second, third, ... length. Patterns only propose; best fit packs every piece they leave.

Null texts are empty (the end id alone); very long texts are many pieces; repeated rows are documents of their own; pieces of one
length are told apart by the order of their tasks only; empty tables give an empty result; other input columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.exchange import checkpointed, lean, widened
from vectide.llm.pretokens import encoder
from vectide.llm.textnp import blocks, packed

MAX_PATTERNS, BROADCAST_ROWS = 100_000, 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized_pieces(docs: DataFrame, size: int, path: str, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces, each with its task and its rank among the pieces of its length in that task."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    @lean
    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = encoder(path).encode, TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, off = packed(batch.column("text"))
            for i, j in blocks(off):
                flat, bounds = encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                flat = np.insert(flat, bounds[1:], end_id).astype("<u4")
                begin = bounds[:-1] + np.arange(j - i)
                n = np.diff(bounds) + 1
                pieces = -(-n // size)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = np.where(n % size, n % size, size)[row]
                start = np.where(piece == 0, 0, short + (piece - 1) * size)
                length = np.where(piece == 0, short, size)
                at = begin[row] + start
                order = np.argsort(length, kind="stable")
                vals, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(seen[vals], many)
                seen[vals] += many
                cols = [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(flat[a : a + m].tobytes()) for a, m in zip(at, length)], pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    cols.append(pa.array([flat[a : a + m] for a, m in zip(at, length)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return frame.mapInArrow(run, widened(frame.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids))


def patterns(hist: np.ndarray, size: int, limit: int = MAX_PATTERNS) -> np.ndarray:
    """Pairs and triples of lengths that occur and fill a sequence; 0 fills up pairs. Triples are thinned evenly to the limit."""
    live = np.flatnonzero(hist[:size])
    live = live[live > 0]
    a = live[(live <= size - live) & (hist[size - live] > 0)]
    pairs = np.stack([a, size - a, np.zeros_like(a)], 1)
    small = live[live <= size // 3]
    step = 1
    while True:
        x, y = np.meshgrid(small[:: step], live[:: step], indexing="ij")
        z = size - x - y
        ok = (x <= y) & (y <= z)
        ok[ok] &= hist[z[ok]] > 0
        if ok.sum() <= limit:
            return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], 1)])
        step += 1


def fit(hist: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative steps: x <- x * (A'h) / (A'Ax)."""
    if not len(pats):
        return np.zeros(0)
    h = hist.astype(float).copy()
    h[0] = 0
    x = np.where(pats[:, 2] == 0, 1.0, 0.01)  # of equally good fits, the one with few triples wastes least when rounded
    x *= h.sum() / max((x[:, None] * (pats > 0)).sum(), 1e-12)
    live = pats > 0
    top = (h[pats] * live).sum(1)
    for _ in range(rounds):
        made = np.bincount(pats.ravel(), (x[:, None] * live).ravel(), minlength=len(h))
        made[0] = 0
        x = x * top / np.maximum((made[pats] * live).sum(1), 1e-12)
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts of equal lengths and equal open sequences."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    room = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        left = int(hist[length])
        while left:
            gap = length + int(np.argmax(room[length:]))
            if room[gap]:
                pat, many = open_[gap].pop()
                used = min(many, left)
                if used < many:
                    open_[gap].append((pat, many - used))
                room[gap] = bool(open_[gap])
                open_[gap - length].append(((*pat, length), used))
                room[gap - length] = gap > length
                left -= used
            else:
                each = min(size // length, left)
                used = left // each
                open_[size - each * length].append(((length,) * each, used))
                room[size - each * length] = size > each * length
                left -= used * each
    return [x for group in open_ for x in group]


def plan(hist: np.ndarray, size: int, max_patterns: int = MAX_PATTERNS) -> list[tuple[tuple[int, ...], int]]:
    """Length patterns and how often each is used; together they hold exactly the histogram."""
    left = hist.astype(np.int64).copy()
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    pats = patterns(left, size, max_patterns)
    x = fit(left, pats)
    for k in np.argsort(-x, kind="stable"):
        many = int(x[k])
        if not many:
            break
        own = [int(v) for v in pats[k] if v]
        many = min([many, *(int(left[v]) // own.count(v) for v in own)])
        if many:
            out.append((tuple(own), many))
            for v in own:
                left[v] -= many
    return out + best_fit(left, size)


def places(packing: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks of each length: sorted keys length * 2**40 + first rank, and sequence and offset of that rank."""
    rank, rows, seq = np.zeros(size + 1, np.int64), [], 0
    for pat, many in packing:
        offset = 0
        for v in pat:
            rows.append((v * (1 << 40) + int(rank[v]), seq - int(rank[v]), offset))
            rank[v] += many
            offset += v
        seq += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = tokenized_pieces(docs, size, tokenizer or default_tokenizer(), end_id, id_col, text_col, with_ids)
    pieces = checkpointed(pieces)  # ids and ranks are made once, and what follows is the same in every run
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    hist, sums = np.zeros(size + 1, np.int64), 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect():  # size rows at most
        hist[r.length] = r.n
        sums += r.tasks
    keys, seqs, offs = places(plan(hist, size, max_patterns), size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if sums <= BROADCAST_ROWS else base  # one row a task and length: 16 bytes each
    whole = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = [c for c in pieces.columns if c not in ("task", "rank")]

    @lean
    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, batch.column("length").to_numpy() * (1 << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seqs[k] + rank), pa.array(offs[k])], names=[*names, "sequence_id", "offset"])

    return whole.mapInArrow(place, widened(pieces.select(names).schema, "sequence_id long, offset long"))
