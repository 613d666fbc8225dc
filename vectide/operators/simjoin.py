"""Similarity joins of a stated query set against all reference rows.

Every query meets every row of the reference in a grid: both sides are dealt into groups, a cell is a group of either, and one shuffle brings the
rows of a cell together, its queries first. A worker holds the queries of one cell (CELL bytes at most, but for the luck of the deal) while the
cell's reference passes by in Arrow's batches; costs are matrix products of at most PAIRS pairs, so what a worker holds depends on neither side's
size. No query passes through the driver's code, and the plan is the same for any number of queries. Top-k keeps the best k of a query in each
cell before the one exchange and the best k of all after it.

With prune, both sides are packed into rows of many vectors, blocks of queries and tiles of the reference. The reference is first dealt by its nearest
pivot (and class), so that a tile has a center and a small radius. By the triangle inequality
these bound the costs of a query to all rows of a tile from both sides. The tiles that hold k rows by their upper bounds bound a query's k-th
cost; tiles whose lower bounds are above it, or above the limit of a threshold join, are never read. The result is the same, as bounds are
widened by more than the rounding of costs; zero vectors have no direction, so their tiles and queries are not pruned. Blocks of BROADCAST bytes together at
most are the broadcast side of the joins with tiles. Rows of a block and a tile reach a worker in Arrow's batches, which Spark cuts by bytes (spark.sql.execution.arrow.maxBytesPerBatch).

Rows without an id or a vector are left out; equal rows and ids are rows of their own; empty sides give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.shared import checkpointed

BLOCK, TILE, PIVOTS, HEADS = 1024, 1024, 64, 1024  # queries of a block, rows of a tile, pivots, tiles whose bounds are one row
BROADCAST, CELL = 32_000_000, 16_000_000  # bytes of all blocks that may be broadcast; of the queries of a cell, a quarter of its reference's
PAIRS, CELLS = 1 << 17, 4  # pairs whose costs are held at once; cells for each task that can run
PACKED = "no long, n int, data binary, head binary"
PAIR = "qid long, rid long, cost double"
SLACK = 1e-7


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def costs(ref: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Cost matrix (reference, query); smaller is nearer."""
    if metric == "l2":
        return (ref * ref).sum(1)[:, None] + (query * query).sum(1) - 2 * ref @ query.T
    a, b = np.linalg.norm(ref, axis=1), np.linalg.norm(query, axis=1)
    if metric == "cosine":
        return -(ref @ query.T) / (a[:, None] * b + 1e-8)
    if metric == "unit_cosine":  # both sides normalised first, zero vectors stay zero
        return -(ref / np.where(a, a, 1)[:, None]) @ (query / np.where(b, b, 1)[:, None]).T
    raise ValueError(f"unknown metric {metric}")


def _store(ids: np.ndarray, of: np.ndarray, x: np.ndarray) -> bytes:
    return np.array(x.shape, "i8").tobytes() + ids.astype("i8").tobytes() + of.astype("i8").tobytes() + np.ascontiguousarray(x).tobytes()


def _load(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, classes and vectors."""
    n, d = np.frombuffer(data, "i8", 2)
    return np.frombuffer(data, "i8", n, 16), np.frombuffer(data, "i8", n, 16 + 8 * n), np.frombuffer(data, "f8", n * d, 16 + 16 * n).reshape(n, d)


def _placed(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Where vectors lie for the triangle inequality (on the unit sphere for cosines), and their norms."""
    norm = np.linalg.norm(x, axis=1)
    return (x if metric == "l2" else x / np.where(norm, norm, 1)[:, None]), norm


def _head(x: np.ndarray, of: np.ndarray, metric: str) -> bytes:
    """Rows, radius (infinite if a direction is missing), least norm, least and largest class, center."""
    at, norm = _placed(x, metric)
    center = at.mean(0)
    radius = np.inf if metric != "l2" and not norm.all() else np.sqrt(((at - center) ** 2).sum(1).max())
    return np.concatenate([[len(x), radius, norm.min(), of.min(), of.max()], center]).tobytes()


def packed(df: DataFrame, rows: int, metric: str, sorted_by: int = 0) -> DataFrame:
    """Vectors (columns id, vector, class, then sorted_by columns of numbers) in rows of up to so many, as PACKED; each task packs its own.

    Where sorted_by changes, a new row may begin, so that it holds rows near each other.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        no, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal no, n
            ids, x, of = (np.concatenate(c) for c in zip(*held))
            held.clear()
            no, n = no + 1, 0
            return pa.RecordBatch.from_pydict({"no": pa.array([no], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "data": [_store(ids, of, x)], "head": [_head(x, of, metric)]})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), batch.num_rows)
            of = batch.column(2).to_numpy(zero_copy_only=False).astype("i8")
            groups = [batch.column(3 + c).to_numpy(zero_copy_only=False) for c in range(sorted_by)]
            new = np.flatnonzero(np.any([g[1:] != g[:-1] for g in groups], axis=0)) + 1 if groups and batch.num_rows > 1 else np.zeros(0, int)
            for a, b in zip(np.append(0, new), np.append(new, batch.num_rows)):
                if n >= rows // 8 and groups:
                    yield flush()
                while a < b:
                    e = min(b, a + rows - n)
                    held.append((ids[a:e], x[a:e], of[a:e]))
                    n, a = n + e - a, e
                    if n == rows:
                        yield flush()
        if n:
            yield flush()

    return df.mapInArrow(run, PACKED)


def _near_pivots(df: DataFrame, pivots: np.ndarray, metric: str, by_class: bool) -> DataFrame:
    """Columns id, vector, class, (class,) pivot: sorted by the last ones over all tasks, a pivot of many rows in several."""
    if not len(pivots):
        return df.withColumn("pivot", F.lit(0))
    places = _placed(pivots, metric)[0]

    def run(batches):
        for batch in batches:
            at = _placed(_matrix(batch.column(1), batch.num_rows), metric)[0] if batch.num_rows else np.zeros((0, places.shape[1]))
            near = ((places**2).sum(1) - 2 * at @ places.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["id", "v", "of", "pivot"])

    order = ["of", "pivot"] if by_class else ["pivot"]
    return df.mapInArrow(run, "id long, v array<double>, of long, pivot int").repartitionByRange(*order, "id").sortWithinPartitions(*order)


def _bounds(q: np.ndarray, head: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest costs of queries (rows) to any row of each tile (columns)."""
    at, norm = _placed(q, metric)
    radius, least, center = head[:, 1], head[:, 2], head[:, 5:]
    d = np.sqrt(np.maximum((at * at).sum(1)[:, None] + (center * center).sum(1) - 2 * at @ center.T, 0))
    low, high = np.maximum(d - radius - SLACK, 0), d + radius + SLACK
    if metric == "l2":
        low, high = low * low, high * high
    else:
        low, high = low * low / 2 - 1, np.minimum(high * high / 2 - 1, 1)
        if metric == "cosine":  # costs are shrunk by small norms
            shrink = norm[:, None] * least / (norm[:, None] * least + 1e-8)
            low, high = np.where(low < 0, low, low * shrink), np.where(high < 0, high * shrink, high)
        high[norm == 0], low[norm == 0] = 1, -1
        high[:, np.isinf(radius)], low[:, np.isinf(radius)] = 1, -1
    slack = SLACK * (1 + np.abs(high)) if metric != "l2" else SLACK * (1 + (at * at).sum(1)[:, None] + (center * center).sum(1) + high)
    return low - slack, high + slack


def _gaps(of: np.ndarray, head: np.ndarray, by_class: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distances of classes."""
    if not by_class:
        return np.zeros((len(of), len(head))), np.zeros((len(of), len(head)))
    a, b = head[:, 3] - of[:, None], of[:, None] - head[:, 4]
    return np.maximum(np.maximum(a, b), 0), np.maximum(np.abs(a), np.abs(b))


def _kth(q, of, head, metric: str, by_class: bool, k: int) -> np.ndarray:
    """Bounds (gap, cost) of each query's k-th row, from tiles that hold k rows together; infinite where these tiles hold fewer."""
    high, gap = _bounds(q, head, metric)[1], _gaps(of, head, by_class)[1]
    order = np.lexsort((high, gap), axis=-1)
    enough = np.cumsum(head[:, 0][order], axis=1) >= k
    first = np.where(enough.any(1), enough.argmax(1), 0)
    pick = order[np.arange(len(q)), first]
    out = np.stack([gap[np.arange(len(q)), pick], high[np.arange(len(q)), pick]])
    out[:, ~enough.any(1)] = np.inf
    return out


def _bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.length("data"))).first()[0] or 0


def _met(blocks: DataFrame, others: DataFrame, columns: list[str], broadcast: int) -> DataFrame:
    """Pairs of every block (columns b_...) and every row of others: an equi-join by cells of a grid."""
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    size = _bytes(blocks)
    if size <= broadcast:
        return others.withColumn("q", F.lit(0)).join(F.broadcast(b.withColumn("q", F.lit(0))), "q").drop("q")
    rows, cols = -(-size // CELL), max(-(-_bytes(others) // (4 * CELL)), 1)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    b = b.withColumn("q", dealt("b_no", rows)).withColumn("r", every(cols))
    return others.withColumn("r", dealt("no", cols)).withColumn("q", every(rows)).join(b, ["q", "r"]).drop("q", "r")


def needed_pairs(blocks: DataFrame, tiles: DataFrame, metric: str, by_class: bool, k: int | None, within: float | None, broadcast: int = BROADCAST) -> DataFrame:
    """b_no, no: blocks with the tiles that may hold a row of their result; k counts a query's own row."""

    def chunk(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, HEADS):
                part = batch.slice(a, HEADS)
                no = part.column("no").to_numpy()
                yield pa.RecordBatch.from_pydict({"no": no[:1], "data": [no.tobytes() + b"".join(part.column("head").to_pylist())]})

    def pieces(batches):
        for batch in batches:
            for b_no, b_data, *rest in zip(*[batch.column(c).to_pylist() for c in batch.schema.names if c.startswith("b_")], batch.column("data").to_pylist()):
                _, of, q = _load(b_data)
                data = rest.pop()
                d = q.shape[1] + 5
                n = len(data) // (8 * (d + 1))
                yield b_no, q, of, np.frombuffer(data, "i8", n), np.frombuffer(data, "f8", n * d, 8 * n).reshape(n, d), *rest

    def bound(batches):
        for b_no, q, of, _, head in pieces(batches):
            yield pa.RecordBatch.from_pydict({"no": [b_no], "bound": [_kth(q, of, head, metric, by_class, k).tobytes()]})

    def least(t: pa.Table) -> pa.Table:
        both = np.stack([np.frombuffer(x.as_buffer()).reshape(2, -1) for x in t["bound"]])
        first = np.lexsort((both[:, 1], both[:, 0]), axis=0)[0]
        return pa.table({"no": t["no"].slice(0, 1), "bound": pa.array([both[first, :, np.arange(both.shape[2])].T.tobytes()], pa.binary())})

    def wanted(batches):
        for b_no, q, of, no, head, *limit in pieces(batches):
            low, gap = _bounds(q, head, metric)[0], _gaps(of, head, by_class)[0]
            need = np.ones(low.shape, bool)
            if limit:
                g, c = (x[:, None] for x in np.frombuffer(limit[0]).reshape(2, -1))
                need &= (gap < g) | (gap == g) & (low <= c)
            if within is not None:
                need &= low <= within
            hit = no[need.any(0)]
            yield pa.RecordBatch.from_pydict({"b_no": np.full(len(hit), b_no), "no": hit})

    heads = checkpointed(tiles.select("no", "head").coalesce(max(tiles.sparkSession.sparkContext.defaultParallelism, 1)).mapInArrow(chunk, "no long, data binary"))
    if k is not None:
        bounds = _met(blocks, heads, ["no", "data"], broadcast).mapInArrow(bound, "no long, bound binary").groupBy("no").applyInArrow(least, "no long, bound binary")
        blocks = blocks.join(bounds, "no")
    return _met(blocks, heads, ["no", "data", "bound"] if k is not None else ["no", "data"], broadcast).mapInArrow(wanted, "b_no long, no long")


def _sides(ref: DataFrame, queries: DataFrame, id_col: str, vec_col: str, class_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Columns id, v, of: of the queries, and of the reference."""
    cols = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.col(class_col) if class_col else F.lit(0)).cast("long").alias("of")).where("id is not null and v is not null and of is not null")
    return cols(queries), cols(ref)


def _cells(queries: DataFrame, ref: DataFrame) -> DataFrame:
    """Both sides in the cells (q, r) of a grid, each cell within one task: its queries (side 0), then its reference (side 1)."""
    size = lambda df: df.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    rows = max(-(-size(queries) // CELL), 1)
    cols = max(-(-size(ref) // (4 * CELL)), -(-CELLS * ref.sparkSession.sparkContext.defaultParallelism // rows))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    a = queries.withColumn("q", dealt(rows)).withColumn("r", every(cols)).withColumn("side", F.lit(0))
    b = ref.withColumn("q", every(rows)).withColumn("r", dealt(cols)).withColumn("side", F.lit(1))
    return a.unionByName(b).repartition("q", "r").sortWithinPartitions("q", "r", "side", "id")


def tile_sides(ref: DataFrame, queries: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "v", class_col: str | None = None, prune: bool = False, block: int = BLOCK, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Blocks of the queries and tiles of the reference, as PACKED; for pruning both lie by pivots (a sample of PIVOTS rows by hash of the id)."""
    a, b = _sides(ref, queries, id_col, vec_col, class_col)
    if not prune:
        return packed(a, block, metric), packed(b, tile, metric)
    some = np.array([r.v for r in b.orderBy(F.xxhash64("id")).limit(PIVOTS).collect()], float)  # PIVOTS vectors
    a, b = (_near_pivots(x, some, metric, bool(class_col)) for x in (a, b))
    if class_col:
        a, b = (x.select("id", "v", "of", F.col("of").alias("by"), "pivot") for x in (a, b))
    return tuple(checkpointed(packed(x, n, metric, 1 + bool(class_col))) for x, n in ((a, block), (b, tile)))


def similarity_join(ref: DataFrame, queries: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "v", class_col: str | None = None, k: int | None = None, within: float | None = None, exclude_self: bool = False, prune: bool = False, block: int = BLOCK, tile: int = TILE, broadcast: int = BROADCAST) -> DataFrame:
    """qid, rid, cost: of all pairs, of those with cost <= within, or with rank of the k nearest; with class_col, rows of the nearest classes come first.

    Ties go to the smaller reference id. A query is compared with itself if the reference holds it, unless exclude_self is set.
    """
    rows = PAIR if k is None else PAIR + ", gap long"
    if prune and (k is not None or within is not None):
        blocks, tiles = tile_sides(ref, queries, metric, id_col, vec_col, class_col, prune, block, tile)
        pairs = needed_pairs(blocks, tiles, metric, bool(class_col), None if k is None else k + exclude_self, within, broadcast)
        b = blocks.select(F.col("no").alias("b_no"), F.col("data").alias("b_data"))
        met = pairs.join(tiles.select("no", "data"), "no").join(F.broadcast(b) if _bytes(blocks) <= broadcast else b, "b_no").select("b_no", "b_data", "data")
        out = met.mapInArrow(lambda batches: _compared(batches, metric, bool(class_col), k, within, exclude_self), rows)
    else:
        met = _cells(*_sides(ref, queries, id_col, vec_col, class_col))
        out = met.mapInArrow(lambda batches: _passed(batches, metric, bool(class_col), k, within, exclude_self, block, tile), rows)
    if k is None:
        return out
    w = Window.partitionBy("qid").orderBy("gap", "cost", "rid")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("gap")


def _passed(batches, metric: str, by_class: bool, k: int | None, within: float | None, exclude_self: bool, block: int = BLOCK, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR from the rows of _cells(): the queries of a cell are held, its reference passes by."""
    cell, queries, best = None, [], {}
    for batch in batches:
        if not batch.num_rows:
            continue
        q, r, side, ids, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("q", "r", "side", "id", "of"))
        x = _matrix(batch.column("v"), batch.num_rows)
        new = np.flatnonzero((q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (side[1:] != side[:-1])) + 1
        for a, e in zip(np.append(0, new), np.append(new, batch.num_rows)):
            if cell != (q[a], r[a]):
                yield from (_rows(*best.pop(at)) for at in list(best))
                cell, queries = (q[a], r[a]), []
            part = ids[a:e], of[a:e], x[a:e]
            if not side[a]:
                queries.append(part)
            elif queries:
                queries = [tuple(np.concatenate(c) for c in zip(*queries))] if len(queries) > 1 else queries
                yield from _pairs(queries[0], part, best, None, metric, by_class, k, within, exclude_self, block, tile)
    yield from (_rows(*lot) for lot in best.values())


def _compared(batches, metric: str, by_class: bool, k: int | None, within: float | None, exclude_self: bool, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR from pairs of blocks and tiles; of the k nearest, one lot for each of up to so many slices of blocks at a time."""
    best: dict[tuple, list] = {}
    for batch in batches:
        for b_no, b_data, data in zip(batch.column("b_no").to_pylist(), batch.column("b_data"), batch.column("data")):
            yield from _pairs(_load(b_data.as_buffer()), _load(data.as_buffer()), best, b_no, metric, by_class, k, within, exclude_self)
            if len(best) > most:
                yield from (_rows(*best.pop(at)) for at in list(best))
    yield from (_rows(*lot) for lot in best.values())


def _pairs(queries: tuple, rows: tuple, best: dict, no: int | None, metric: str, by_class: bool, k: int | None, within: float | None, exclude_self: bool, block: int = BLOCK, tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR from queries and reference rows (ids, classes, vectors), at most PAIRS pairs at once; with k they are merged into best by (no, slice) instead."""
    (qid, qc, q), (rid, of, x) = queries, rows
    step = max(min(block, PAIRS // tile), 1)
    for b in range(0, len(rid), tile):
        r = slice(b, b + tile)
        for a in range(0, len(qid), step):
            s = slice(a, a + step)
            gap = np.abs(of[r, None] - qc[s]) if by_class else None
            lot = _nearest(costs(x[r], q[s], metric), rid[r], qid[s], gap, k, exclude_self, within)
            if k is None:
                yield _rows(*lot[:3])
            else:
                best[no, a] = _top([np.concatenate(c) for c in zip(best[no, a], lot)] if (no, a) in best else lot, k)


def _nearest(c: np.ndarray, rid: np.ndarray, qid: np.ndarray, gap: np.ndarray | None, k: int | None, exclude_self: bool, within: float | None = None) -> list[np.ndarray]:
    """Pairs of a tile: all, those within a cost, or those that can be among the k nearest of their query (ties included)."""
    if k is None and within is None and not exclude_self:
        return [np.tile(qid, len(rid)), np.repeat(rid, len(qid)), c.ravel(), np.zeros(c.size, np.int64) if gap is None else gap.ravel()]
    take = np.ones(c.shape, bool) if within is None else c <= within
    if k is not None and len(rid) > k + exclude_self:
        # by class distance first; rows within the rounding of that sum are kept, and ranked exactly later
        key = c if gap is None else c + 1e9 * gap
        bound = np.partition(key, k - 1 + exclude_self, axis=0)[k - 1 + exclude_self]
        take &= key <= bound + 1e-9 * (1 + np.abs(bound))
    if exclude_self:
        take &= rid[:, None] != qid
    r, q = np.nonzero(take)
    return [qid[q], rid[r], c[r, q], np.zeros(len(r), np.int64) if gap is None else gap[r, q]]


def _top(cols: list[np.ndarray], k: int) -> list[np.ndarray]:
    qid, rid, cost, gap = cols
    order = np.lexsort([rid, cost, gap, qid])
    new = np.flatnonzero(np.append(True, qid[order][1:] != qid[order][:-1]))
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return [c[order[place < k]] for c in cols]


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    kinds = [("qid", pa.int64()), ("rid", pa.int64()), ("cost", pa.float64()), ("gap", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds[: len(cols)]])


def nearest_codeword(rows: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "v", code_col: str = "code_id", code_vec: str = "c", unit: bool = False, max_codes: int = 1 << 20) -> DataFrame:
    """All columns of rows with code (argmin of squared distance, ties to the smaller code) and distance.

    The codebook is a model of fixed size: over max_codes entries it is refused rather than broadcast.
    """
    got = codebook.select(code_col, code_vec).orderBy(code_col).limit(max_codes + 1).collect()
    if len(got) > max_codes:
        raise ValueError(f"codebook has more than {max_codes} entries")
    ids, book = np.array([r[0] for r in got]), np.array([r[1] for r in got], float)
    if unit:
        book = book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)
    shared = rows.sparkSession.sparkContext.broadcast((ids, book))
    names = rows.columns
    at = names.index(vec_col)

    def run(batches):
        ids, book = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column(at), batch.num_rows)
            if unit:
                z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            d = ((z * z).sum(1)[:, None] + (book * book).sum(1)) - 2 * z @ book.T
            pick = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[pick], pa.int64()), pa.array(d[np.arange(len(pick)), pick])], names=[*names, "code", "distance"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.LongType()), T.StructField("distance", T.DoubleType())]))
