"""Dealing documents into chunks and key blobs between chunks and key ranges.

A chunk is the set of documents whose id and text hash to one number. A task on a chunk sends one row for each
range of keys, holding all its distinct keys of that range as one binary value; the task on a key range
answers with one row for each chunk. A key that every document holds therefore costs one entry a chunk,
not one a document, so hot keys are pre-aggregated before the shuffle. Shuffled rows are few and large,
which keeps Spark's cost for each key small. The numbers of chunks and of key ranges follow the bytes of the texts, the
second with a larger divisor; rows between them are the product of both.
All steps are deterministic functions of their input rows, so lost tasks can be run again.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.textnp import planes, unplanes

PACK_BYTES, CHUNK_BYTES, RANGE_BYTES = 16_000_000, 8_000_000, 32_000_000
CHUNK_SETTING, RANGE_SETTING = "spark.vectide.chunkBytes", "spark.vectide.rangeBytes"
ROWS = "dest int, chunk int, kind int, payload binary"
ARROW_ROWS = pa.schema([("dest", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
RANGE = ["u4", "u4", "u4"]  # doc number in the chunk, first window, windows
LAST = np.iinfo(np.int64).max  # stands for a null id
_LEAN: list[bool] = []


def lean_worker() -> None:
    """Let a Python worker give memory back: Arrow's pool, NumPy's arrays of 1 MB and more (glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD), free heap now."""
    libc = ctypes.CDLL(None)
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)
            libc.mallopt(-1, 4 << 20)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f):
    """A task's function, with lean_worker() before and after it: idle workers of earlier stages share an executor's memory with the next ones."""

    @wraps(f)
    def group(*args, **kw):
        lean_worker()
        try:
            return f(*args, **kw)
        finally:
            lean_worker()

    @wraps(f)
    def stream(*args, **kw):
        lean_worker()
        yield from f(*args, **kw)
        lean_worker()

    return stream if isgeneratorfunction(f) else group


def partitions(docs: DataFrame, count: int | None = None, text_col: str = "text", ranges: int | None = None) -> tuple[int, int]:
    """Numbers of chunks and of key ranges: those given (half as many ranges by default), else one for each CHUNK_BYTES and RANGE_BYTES of text; for small tables enough for some tasks.

    A worker holds a chunk as arrays, and the keys of a range, so both sizes should grow with the memory of executors (settings
    CHUNK_SETTING and RANGE_SETTING of the session): with few chunks the rows between chunks and ranges are large and the shuffle has few of them.
    """
    if count:
        return count, ranges or max(count // 2, 1)
    conf = docs.sparkSession.conf
    chunk_bytes, range_bytes = int(conf.get(CHUNK_SETTING, str(CHUNK_BYTES))), int(conf.get(RANGE_SETTING, str(RANGE_BYTES)))
    if chunk_bytes < 1 or range_bytes < 1:
        raise ValueError(f"{CHUNK_SETTING} and {RANGE_SETTING} are numbers of bytes, 1 or more")
    size = docs.select(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    least = max(min(int(conf.get("spark.sql.shuffle.partitions")), 16), 1)
    return max(-(-size // chunk_bytes), least), ranges or max(-(-size // range_bytes), least)


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of schema with more fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir for this application; one of its own only where that is unset and Spark is local."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, name: str, by: str) -> str:
    """df as Parquet files in the shared folder, those of each value of a column in a folder of their own, for stored_rows(); the folder's name."""
    folder = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).option("compression", "zstd").parquet(folder)
    return folder


def stored_rows(folder: str) -> pa.Table | None:
    """Within a task, all rows of a folder of Parquet files; None where there is no such folder."""
    system, path = fs.FileSystem.from_uri(folder)
    parts = []
    for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.path):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                parts.append(pq.read_table(source))
    return pa.concat_tables(parts) if parts else None


def release(df: DataFrame) -> None:
    """Let Spark remove shuffle files of finished rounds: its cleaner does so after garbage collections of the driver, which may else be far apart."""
    for _ in range(2):  # what the first one frees holds the rest
        gc.collect()
        df.sparkSession.range(1).count()  # the scheduler keeps its last job until there is another
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.1)


@lean
def _pack(batches):
    """Rows of a task as one compressed blob for each chunk, whenever PACK_BYTES have come together."""

    def flush(held):
        table = pa.Table.from_batches(held)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.drop_columns(["chunk"]).take(pa.array(order)), chunk[order]
        head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        blobs = []
        for a, b in zip(head, np.append(head[1:], len(chunk))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(a, b - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[head], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "rows"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def chunked(docs: DataFrame, n: int, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """chunk and compressed rows, dealt by chunk; uses of one such frame in a plan share its shuffle."""
    return chunk_rows(docs, n, id_col, text_col, carry).repartition(n, "chunk")


def chunk_rows(docs: DataFrame, n: int, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """chunk and compressed rows (doc_id, text, h: hash of the text, carried columns), not dealt yet."""
    more = [F.col(f"`{c}`") for c in carry or []]
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    h = F.xxhash64(text)
    flat = docs.select(key.alias("doc_id"), text.alias("text"), h.alias("h"), *more, F.pmod(F.xxhash64(key, h), F.lit(n)).cast("int").alias("chunk"))
    return flat.mapInArrow(_pack, "chunk int, rows binary")


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk in their fixed order: by id, hash of the text, then text, so that repeated rows fall the same way in every run."""
    chunk = table["chunk"][0]
    table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for part in table["rows"].chunks for b in part])
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("h", "ascending"), ("text", "ascending")]))
    return table.append_column("chunk", pa.repeat(chunk, table.num_rows))


def rows(items: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows of dest, chunk, kind and payload, compressed; an Arrow buffer is taken as it is."""
    cols = [*zip(*items)] if items else [[], [], [], []]
    cols[3] = [p.to_pybytes() if isinstance(p, pa.Buffer) else _smaller(p) for p in cols[3]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, ARROW_ROWS.types)], schema=ARROW_ROWS)


def _smaller(payload: bytes) -> bytes:
    return b"\0" + bytes(payload) if len(payload) < 512 else b"\1" + len(payload).to_bytes(8, "little") + pa.compress(payload, "zstd", asbytes=True)


def unpacked(payload: pa.Buffer) -> memoryview:
    view = memoryview(payload)
    return memoryview(pa.decompress(view[9:], int.from_bytes(view[1:9], "little"), "zstd")) if view[0] else view[1:]


def cuts(sorted_keys: np.ndarray, r: int, bits: int) -> np.ndarray:
    """Bounds of the r equal key ranges within sorted keys of so many bits."""
    edges = np.array([(b << bits) // r for b in range(1, r)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def send(keys: np.ndarray, flags: np.ndarray, r: int, bits: int, flag_bits: int, chunk: int, kind: int = 0) -> list[tuple[int, int, int, bytes]]:
    """One row for each key range from sorted distinct keys with small flags."""
    width = (bits + flag_bits + 7) // 8
    at = cuts(keys, r, bits)
    full = (keys << np.uint64(flag_bits)) | flags.astype(np.uint64)
    return [(b, chunk, kind, planes(full[at[b] : at[b + 1]], width)) for b in range(r) if at[b + 1] > at[b]]


def received(table: pa.Table, bits: int, flag_bits: int, kind: int = 0) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, keys, flags and bounds of each chunk's part, from the rows of one key range."""
    width = (bits + flag_bits + 7) // 8
    parts = [(c, p) for _, c, p in by_kind(table, kind)]
    values = [unplanes(p, width) for _, p in parts]
    full = np.concatenate(values) if values else np.zeros(0, np.uint64)
    bounds = np.cumsum([0] + [len(v) for v in values])
    return [c for c, _ in parts], full >> np.uint64(flag_bits), full & np.uint64((1 << flag_bits) - 1), bounds


def kept_rows(table: pa.Table, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Rows that only pass through a key range, back to their chunk."""
    return [(c, d, kind, p) for d, c, p in by_kind(table, kind, raw=True)]


def replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    """Payload of each key range (in column chunk of an answer) for one chunk."""
    return {c: p for _, c, p in by_kind(table, kind)}


def answer_bits(keys: np.ndarray, r: int, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """One bit a key, in the order in which send() took the keys."""
    out = np.zeros(len(keys), bool)
    at = cuts(keys, r, bits)
    for b, blob in answers.items():
        size = int(at[b + 1] - at[b])
        out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=size).astype(bool)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.diff(np.append(new, len(keys)))


def ids(table: pa.Table) -> np.ndarray:
    """Ids of a chunk's rows, LAST for null."""
    return table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype("i8")


def dump(*columns: np.ndarray) -> bytes:
    """Equally long columns in one blob, byte planes apart so that they compress."""
    return b"".join([len(columns[0]).to_bytes(8, "little"), *[np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns]])


def load(blob: bytes, dtypes: list) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for t in dtypes:
        t = np.dtype(t)
        raw = np.frombuffer(blob, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).view(t).ravel() if n else np.zeros(0, t))
        at += n * t.itemsize
    return out


def load_all(blobs: list[bytes], dtypes: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all blobs, and the bounds of each blob."""
    parts = [load(b, dtypes) for b in blobs]
    cols = [np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in enumerate(dtypes)]
    return cols, np.cumsum([0] + [len(p[0]) for p in parts])


def merged(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Ranges of windows, adjoining ones joined."""
    doc, first, end = doc.astype("i8"), first.astype("i8"), first.astype("i8") + count
    order = np.lexsort([first, doc])
    doc, first, end = doc[order], first[order], end[order]
    if len(doc):
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > end[:-1])))
        doc, first, end = doc[head], first[head], np.maximum.reduceat(end, head)
    return [doc.astype("u4"), first.astype("u4"), (end - first).astype("u4")]


def split_by_chunk(chunks: list[int], bounds: np.ndarray, rows: np.ndarray, positions: bool = False) -> list[tuple[int, np.ndarray]]:
    """Rows (or their positions in rows) of each chunk."""
    which = np.searchsorted(bounds, rows, "right") - 1
    order = np.argsort(which, kind="stable")
    at = np.searchsorted(which[order], np.arange(len(chunks) + 1))
    parts = [(c, order[at[i] : at[i + 1]]) for i, c in enumerate(chunks) if at[i + 1] > at[i]]
    return parts if positions else [(c, rows[p]) for c, p in parts]


def by_kind(table: pa.Table, kind: int, raw: bool = False) -> list:
    """(dest, chunk, payload) of a kind, in a fixed order; raw: payloads as they are in the table, for rows()."""
    at = np.flatnonzero(table["kind"].to_numpy() == kind)
    dest, chunk, payload = table["dest"].to_numpy()[at].tolist(), table["chunk"].to_numpy()[at].tolist(), table["payload"]
    out = [(d, c, payload[int(k)].as_buffer()) for d, c, k in zip(dest, chunk, at)]
    twice = len(set(zip(dest, chunk))) < len(out)
    out.sort(key=lambda x: (x[0], x[1], x[2].to_pybytes()) if twice else x[:2])
    return out if raw else [(d, c, unpacked(p)) for d, c, p in out]


def subranges(parts: list[np.ndarray], bits: int = 0, size: int = 500_000) -> list[list[tuple[int, int]]]:
    """Slices of sorted keys (their low bits aside) of about size keys together, cut at the same keys in all parts."""
    largest = max(parts, key=len)
    step = max(size // len(parts), 1)
    edges = np.unique((largest[step::step] >> np.uint64(bits)) << np.uint64(bits))
    cut = [np.concatenate([[0], np.searchsorted(p, edges), [len(p)]]) for p in parts]
    return [[(int(c[s]), int(c[s + 1])) for c in cut] for s in range(len(edges) + 1)]
