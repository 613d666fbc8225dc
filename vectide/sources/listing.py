"""What the file sources share: filters that a source takes over, and listings packed into input partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

BATCH_BYTES = 32 << 20
TYPES = {"path": pa.string(), "name": pa.string(), "class_name": pa.string(), "archive": pa.string(), "extension": pa.string(), "size": pa.int64(), "label": pa.int64(), "modified": pa.timestamp("us", "UTC"), "content": pa.binary()}


def check_columns(columns: list[str], schema: str) -> None:
    if unknown := set(columns) - {c.split()[0] for c in schema.split(", ")}:
        raise ValueError(f"no such columns: {sorted(unknown)}")


class Parts(InputPartition):
    """Pieces of folders or archives: (name, share, shares) each."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


class Filters:
    """Filters on columns that are known before a file is read."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.held = columns, []

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keeps those that can be tested here and gives back the rest."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in self.columns
            if known:
                self.held.append(f)
            else:
                yield f

    def keep(self, values: dict) -> bool:
        """Whether the columns given can be those of a wanted row; columns not given are not tested."""
        return all(_holds(f, values[f.attribute[0]]) for f in self.held if f.attribute[0] in values)

    def keep_folder(self, prefix: str) -> bool:
        """Whether names that begin so can be wanted."""
        tested = [f for f in self.held if f.attribute == ("name",)]
        return all(_reaches(f, prefix) for f in tested)


def _holds(f: Filter, value) -> bool:
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else True


def _reaches(f: Filter, prefix: str) -> bool:
    if isinstance(f, EqualTo):
        return f.value is not None and f.value.startswith(prefix)
    if isinstance(f, In):
        return any(v is not None and v.startswith(prefix) for v in f.value)
    return not isinstance(f, StringStartsWith) or f.value.startswith(prefix) or prefix.startswith(f.value)


def extension_of(name: str) -> str:
    last = name.rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[1].lower() if "." in last else ""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    fs, root = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


def entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """A folder's own entries in the order of names, without those that Spark's readers leave out, too."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((x for x in found if x.base_name[:1] not in ("_", ".")), key=lambda x: x.base_name)


def packed(sizes: Iterable[tuple[str, int]], most: int) -> list[Parts]:
    """Input partitions of about `most` each: what is larger is cut into shares, what is smaller shares a partition."""
    out, held, total = [], [], 0
    for name, size in sizes:
        shares = -(-size // most)
        if shares > 1:
            out += [Parts([(name, k, shares)]) for k in range(shares)]
            continue
        if total + size > most and held:
            out.append(Parts(held))
            held, total = [], 0
        held.append((name, 0, 1))
        total += size
    return out + [Parts(held)] if held else out


def record_batches(rows: Iterable[dict], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that end when their contents reach BATCH_BYTES or they are 4,096."""
    held, size = [], 0
    schema = pa.schema([(c, TYPES[c]) for c in columns])
    for row in rows:
        held.append(row)
        size += len(row.get("content") or b"")
        if size >= BATCH_BYTES or len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
