"""Files of a folder tree as a Spark data source (``vectide_files``), in batch and as a stream of new files.

Planning keeps a name and a count for each folder; files are listed and read in tasks. A folder of more than
``files_per_partition`` files is dealt to several tasks by a checksum of file names, small folders share one. Filters on ``name`` (its beginning),
``class_name`` and ``extension`` leave folders and files out before they are read; contents are read only if the schema has ``content``:
``spark.read.format("vectide_files").schema("name string, extension string").load(root)``.

A stream takes files by their time of modification, once that is ``settle_ms`` milliseconds ago (1,000 by default), so a file must be complete by then; a file
moved in with an older time than the last batch's is not seen. A batch is a range of times: replayed, it gives the same files.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter
from pyspark.sql.types import StructType

from vectide.sources.listing import Filters, Parts, check_columns, entries, extension_of, opened, packed, record_batches

SCHEMA = "path string, name string, class_name string, extension string, size long, modified timestamp, content binary"


class Files(DataSource):
    """Options: path; recursive (true); extensions (comma list, all by default); files_per_partition (4096); settle_ms (1000, streams)."""

    @classmethod
    def name(cls) -> str:
        return "vectide_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeStream(self.options, schema)


class Tree:
    """Listing of a tree and reading of its pieces."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.deep = options.get("recursive", "true").lower() == "true"
        self.extensions = {x.strip().lower() for x in options.get("extensions", "").split(",")} - {""}
        self.most = int(options.get("files_per_partition", 4096))
        self.settle = int(options.get("settle_ms", 1000))
        self.columns = schema.fieldNames()
        self.filters = Filters(("name", "class_name", "extension"))
        check_columns(self.columns, SCHEMA)

    def folders(self) -> Iterator[tuple[str, list[pafs.FileInfo]]]:
        """Each folder that may hold wanted files, by its path below the root ('' or ending in '/'), with those files."""
        fs, root = opened(self.path)
        todo = [""]
        while todo:
            folder = todo.pop()
            found = entries(fs, f"{root}/{folder}".rstrip("/"))
            if self.deep:
                below = [f"{folder}{x.base_name}/" for x in found if x.type == pafs.FileType.Directory]
                todo += [x for x in reversed(below) if self.filters.keep_folder(x)]
            yield folder, [x for x in found if x.type == pafs.FileType.File and self.wanted(folder, x)]

    def row(self, folder: str, file: pafs.FileInfo) -> dict:
        name = folder + file.base_name
        return {"path": f"{self.path}/{name}", "name": name, "class_name": folder.rstrip("/").rsplit("/", 1)[-1] or None, "extension": extension_of(name), "size": file.size, "modified": datetime.fromtimestamp(file.mtime_ns / 1e9, timezone.utc)}

    def wanted(self, folder: str, file: pafs.FileInfo) -> bool:
        row = self.row(folder, file)
        return (not self.extensions or row["extension"] in self.extensions) and self.filters.keep(row)

    def pieces(self, after: int = -1, until: int = 1 << 62) -> list[Parts]:
        counts = ((folder, sum(after < x.mtime_ns <= until for x in files)) for folder, files in self.folders())
        return packed(((folder, n) for folder, n in counts if n), self.most)

    def rows(self, parts: Parts, after: int = -1, until: int = 1 << 62) -> Iterator[dict]:
        fs, root = opened(self.path)
        for folder, share, shares in parts.pieces:
            for x in entries(fs, f"{root}/{folder}".rstrip("/")):
                mine = x.type == pafs.FileType.File and zlib.crc32(x.base_name.encode()) % shares == share
                if mine and after < x.mtime_ns <= until and self.wanted(folder, x):
                    row = self.row(folder, x)
                    if "content" in self.columns:
                        with fs.open_input_stream(x.path) as f:
                            row["content"] = f.read()
                    yield row


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.tree = Tree(options, schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.tree.filters.take(filters)

    def partitions(self) -> list[Parts]:
        return self.tree.pieces()

    def read(self, partition: Parts | None) -> Iterator[pa.RecordBatch]:
        # without any partition Spark asks once with none
        return record_batches(self.tree.rows(partition) if partition else (), self.tree.columns)


class Window(Parts):
    """Pieces with the range of modification times of a stream's batch."""

    def __init__(self, parts: Parts, after: int, until: int):
        super().__init__(parts.pieces)
        self.after, self.until = after, until


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.tree = Tree(options, schema)
        self.last = -1

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.tree.settle * 1_000_000
        times = (x.mtime_ns for _, files in self.tree.folders() for x in files)
        self.last = max((t for t in times if t <= settled), default=self.last)
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[Parts]:
        return [Window(p, start["until"], end["until"]) for p in self.tree.pieces(start["until"], end["until"])]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return record_batches(self.tree.rows(partition, partition.after, partition.until), self.tree.columns)


def register(spark: SparkSession) -> None:
    """Makes the file and archive sources known to a session, and lets Spark hand filters to sources written in Python."""
    from vectide.sources.zips import Archives

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)
    spark.dataSource.register(Archives)
