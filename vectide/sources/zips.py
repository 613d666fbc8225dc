"""Archives of named items as a Spark data source (``vectide_archives``): a folder of zip files, to read and to write.

Each zip holds its items uncompressed and, in ``dataset.json``, the pairs of name and label of its labelled items. Reading: an archive of more than
``split_bytes`` is dealt to several tasks by ranges of its directory; filters on ``archive``, ``name`` and ``extension`` leave items out before they are read, and
contents are read only if the schema has ``content``. NPZ files are such archives, too.

Writing: a task writes one zip into a folder of the job below ``_temporary``. Only when all tasks are done, the driver moves the zips of the
attempts that Spark counted to their place and adds ``_SUCCESS``; a job that fails leaves nothing. With mode overwrite, earlier zips go then. A null
name or content is an error; items of equal names are all kept, each with its own place in an archive but the last one's label.
"""

from __future__ import annotations

import json
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, WriterCommitMessage
from pyspark.sql.types import StructType

from vectide.sources.archive import SUPPORTED
from vectide.sources.listing import Filters, Parts, check_columns, entries, extension_of, opened, packed, record_batches

SCHEMA = "archive string, name string, extension string, size long, label long, content binary"
LABELS = "dataset.json"


class Archives(DataSource):
    """Options: path (a folder of archives, or one); split_bytes (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "vectide_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, schema, overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split = options["path"], int(options.get("split_bytes", 128 << 20))
        self.columns = schema.fieldNames()
        self.filters = Filters(("archive", "name", "extension"))
        check_columns(self.columns, SCHEMA)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.filters.take(filters)

    def partitions(self) -> list[Parts]:
        fs, root = opened(self.path)
        own = fs.get_file_info(root)
        files = [own] if own.type == pafs.FileType.File else entries(fs, root)
        wanted = (x for x in files if x.type == pafs.FileType.File and x.extension.lower() in ("zip", "npz"))
        return packed(((x.path, x.size) for x in wanted if self.filters.keep({"archive": x.base_name})), self.split)

    def read(self, partition: Parts | None) -> Iterator[pa.RecordBatch]:
        return record_batches(self._rows(partition.pieces if partition else []), self.columns)

    def _rows(self, pieces: list) -> Iterator[dict]:
        fs, _ = opened(self.path)
        for path, share, shares in pieces:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                items = sorted((x for x in z.infolist() if not x.is_dir()), key=lambda x: x.header_offset)
                labels = {}
                if "label" in self.columns and LABELS in z.namelist():
                    labels = {name.replace("\\", "/"): label for name, label in json.loads(z.read(LABELS)).get("labels") or []}
                for x in items[len(items) * share // shares : len(items) * (share + 1) // shares]:
                    row = {"archive": path.rsplit("/", 1)[-1], "name": x.filename, "extension": extension_of(x.filename), "size": x.file_size, "label": labels.get(x.filename)}
                    if x.filename != LABELS and self.filters.keep(row):
                        if "content" in self.columns:
                            row["content"] = z.read(x)
                        yield row


@dataclass
class Written(WriterCommitMessage):
    """Name of the zip that an attempt wrote; none of an attempt without rows."""

    name: str | None


class _Out:
    """The part of a file that writing a zip to a stream needs."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if missing := {"name", "content"} - set(schema.fieldNames()):
            raise ValueError(f"an archive needs the columns {sorted(missing)}")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.labelled = "label" in schema.fieldNames()

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = opened(self.path)
        return fs, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self._places()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}.zip"
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        fs.create_dir(folder)
        try:
            with fs.open_output_stream(f"{folder}/{name}") as f:
                self._fill(f, first, batches)
        except BaseException:
            fs.delete_file(f"{folder}/{name}")
            raise
        return Written(name)

    def _fill(self, stream, first: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> None:
        labels = []
        with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED) as z, warnings.catch_warnings():
            warnings.simplefilter("ignore")  # items of equal names
            batch = first
            while batch is not None:
                own = batch.column("label").to_pylist() if self.labelled else [None] * batch.num_rows
                for name, content, label in zip(batch.column("name").to_pylist(), batch.column("content"), own):
                    if name is None or not content.is_valid:
                        raise ValueError(f"item {name} has no name or content")
                    z.writestr(zipfile.ZipInfo(name), content.as_py())
                    if label is not None:
                        labels.append([name, label])
                batch = next(batches, None)
            if labels:
                z.writestr(zipfile.ZipInfo(LABELS), json.dumps({"labels": labels}))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root, folder = self._places()
        fs.create_dir(root)
        earlier = [x.path for x in entries(fs, root) if x.extension == "zip"] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{folder}/{m.name}", f"{root}/{m.name}")
        for path in earlier:
            fs.delete_file(path)
        self._clear()
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what is left of this job; other jobs may write to the same place."""
        fs, root, folder = self._places()
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
        work = f"{root}/_temporary"
        if fs.get_file_info(work).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(work)):
            fs.delete_dir(work)


def write_zips(items: DataFrame, path: str, mode: str = "append") -> None:
    """Items (arcname, bytes, label) as zips, one a task; null labels are kept out. The sources must be registered (tree.register)."""
    x = items.select(F.col("arcname").alias("name"), F.col("bytes").alias("content"), F.col("label").cast("long").alias("label"))
    x.write.format("vectide_archives").mode(mode).save(path)


def read_zips(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """name, bytes, label of the items of supported kinds; with check, an item without a label is an error."""
    x = spark.read.format("vectide_archives").load(path).where(F.col("extension").isin(*[s[1:] for s in SUPPORTED]))
    x = x.select("name", F.col("content").alias("bytes"), "label")
    if check:
        missing = F.raise_error(F.concat(F.lit("no label for "), F.col("name"))).cast("long")
        x = x.withColumn("label", F.coalesce("label", missing))
    return x
