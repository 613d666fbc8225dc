"""Arrays stacked in order: shards of a fixed number of rows, whose offsets are known before any is written.

A shard is one row: its place, its first row, and an NPY file of its rows' arrays. Shards are rows of a Parquet table, so Spark's commit protocol holds: a
task that fails leaves nothing, and any store that Spark writes to will do. Rows of equal order fall in any order.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.numbering import numbered

SHARD = "shard long, first long, n long, npy binary"


def stacked(df: DataFrame, order: str, value: str, shape: tuple[int, ...] = (-1,), dtype: str = "float64", rows: int = 4096) -> DataFrame:
    """Shards (SHARD) of the arrays of value, each reshaped to shape, in the order of a whole-number column without nulls; an array that doesn't fit, or is null, is an error."""

    def shard(t: pa.Table) -> pa.Table:
        t = t.sort_by("rn")
        if t["x"].null_count:
            raise ValueError("null array")
        sizes = np.unique(t["x"].combine_chunks().value_lengths().to_numpy())
        if len(sizes) > 1:
            raise ValueError("arrays of different sizes")
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, *shape).astype(dtype)
        out = io.BytesIO()
        np.save(out, x, allow_pickle=False)
        first = t["rn"][0].as_py() - 1
        return pa.table({"shard": [first // rows], "first": [first], "n": [t.num_rows], "npy": pa.array([out.getvalue()], pa.binary())})

    x = numbered(df.select(F.col(order).cast("long").alias("at"), F.col(value).alias("x")), "at").select("rn", "x")
    return x.groupBy(F.floor((F.col("rn") - 1) / rows)).applyInArrow(shard, SHARD)


def write_stacked(df: DataFrame, path: str, order: str, value: str, **more) -> None:
    stacked(df, order, value, **more).write.parquet(path)


def unstacked(shards: DataFrame) -> DataFrame:
    """place (from 0) and x (flat, as doubles) of every row of the shards."""

    def run(batches):
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("npy").to_pylist()):
                x = np.load(io.BytesIO(data), allow_pickle=False)
                flat = x.reshape(len(x), -1).astype(float)
                yield pa.RecordBatch.from_pydict({"place": np.arange(first, first + len(x)), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * flat.shape[1]), pa.array(flat.ravel()))})

    return shards.select("first", "npy").mapInArrow(run, "place long, x array<double>")


def read_stacked(spark: SparkSession, path: str) -> DataFrame:
    return unstacked(spark.read.parquet(path))
