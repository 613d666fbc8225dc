"""Running-state operators in batch form: an ordered fold is a prefix scan, or a sum with weights known from place and count; no list is collected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.numbering import numbered_by
from vectide.operators.scan import affine_fold


def ema(df: DataFrame, key: str, order: str, value: str, decay: float, name: str = "ema") -> DataFrame:
    """Last state of e <- decay * e + (1 - decay) * x for each key, e starting as the first x; order: whole numbers."""
    x = numbered_by(df.select(key, order, F.col(value).alias("__x")), key, order, "__i", "__n")
    first = F.when(F.col("__i") == 1, 1.0).otherwise(1.0 - decay)
    return x.groupBy(key).agg(F.sum(F.col("__x") * first * F.pow(F.lit(decay), F.col("__n") - F.col("__i"))).alias(name))


def lerp(value: Column, weight: float, start: float) -> tuple[Column, Column, float]:
    """The state v <- v + weight * (x - v), v starting at start, for scan.affine_fold."""
    return F.lit(1.0 - weight), value * F.lit(weight), start


def lerp_fold(batches: DataFrame, keys: list[str], place: str, value: Column, weight: float, start: float, name: str) -> DataFrame:
    """Last state of v <- v + weight * (x - v) over the batches of each key, v starting at start; a row of batches stands for a whole batch."""
    return affine_fold(batches, keys, place, {name: lerp(value, weight, start)})


def ring_usage(df: DataFrame, key: str, order: str, code: Column, size: int, codes: int, name: str = "usage", width: int = 65536) -> DataFrame:
    """Share of codes among the last `size` codes of each row; the buffer starts full of code 0. order: whole numbers, no two rows of a key alike.

    Places of a key are cut into ranges of the larger of width and size; a range is one task's, together with the size - 1 rows before it, which are all that its
    buffers hold. So no key is one task, and rows are shuffled once more, twice over at most. A null code is a code.
    """
    span = max(width, size)
    x = numbered_by(df.select(key, order, code.cast("long").alias("__c")), key, order, "__i", width=width).withColumn("__i", F.col("__i") - 1)
    own = F.floor(F.col("__i") / span).cast("long")
    late = F.col("__i") > (own + 1) * span - size  # in buffers of the next range
    x = x.withColumn("__part", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__i")
        c, place, part = t["__c"], t["__i"].to_numpy(), t["__part"][0].as_py()
        used = in_ring(c.fill_null(0).to_numpy(), c.is_null().to_numpy(), size, part == 0)
        mine = int(np.searchsorted(place, part * span))
        return pa.table([t[key][mine:], t[order][mine:], pa.array(used[mine:] / codes)], names=[key, order, name])

    schema = T.StructType([df.schema[key], df.schema[order], T.StructField(name, T.DoubleType())])
    return x.groupBy(key, "__part").applyInArrow(run, schema)


def in_ring(code: np.ndarray, null: np.ndarray, size: int, start: bool) -> np.ndarray:
    """How many distinct codes the last size of successive codes hold, after each; start: of a buffer that was full of code 0 before.

    A code is in the buffer from its place to that of its next occurrence, or for size places: a running sum of +1 and -1.
    """
    if start:
        code, null = np.append(0, code), np.append(False, null)
    n = len(code)
    end = np.arange(n) + size
    at = np.lexsort([np.arange(n), code, null])
    again = np.flatnonzero((code[at][1:] == code[at][:-1]) & (null[at][1:] == null[at][:-1]))
    end[at[again]] = np.minimum(end[at[again]], at[again + 1])
    step = np.ones(n, np.int64) - np.bincount(end[end < n], minlength=n)
    return np.cumsum(step)[int(start) :]
