"""Ordered folds as parallel prefix scans of affine maps.

A state that each row changes by v <- a * v + b is the composition of the rows' maps, and compositions can be made of any runs of rows
first. Rows are sorted by key and order over all tasks; each task composes the runs of its keys with array operations; the runs of a
key, at most one a task, are composed in groups of FAN. A scan goes the way back too: each run gets the state before it, and its
rows theirs. So no key is one task, however many rows it has, and no task gets more than FAN runs of a key.

Several states are folded in one pass. A row whose map is null leaves its state as it is; null keys are keys and null places come first;
rows of a key at one place are taken in any order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.functions.shared import checkpointed

FAN = 64
#: Name of a state: its maps' factor and summand, and its value before the first row.
States = dict[str, tuple[Column, Column, float]]


def composed(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composition of each run of maps (rows; a column for each state) that begins at starts: neighbours first, then pairs of them."""
    run = np.zeros(len(a), np.int64)
    run[starts] = 1
    run = np.cumsum(run) - 1
    while len(run) > len(starts):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - first[run]
        left = np.flatnonzero((place % 2 == 0))
        pair = left[np.append(run[1:] == run[:-1], False)[left]]
        b[pair], a[pair] = a[pair + 1] * b[pair] + b[pair + 1], a[pair + 1] * a[pair]
        a, b, run = a[left], b[left], run[left]
    return a, b


def scanned(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The composition of each row's map with all before it in its run, by doubling distances."""
    first = np.zeros(len(a), np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    place = np.arange(len(a)) - first
    step = 1
    while (place >= step).any():
        at = np.flatnonzero(place >= step)
        b[at], a[at] = a[at] * b[at - step] + b[at], a[at] * a[at - step]
        step *= 2
    return a, b


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _maps(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands, (rows, states); a map with a null is none."""
    both = [[table[f"{x}{k}"].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for k in range(n)] for x in "ab"]
    a, b = (np.stack(x, 1) if n else np.zeros((table.num_rows, 0)) for x in both)
    none = np.zeros(a.shape, bool)
    for k in range(n):
        none[:, k] = table[f"a{k}"].is_null().to_numpy() | table[f"b{k}"].is_null().to_numpy()
    return np.where(none, 1.0, a), np.where(none, 0.0, b)


def _table(keys: pa.Table, more: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.Table:
    for name, x in (more | {f"a{k}": x for k, x in enumerate(a.T)} | {f"b{k}": x for k, x in enumerate(b.T)}).items():
        keys = keys.append_column(name, pa.array(x))
    return keys


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """One row for each key of a task's sorted rows: the task, and the composition of its maps."""
    from pyspark import TaskContext

    task, held = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select([*keys, *[f"{x}{k}" for x in "ab" for k in range(n)]])
        table = pa.concat_tables([held, table.cast(held.schema)]) if held else table
        starts = _starts(table, keys)
        a, b = composed(*_maps(table, n), starts)
        table = _table(table.select(keys).take(pa.array(starts)), {}, a, b)
        held, done = table.slice(table.num_rows - 1), table.slice(0, table.num_rows - 1)  # the last key may go on
        yield from _table(done.select(keys), {"run": np.full(done.num_rows, task, "i8")}, *_maps(done, n)).to_batches()
    if held:
        yield from _table(held.select(keys), {"run": np.full(1, task, "i8")}, *_maps(held, n)).to_batches()


def _sorted(df: DataFrame, keys: list[str], order: str, states: States) -> DataFrame:
    maps = [c.cast("double").alias(f"{x}{k}") for k, (a, b, _) in enumerate(states.values()) for x, c in (("a", a), ("b", b))]
    return df.select(*keys, F.col(order), *maps).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)


def _kinds(df: DataFrame, keys: list[str], n: int, more: str) -> T.StructType:
    fields = ", ".join([more, *[f"{x}{k} double" for x in "ab" for k in range(n)]])
    return T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(fields).fields])


def _levels(runs: DataFrame, keys: list[str], n: int, fan: int) -> list[DataFrame]:
    """Runs, runs of up to fan of them, and so on, until each key has one."""
    kind = _kinds(runs, keys, n, "run long")

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("run")
        a, b = composed(*_maps(t, n), np.zeros(1, np.int64))
        return _table(t.select(keys).slice(0, 1), {"run": np.array([t["run"][0].as_py() // fan])}, a, b)

    out = [checkpointed(runs)]
    most = out[0].agg(F.max("run")).first()[0] or 0
    while most:
        most //= fan
        out.append(out[-1].groupBy(*keys, F.floor(F.col("run") / fan).alias("above")).applyInArrow(lambda t: up(t), kind))
    return out


def affine_fold(df: DataFrame, keys: list[str], order: str, states: States, fan: int = FAN) -> DataFrame:
    """keys and each state after all rows of the key."""
    n = len(states)
    runs = _sorted(df, keys, order, states).mapInArrow(lambda batches: _runs(batches, keys, n), _kinds(df, keys, n, "run long"))
    last = _levels(runs, keys, n, fan)[-1]
    return last.select(*keys, *[(F.col(f"a{k}") * F.lit(float(start)) + F.col(f"b{k}")).alias(name) for k, (name, (*_, start)) in enumerate(states.items())])


def affine_scan(df: DataFrame, keys: list[str], order: str, states: States, fan: int = FAN) -> DataFrame:
    """keys, order and each state after the row."""
    n = len(states)
    # Written before it is read twice: the ranges come from a sample, which another run would draw anew.
    rows = checkpointed(_sorted(df, keys, order, states).withColumn("run", F.spark_partition_id().cast("long")))
    levels = _levels(rows.drop("run").mapInArrow(lambda batches: _runs(batches, keys, n), _kinds(df, keys, n, "run long")), keys, n, fan)
    kind = _kinds(df, keys, n, "run long")

    def down(t: pa.Table, before: pa.Table) -> pa.Table:
        """Each run with the composition of all maps of its key before it."""
        if not (t.num_rows and before.num_rows):
            return to_arrow_schema(kind).empty_table()
        t = t.sort_by("run")
        a, b = (np.concatenate(x) for x in zip(_maps(before, n), _maps(t.slice(0, t.num_rows - 1), n)))
        return _table(t.select([*keys]), {"run": t["run"].combine_chunks().to_numpy(zero_copy_only=False)}, *scanned(a, b, np.zeros(1, np.int64)))

    top = levels[-1].select(*keys, "run", *[F.lit(v).alias(f"{x}{k}") for x, v in (("a", 1.0), ("b", 0.0)) for k in range(n)])
    for level in reversed(levels[:-1]):
        own = level.groupBy(*keys, F.floor(F.col("run") / fan).alias("above"))
        top = own.cogroup(top.withColumnRenamed("run", "above").groupBy(*keys, "above")).applyInArrow(lambda t, u: down(t, u), kind)

    schema = T.StructType([*[df.schema[k] for k in keys], df.schema[order], *[T.StructField(s, T.DoubleType()) for s in states]])
    arrow, first = to_arrow_schema(schema), {name: float(start) for name, (*_, start) in states.items()}

    def finish(t: pa.Table, before: pa.Table) -> pa.Table:
        if not (t.num_rows and before.num_rows):
            return arrow.empty_table()
        t = t.take(pc.sort_indices(t, sort_keys=[(order, "ascending")], null_placement="at_start"))
        a, b = (np.concatenate(x) for x in zip(_maps(before, n), _maps(t, n)))
        a, b = (x[1:] for x in scanned(a, b, np.zeros(1, np.int64)))
        t = t.select([*keys, order])
        for k, (name, start) in enumerate(first.items()):
            t = t.append_column(name, pa.array(a[:, k] * start + b[:, k]))
        return t.cast(arrow)

    return rows.groupBy(*keys, "run").cogroup(top.groupBy(*keys, "run")).applyInArrow(lambda t, u: finish(t, u), schema)

