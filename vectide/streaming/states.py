"""Streaming forms of the running-state operators: a small state a key, of which a trigger writes what its rows change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = 256


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that states of several variables need; for streams that the session starts afterwards."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    if stream.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError("states of several variables need the RocksDB state store: call use_rocksdb(spark) first")
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {schema}", "Update", "None")


def _ordered(rows: Iterator[pd.DataFrame], order: str, value: str) -> np.ndarray:
    """Values of a trigger's rows of one key in order; rows of equal order as they came."""
    parts = [(b[order].to_numpy(), b[value].to_numpy()) for b in rows]
    at, x = (np.concatenate(p) for p in zip(*parts))
    return x[np.argsort(at, kind="stable")]


class Ema(StatefulProcessor):
    """e <- decay * e + (1 - decay) * x, e starting as the first x."""

    def __init__(self, key: str, order: str, value: str, decay: float):
        self.key, self.order, self.value, self.decay = key, order, value, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "n long, ema double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = _ordered(rows, self.order, self.value).astype(float)
        n, e = self.state.get() or (0, x[0])
        # the state counts decay ** len(x), each row what is left of it after the later ones
        e = float(e * self.decay ** len(x) + (1 - self.decay) * (x @ self.decay ** np.arange(len(x) - 1, -1, -1.0)))
        self.state.update((n + len(x), e))
        yield pd.DataFrame({self.key: [key[0]], "n": [n + len(x)], "ema": [e]})


class Ring(StatefulProcessor):
    """A ring of the last codes in pages of PAGE slots, the count of each code in it, and how many rows and distinct codes there are.

    A trigger reads and writes the pages of the slots that its rows fill, and the counts of the codes that enter or leave.
    """

    def __init__(self, key: str, order: str, code: str, size: int, codes: int):
        self.key, self.order, self.code, self.size, self.codes = key, order, code, size, codes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, used long")
        self.pages = handle.getMapState("pages", "page int", "codes binary")
        self.counts = handle.getMapState("counts", "code long", "n long")

    def _swapped(self, start: int, new: np.ndarray) -> np.ndarray:
        """Puts codes into the slots from start on, around the ring, and returns those they replace."""
        slots = (start + np.arange(len(new))) % self.size
        old = np.zeros(len(new), np.int64)
        for page in np.unique(slots // PAGE).tolist():
            held = self.pages.getValue((page,))
            codes = np.frombuffer(held[0], np.int64).copy() if held else np.zeros(min(PAGE, self.size - page * PAGE), np.int64)
            mine = slots // PAGE == page
            old[mine] = codes[slots[mine] - page * PAGE]
            codes[slots[mine] - page * PAGE] = new[mine]
            self.pages.updateValue((page,), (codes.tobytes(),))
        return old

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _ordered(rows, self.order, self.code).astype(np.int64)
        n, used = self.seen.get() or (0, 1)  # the buffer's own code 0
        late = new[-self.size :]  # earlier rows of the trigger leave within it
        old = self._swapped((n + len(new) - len(late)) % self.size, late)
        code, place = np.unique(np.concatenate([late, old]), return_inverse=True)
        change = np.bincount(place, np.repeat([1, -1], [len(late), len(old)]), len(code)).astype(int)
        for c, d in zip(code.tolist(), change.tolist()):
            if d:
                held = self.counts.getValue((c,))
                before = held[0] if held else self.size if c == 0 else 0
                used += (before + d > 0) - (before > 0)
                self.counts.updateValue((c,), (before + d,))
        self.seen.update((n + len(new), used))
        yield pd.DataFrame({self.key: [key[0]], "n": [n + len(new)], "usage": [used / self.codes]})


def stream_ema(stream: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """key, n, ema after each trigger; rows of a key within a trigger are taken in order."""
    return _with_state(stream.select(key, order, value), key, Ema(key, order, value, decay), "n long, ema double")


def stream_running_moments(stream: DataFrame, key: str, value: str, momentum: float = 0.1) -> DataFrame:
    """key, mean, var: each trigger's rows of a key are one batch; the unbiased variance is stored."""

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, var = state.get if state.exists else (0.0, 1.0)
        x = pd.concat(list(batches))[value].astype(float)
        mean = (1 - momentum) * mean + momentum * float(x.mean())
        if len(x) > 1:
            var = (1 - momentum) * var + momentum * float(x.var(ddof=1))
        state.update((mean, var))
        yield pd.DataFrame({key: [k[0]], "mean": [mean], "var": [var]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, mean double, var double", "mean double, var double", "update", GroupStateTimeout.NoTimeout)


def stream_ring_usage(stream: DataFrame, key: str, order: str, code: str, size: int, codes: int) -> DataFrame:
    """key, n, usage after each trigger: distinct share of the last `size` codes, the buffer starting full of code 0; a null code is an error."""
    return _with_state(stream.select(key, order, F.col(code).cast("long").alias(code)), key, Ring(key, order, code, size, codes), "n long, usage double")


def ring_usage_of(spark: SparkSession, checkpoint: str, codes: int) -> DataFrame:
    """keys, usage: the last usages of all keys, averaged, from the state that a stream of stream_ring_usage has in its checkpoint folder."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return state.agg(F.count("*").alias("keys"), F.avg(F.col("value.used") / F.lit(float(codes))).alias("usage"))
