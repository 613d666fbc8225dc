"""Keyed permutations of row numbers, so that an epoch in random order needs no sort and can go on where it stopped.

A Feistel network over a * b >= n places, where a and b are about the square root of n: each round moves one half by a hash of the
other, so it can be undone. What falls beyond n walks on until it is within, which keeps it a permutation of 0 to n - 1; at most a
places are beyond n, so few rows walk.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6


def _hash(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _once(x: np.ndarray, a: int, b: int, keys: list[int], back: bool) -> np.ndarray:
    """One pass over the a * b places."""
    left, right = x // b, x % b
    for k in reversed(range(len(keys))) if back else range(len(keys)):
        sign = -1 if back else 1
        if k % 2:
            left = (left + sign * (_hash(right, keys[k]) % np.uint64(a)).astype(np.int64)) % a
        else:
            right = (right + sign * (_hash(left, keys[k]) % np.uint64(b)).astype(np.int64)) % b
    return left * b + right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of row numbers 0 to n - 1 (back: row numbers of places); seeds count modulo 2**64."""
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    b = max(-(-n // a), 1)
    keys = [int(k) for k in _hash(np.arange(ROUNDS), seed * 1_000_003 + 12345)]
    out = _once(np.asarray(x, np.int64), a, b, keys, back)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = _once(out[far], a, b, keys, back)
    return out


def place(number: Column, n: int, seed: int) -> Column:
    """The place in the epoch of a seed of the row of each number, 0 to n - 1."""

    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return of(number)


def shuffled_batches(rows: DataFrame, number: str, n: int, seed: int, size: int, done: int = 0, drop_last: bool = True) -> DataFrame:
    """rows with batch and slot of an epoch, without the done first batches, and the last one if it isn't full; number: 0 to n - 1."""
    at = rows.withColumn("__at", place(F.col(number), n, seed))
    at = at.where((F.col("__at") >= done * size) & (F.col("__at") < (n // size * size if drop_last else n)))
    return at.select(*rows.columns, F.floor(F.col("__at") / size).alias("batch"), (F.col("__at") % size).cast("int").alias("slot"))
