"""Reshapes and separable transforms of whole vectors by fixed tables, one matrix product an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectide.functions.arrays import dct_matrix, haar_matrix


def linear(df: DataFrame, matrix: np.ndarray, vec_col: str = "v", name: str = "z") -> DataFrame:
    """Adds matrix @ vector; the matrix is a fixed table of the operator, not data."""
    names, at = [*df.columns, name], df.columns.index(vec_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) @ matrix.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def dct2(h: int, w: int) -> np.ndarray:
    """2-D DCT of a flat h x w image as one matrix; its transpose is the inverse."""
    return np.kron(np.array(dct_matrix(h)), np.array(dct_matrix(w)))


def masked_dct(h: int, w: int, mask: list[int]) -> np.ndarray:
    """DCT, mask, inverse DCT."""
    m = dct2(h, w)
    return m.T @ (np.array(mask, float)[:, None] * m)


def haar2(h: int, w: int, levels: int) -> np.ndarray:
    """Haar pyramid of a flat image: each level splits the low-low quarter again. Orthogonal, so the transpose inverts it."""
    out = np.eye(h * w)
    for k in range(levels):
        a, b = h >> k, w >> k
        if a % 2 or b % 2:
            raise ValueError("side not divisible")
        step = np.eye(h * w)
        places = [y * w + x for y in range(a) for x in range(b)]
        step[np.ix_(places, places)] = np.kron(np.array(haar_matrix(a)), np.array(haar_matrix(b)))
        out = step @ out
    return out
