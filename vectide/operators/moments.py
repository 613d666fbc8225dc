"""Mean vectors, covariance matrices and the Frechet distance between distributions.

A task sums its rows' outer products with matrix products over Arrow batches. Its sums are cut into blocks of SIZE x SIZE numbers (those
on and above the diagonal), and each block is merged with those of other tasks in a tree, FAN at a time: a task of the tree holds so
many blocks, whatever the dimension and the number of tasks. What moves depends on the dimension and the number of tasks, not on the rows.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.shared import checkpointed

SIZE, FAN = 256, 8


@dataclass
class Summary:
    n: int
    mu: np.ndarray
    sigma: np.ndarray


def _partials(batches, size: int):
    """Blocks of a task's count, means and sums of products about them, for each column, of its rows that are not null."""
    from pyspark import TaskContext

    held: dict[int, tuple] = {}
    for batch in batches:
        for k in range(batch.num_columns):
            column = batch.column(k).drop_null()
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
                mean = x.mean(0)  # sums about the batch mean, merged exactly below
                part = (len(x), mean, mean, (x - mean).T @ (x - mean))
                held[k] = _merge(*held[k], *part) if k in held else part
    for k, (n, mu, _, m2) in held.items():
        edges = range(0, len(mu), size)
        for i in edges:  # a batch a block: the largest is size x size
            for j in edges[i // size :]:
                yield from _row((k, i, j), TaskContext.get().partitionId(), (n, mu[i : i + size], mu[j : j + size], m2[i : i + size, j : j + size])).to_batches()


PARTIAL = "k int, i int, j int, part long, n long, mu_i binary, mu_j binary, m2 binary"


def _row(block: tuple[int, int, int], part: int, sums: tuple) -> pa.Table:
    values = [*block, part, sums[0], *[np.ascontiguousarray(x).tobytes() for x in sums[1:]]]
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()] * 3
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in PARTIAL.split(", ")])


def _sums(table: pa.Table, at: int) -> tuple:
    mu_i, mu_j, m2 = (np.frombuffer(table[c][at].as_buffer()) for c in ("mu_i", "mu_j", "m2"))
    return table["n"][at].as_py(), mu_i, mu_j, m2.reshape(len(mu_i), len(mu_j))


def _merge(n, mu_i, mu_j, m2, k, nu_i, nu_j, k2):
    """Count, means and sums of products of rows with those of others; of a block, its rows' and its columns' means."""
    if len(mu_i) != len(nu_i) or len(mu_j) != len(nu_j):
        raise ValueError("vectors of different dimensions")
    d_i, d_j = nu_i - mu_i, nu_j - mu_j
    return n + k, mu_i + d_i * (k / (n + k)), mu_j + d_j * (k / (n + k)), m2 + k2 + np.outer(d_i, d_j) * (n * k / (n + k))


def merge_tree(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Partial sums (PARTIAL) merged to one row for each block of a column: fan of a block, by number of their part, at a time."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        out = _sums(t, 0)
        for at in range(1, t.num_rows):
            out = _merge(*out, *_sums(t, at))
        return _row(tuple(t[c][0].as_py() for c in "kij"), t["part"][0].as_py() // fan, out)

    parts = checkpointed(parts)  # the number of levels is that of the parts
    most = parts.agg(F.max("part")).first()[0] or 0
    while most:
        most //= fan
        parts = parts.groupBy("k", "i", "j", F.floor(F.col("part") / fan).alias("above")).applyInArrow(lambda t: add(t), PARTIAL)
    return parts


def _merged(df: DataFrame, columns: tuple[str, ...], size: int) -> DataFrame:
    vectors = df.select(*[F.col(c).cast("array<double>").alias(f"c{k}") for k, c in enumerate(columns)])
    return merge_tree(vectors.mapInArrow(lambda batches: _partials(batches, size), PARTIAL))


def summaries(df: DataFrame, *columns: str, size: int = SIZE) -> list[Summary]:
    """Count, mean and sample covariance (over n - 1) of vector columns, in one pass; null vectors are left out. One matrix a column reaches the driver."""
    got: dict[int, dict] = {}
    for r in _merged(df, columns, size).toLocalIterator():  # a block at a time
        mu_i, mu_j = np.frombuffer(r.mu_i), np.frombuffer(r.mu_j)
        got.setdefault(r.k, {})[r.i, r.j] = r.n, mu_i, np.frombuffer(r.m2).reshape(len(mu_i), len(mu_j))
    if len(got) < len(columns):
        raise ValueError("no vectors")
    out = []
    for k in range(len(columns)):
        n = got[k][0, 0][0]
        mu = np.concatenate([mu for (i, j), (_, mu, _) in sorted(got[k].items()) if i == j])
        sigma = np.full((len(mu), len(mu)), np.nan)
        for (i, j), (*_, m2) in got[k].items():
            if n > 1:
                sigma[i : i + len(m2), j : j + m2.shape[1]] = m2 / (n - 1)
                sigma[j : j + m2.shape[1], i : i + len(m2)] = m2.T / (n - 1)
        out.append(Summary(n, mu, sigma))
    return out


def summary(df: DataFrame, vec_col: str) -> Summary:
    """summaries() of one column."""
    return summaries(df, vec_col)[0]


def covariance(df: DataFrame, vec_col: str, size: int = SIZE) -> DataFrame:
    """i, j, cov: the sample covariance as rows, made from the merged blocks; nothing goes through the driver."""

    def rows(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at in range(t.num_rows):
                n, mu_i, mu_j, m2 = _sums(t, at)
                cov = m2 / (n - 1) if n > 1 else np.full_like(m2, np.nan)
                i, j = (x.ravel() for x in np.indices(cov.shape) + np.array([t["i"][at].as_py(), t["j"][at].as_py()])[:, None, None])
                yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "cov": cov.ravel()})
                if t["i"][at].as_py() != t["j"][at].as_py():  # the other half
                    yield pa.RecordBatch.from_pydict({"i": pa.array(j, pa.int32()), "j": pa.array(i, pa.int32()), "cov": cov.ravel()})

    return _merged(df, (vec_col,), size).mapInArrow(rows, "i int, j int, cov double")


def save_summary(spark, s: Summary, path: str) -> None:
    spark.createDataFrame([(s.n, s.mu.tolist(), s.sigma.tolist())], "n long, mu array<double>, sigma array<array<double>>").write.mode("errorifexists").parquet(path)


def load_summary(spark, path: str) -> Summary:
    r = spark.read.parquet(path).first()
    return Summary(r.n, np.array(r.mu), np.array(r.sigma))


def load_arrays(spark, path: str) -> Summary:
    """Summary of an NPZ archive of mu and sigma, read by Spark; its count is not known (0)."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with np.load(io.BytesIO(data)) as f:
        return Summary(0, np.asarray(f["mu"], float), np.asarray(f["sigma"], float))


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return (v * np.sqrt(np.clip(w, 0, None))) @ v.T


def frechet(a: Summary, b: Summary, eps: float = 1e-6) -> float:
    """|mu difference|^2 + tr A + tr B - 2 tr sqrt(A B), by the symmetric form of the root's trace."""
    if a.mu.shape != b.mu.shape or a.sigma.shape != b.sigma.shape:
        raise ValueError("distributions of different dimensions")
    s1, s2 = a.sigma, b.sigma
    half = _root(s1)
    values = np.linalg.eigvalsh(half @ s2 @ half)
    if not np.isfinite(values).all():
        half = _root(s1 + eps * np.eye(len(s1)))
        values = np.linalg.eigvalsh(half @ (s2 + eps * np.eye(len(s2))) @ half)
    delta = a.mu - b.mu
    return float(delta @ delta + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.clip(values, 0, None)).sum())
