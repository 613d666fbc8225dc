"""Codebook quantization: scores against a codebook, soft codewords and their losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vec


def load_codebook(codebook: DataFrame, code_col: str = "code_id", vec_col: str = "c", max_codes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a codebook, a model of fixed size; a table of over max_codes rows is refused."""
    got = codebook.select(code_col, vec_col).orderBy(code_col).limit(max_codes + 1).collect()
    if len(got) > max_codes:
        raise ValueError(f"codebook has more than {max_codes} entries")
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)


def codeword_scores(rows: DataFrame, codebook: DataFrame, vec_col: str = "v", name: str = "scores") -> DataFrame:
    """Adds the dot products with all codewords, in the order of their ids."""
    _, book = load_codebook(codebook)
    shared, at = rows.sparkSession.sparkContext.broadcast(book), rows.columns.index(vec_col)
    names = [*rows.columns, name]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) @ shared.value.T
                flat = pa.array(z.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def soft_codewords(rows: DataFrame, codebook: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Adds p (softmax of scores / temperature) and soft, the mean codeword under p."""
    _, book = load_codebook(codebook)
    shared, at = rows.sparkSession.sparkContext.broadcast(book), rows.columns.index("v")
    names = [*rows.columns, "p", "soft"]

    def run(batches):
        book = shared.value
        for batch in batches:
            if batch.num_rows:
                s = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) @ book.T / temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (p, p @ book)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=names)

    kind = T.ArrayType(T.DoubleType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("p", kind), T.StructField("soft", kind)]))


def entropy_loss(scored: DataFrame, temperature: float = 0.01, eps: float = 1e-5) -> DataFrame:
    """sample_entropy (mean entropy of rows), avg_entropy (entropy of the mean), loss (their difference)."""
    p = scored.select(vec.softmax(vec.scale(F.col("scores"), F.lit(1 / temperature))).alias("p")).select("p", vec.entropy(F.col("p")).alias("h"))
    sample = p.agg(F.avg("h").alias("sample_entropy"))
    means = p.select(F.posexplode("p").alias("code", "x")).groupBy("code").agg(F.avg("x").alias("m"))
    avg = means.agg((-F.sum(F.col("m") * F.ln(F.col("m") + eps))).alias("avg_entropy"))
    return sample.join(avg).withColumn("loss", F.col("sample_entropy") - F.col("avg_entropy"))  # one row each
