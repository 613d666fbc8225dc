"""Codecs: batch functions between pixels and latents, run inside Arrow tasks. Trained models plug in here.

A codec names the shapes it maps and whether it needs labels; no call is tried twice to find that out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import arrays
from vectide.operators import layout, moments
from vectide.sources import images


@dataclass(frozen=True)
class LatentShape:
    """A 2-D latent (channels, height, width), or a 1-D one (tokens, channels)."""

    sizes: tuple[int, ...]

    def __post_init__(self):
        if len(self.sizes) not in (2, 3) or min(self.sizes) < 1:
            raise ValueError(f"no latent shape: {self.sizes}")

    @property
    def places(self) -> int:
        return int(np.prod(self.sizes))


class LatentCodec(Protocol):
    label_aware: bool

    def encode(self, x: np.ndarray, labels: np.ndarray | None) -> np.ndarray: ...

    def decode(self, z: np.ndarray, labels: np.ndarray | None) -> np.ndarray: ...


class MatrixCodec:
    """A codec that is one orthogonal matrix."""

    label_aware = False

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def encode(self, x, labels=None):
        return x @ self.matrix.T

    def decode(self, z, labels=None):
        return z @ self.matrix


def _permutation(index: list[int]) -> np.ndarray:
    m = np.zeros((len(index), len(index)))
    m[np.arange(len(index)), index] = 1
    return m


REGISTRY = {
    "pixel_shuffle": lambda c=1, h=8, w=8, f=2: MatrixCodec(_permutation(arrays.pixel_unshuffle(c, h, w, f))),
    "block_dct": lambda h=8, w=8: MatrixCodec(layout.dct2(h, w)),
    "haar": lambda h=8, w=8, levels=3: MatrixCodec(layout.haar2(h, w, levels)),
}


def register(name: str, make) -> None:
    if name in REGISTRY:
        raise ValueError(f"codec {name} is there already")
    REGISTRY[name] = make


def from_config(config: dict) -> LatentCodec:
    """The codec of {'target': name, 'params': {...}}."""
    if config.get("target") not in REGISTRY:
        raise ValueError(f"unknown codec {config.get('target')}")
    return REGISTRY[config["target"]](**config.get("params") or {})


def apply(df: DataFrame, config: dict, step: str, vec_col: str = "v", name: str = "z", label_col: str | None = None) -> DataFrame:
    """Adds encode(v) or decode(v); each task makes the codec once, and Arrow batches are its batches."""
    if step not in ("encode", "decode"):
        raise ValueError(f"unknown step {step}")
    if from_config(config).label_aware and label_col is None:
        raise ValueError("this codec needs labels")
    names, at = [*df.columns, name], df.columns.index(vec_col)
    label_at = df.columns.index(label_col) if label_col else None

    def run(batches):
        codec = from_config(config)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                labels = batch.column(label_at).to_numpy(zero_copy_only=False) if label_at is not None and codec.label_aware else None
                z = getattr(codec, step)(x, labels)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


_MADE: dict[str, object] = {}


def _model(name: str, make):
    """The model of a name, made once in a worker process."""
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def taps(df: DataFrame, model: str, make: Callable[[], Callable[[np.ndarray], dict[str, np.ndarray]]], points: list[str], vec_col: str = "v", name: str = "taps") -> DataFrame:
    """Adds a struct of the outputs that a model has at several named points; each batch goes through the model once.

    make() gives the model, a function of a matrix (a row each) to the points' matrices; a worker process makes the model of a name once. A
    point that the model lacks is an error; a null vector has null outputs.
    """
    kind = T.StructType([T.StructField(p, T.ArrayType(T.DoubleType())) for p in points])
    at, names = df.columns.index(vec_col), [*df.columns, name]

    def run(batches):
        f = _model(model, make)
        for batch in batches:
            column = batch.column(at)
            full = column.is_valid().to_numpy(zero_copy_only=False)
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
            got = f(x.reshape(int(full.sum()), -1)) if full.any() else {p: np.zeros((0, 0)) for p in points}
            if missing := set(points) - set(got):
                raise ValueError(f"the model has no points {sorted(missing)}")
            parts = []
            for p in points:
                z = got[p]
                off = np.concatenate([[0], np.cumsum(full * z.shape[1])])
                parts.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(z.ravel()), mask=pa.array(~full)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(parts, names=points)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def activations(images_: DataFrame, config: dict, size: int, name: str = "z") -> DataFrame:
    """path and z: the codec's encoding of decoded images (path, height, width, pixels), prepared at size by a crop, in path order."""
    x = images.prepared(images_, size)
    return apply(x, config, "encode", "x", name).select("path", name).orderBy("path")


def frechet_of_paths(spark: SparkSession, a: str, b: str, config: dict, size: int, count: int | None = None) -> float:
    """Frechet distance between two paths: a summary of moments.save_summary (a name in .parquet) or of mu and sigma (in .npz), or a flat folder of images (the
    first count of them), prepared at size by a crop and encoded by the codec of config. A missing path and an unknown codec are errors.
    """
    for p in (a, b):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            raise ValueError(f"no such path: {p}")
    if from_config(config).label_aware:
        raise ValueError("images of a path have no labels")

    def of(p: str) -> moments.Summary:
        if p.endswith(".parquet"):
            return moments.load_summary(spark, p)
        if p.endswith(".npz"):
            return moments.load_arrays(spark, p)
        names = images.scan_flat(spark, p, count).select(F.substring_index("path", "/", -1).alias("name"))
        x = images.decode_rgb(spark, p, names)
        return moments.summary(apply(images.prepared(x, size), config, "encode", "x"), "z")

    return moments.frechet(of(a), of(b))
