"""Pairwise quality metrics on arrays, and SSIM on image batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vec


def pixel_range(v: Column, signed: bool) -> Column:
    """[-1, 1] (signed) or [0, 1] values to [0, 255]."""
    return F.transform(v, lambda x: (x + 1) * 127.5 if signed else x * 255.0)


def psnr(a: Column, b: Column, signed: bool = True) -> Column:
    """20 log10(255 / rmse) on values of 0 to 255; infinite for equal inputs.

    Values in [0, 1] passed with signed=True span 127.5 only, which adds 6.02 dB: a known quirk of published figures.
    """
    mse = vec.mse(pixel_range(a, signed), pixel_range(b, signed))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt(F.when(mse == 0, 1.0).otherwise(mse))))


def relative_mse(a: Column, b: Column) -> Column:
    return vec.mse(a, b) / vec.mean(F.transform(b, lambda x: x * x))


def mean_abs(a: Column, b: Column) -> Column:
    return vec.mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return x / x.sum()


def filtered(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Images (..., height, width) under a separable filter, where all of it lies inside; a side shorter than the filter stays as it is."""
    for axis in (-2, -1):
        n = x.shape[axis] - len(g) + 1
        if n > 0:
            x = sum(w * np.take(x, range(k, k + n), axis) if axis == -2 else w * x[..., k : k + n] for k, w in enumerate(g))
    return x


def ssim_scores(a: np.ndarray, b: np.ndarray, data_range: float = 255.0) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and its contrast-structure term of images (..., height, width), each a mean over places, by the published formula."""
    g = gaussian()
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    ma, mb = filtered(a, g), filtered(b, g)
    va, vb, cov = filtered(a * a, g) - ma * ma, filtered(b * b, g) - mb * mb, filtered(a * b, g) - ma * mb
    cs = (2 * cov + c2) / (va + vb + c2)
    return ((2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * cs).mean((-2, -1)), cs.mean((-2, -1))


def halved(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 values; an odd side has a row of zeros before it, which counts."""
    h, w = x.shape[-2:]
    x = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(h % 2, 0), (w % 2, 0)])
    return (x[..., ::2, ::2] + x[..., 1::2, ::2] + x[..., ::2, 1::2] + x[..., 1::2, 1::2]) / 4


#: Weights of the five scales.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def image_scores(a: np.ndarray, b: np.ndarray, data_range: float = 255.0) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and multi-scale SSIM of images (n, channels, height, width), or of videos (n, channels, frames, height, width) as means over frames.

    The scales' terms are multiplied for each channel, those under 0 as 0, and channels averaged then; multi-scale SSIM is NaN where a side is under 256.
    """
    if a.ndim == 5:
        n, c, t, h, w = a.shape
        one, many = image_scores(*(x.swapaxes(1, 2).reshape(n * t, c, h, w) for x in (a, b)), data_range)
        return one.reshape(n, t).mean(1), many.reshape(n, t).mean(1)
    first, cs = ssim_scores(a, b, data_range)
    if min(a.shape[-2:]) < 256:
        return first.mean(-1), np.full(len(a), np.nan)
    out, s = np.maximum(cs, 0) ** SCALES[0], first
    for k, weight in enumerate(SCALES[1:], 2):
        a, b = halved(a), halved(b)
        s, cs = ssim_scores(a, b, data_range)
        out = out * np.maximum(s if k == len(SCALES) else cs, 0) ** weight
    return first.mean(-1), out.mean(-1)


def with_ssim(df, a: str, b: str, shape: tuple[int, ...], values: int = 1 << 22):
    """df with ssim and ms_ssim of two flat columns (values 0 to 255) of one shape (channels, height, width) or (channels, frames, height, width).

    Whole Arrow batches are worked on, so many values at a time; a null image has null scores.
    """
    size = int(np.prod(shape))

    def run(batches):
        for batch in batches:
            step = max(values // size, 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, y = part.column(a), part.column(b)
                full = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))
                scores = np.zeros((2, part.num_rows))
                if len(full):
                    x, y = (c.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(full), *shape) for c in (x, y))
                    scores[:, full] = image_scores(x, y)
                none = np.ones(part.num_rows, bool)
                none[full] = False
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(s, mask=none) for s in scores]], names=[*part.schema.names, "ssim", "ms_ssim"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ssim", T.DoubleType()), T.StructField("ms_ssim", T.DoubleType())]))
