"""Column expressions on vectors, kept as flat arrays of double in row-major order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = lambda: F.lit(0.0)


def total(v: Column) -> Column:
    return F.aggregate(v, ZERO(), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    """Mean over all places."""
    return total(v) / F.size(v)


def scale(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x * s)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sq_dist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mse(a: Column, b: Column) -> Column:
    return sq_dist(a, b) / F.size(a)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.zip_with(a, b, lambda x, y: (1 - t) * x + t * y)


def slerp(a: Column, b: Column, t: Column | float) -> Column:
    """Spherical interpolation of the vectors as they are; a straight line where they are nearly parallel."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    cosine = dot(a, b) / ((norm(a) + 1e-7) * (norm(b) + 1e-7))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    sine = F.sin(angle)
    curved = F.zip_with(a, b, lambda x, y: x * (F.sin((1 - t) * angle) / (sine + 1e-7)) + y * (F.sin(t * angle) / (sine + 1e-7)))
    return F.when(sine < 1e-6, lerp(a, b, t)).otherwise(curved)


def half_mask(a: Column, b: Column, rows: int, row_size: int) -> Column:
    """The first half of the rows from b, the rest from a."""
    cut = rows // 2 * row_size
    return F.concat(F.slice(b, 1, cut), F.slice(a, cut + 1, rows * row_size - cut))


def gather(v: Column, index: list[int]) -> Column:
    """v[i] for each i of a fixed index list."""
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(v, i + 1))


def uniform(i: Column) -> Column:
    """Reproducible uniform in [0, 1) from a whole number under about 8e9."""
    return ((i.cast("long") * 1103515245 + 12345) % 2147483648) / F.lit(2147483648.0)


def normal(i: Column) -> Column:
    """Reproducible standard normal from two uniforms."""
    u1 = 1 - uniform(2 * i)
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * uniform(2 * i + 1))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def entropy(p: Column, eps: float = 0.0) -> Column:
    """-sum p ln(p + eps); p = 0 adds nothing."""
    return -F.aggregate(p, ZERO(), lambda a, x: a + F.when(x > 0, x * F.ln(x + eps)).otherwise(0.0))


def indexed(v: Column, f) -> Column:
    """f(value, place from 0)."""
    return F.transform(v, f)
