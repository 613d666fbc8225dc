"""Step-wise integrators as folds over a fixed time grid, one fold a row; and their schedules.

A velocity is a function of (state, time) that returns a Column; states are arrays of double.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Velocity = Callable[[Column, Column], Column]


def shifted(t: float, s: float) -> float:
    return s * t / (1 + (s - 1) * t)


def grid(n: int, s: float = 1.0) -> list[float]:
    """n + 1 times from 1 to 0, shifted."""
    return [shifted(1 - k / n, s) for k in range(n + 1)]


def sde_grid(n: int, last: float = 0.04) -> list[float]:
    """n times from 1 to last, then 0."""
    return [1 + (last - 1) * k / (n - 1) for k in range(n)] + [0.0]


def guided(cond: Velocity, uncond: Velocity, scale: float, low: float, high: float) -> Callable[[Column, Column, Column], Column]:
    """u + s (c - u) while low <= (time of the step) <= high, else c."""

    def f(x: Column, t: Column, step_time: Column) -> Column:
        c = cond(x, t)
        if scale <= 1:
            return c
        u = uncond(x, t)
        return F.when(step_time.between(low, high), F.zip_with(c, u, lambda a, b: b + scale * (a - b))).otherwise(c)

    return f


def _moved(x: Column, f: Column, dt: Column) -> Column:
    return F.zip_with(x, f, lambda a, b: a + dt * b)


def euler(x: Column, f, times: list[float], heun: bool = False) -> Column:
    """Euler over the grid; with heun the slope is averaged with that at the step's end, but for the last step."""
    ts, n = F.array(*map(F.lit, times)), len(times) - 1

    def step(s: Column, k: Column) -> Column:
        t, t2 = F.element_at(ts, k + 1), F.element_at(ts, k + 2)
        slope = f(s, t, t)
        end = _moved(s, slope, t2 - t)
        if not heun:
            return end
        better = F.zip_with(slope, f(end, t2, t), lambda a, b: (a + b) / 2)
        return F.when(k < n - 1, _moved(s, better, t2 - t)).otherwise(end)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, step)


def linear_path(t: Column) -> tuple[Column, Column, Column, Column]:
    """alpha, sigma and their derivatives."""
    return 1 - t, t, F.lit(-1.0), F.lit(1.0)


def cosine_path(t: Column) -> tuple[Column, Column, Column, Column]:
    h = math.pi / 2
    return F.cos(t * h), F.sin(t * h), -h * F.sin(t * h), h * F.cos(t * h)


def score(v: Column, x: Column, t: Column, path=linear_path) -> Column:
    """Score from velocity on a path, by places."""
    a, s, da, ds = path(t)
    ratio = a / da
    return F.zip_with(v, x, lambda p, q: (ratio * p - q) / (s * s - ratio * ds * s))


def diffusion(t: Column) -> Column:
    return 2 * t


def euler_maruyama(x: Column, f, times: list[float], noise: Callable[[Column, Column], Column]) -> Column:
    """Reverse SDE with drift v - t score and diffusion 2 t; noise(step, place); the last step has none."""
    ts, n = F.array(*map(F.lit, times)), len(times) - 1

    def step(s: Column, k: Column) -> Column:
        t, t2 = F.element_at(ts, k + 1), F.element_at(ts, k + 2)
        v = f(s, t, t)
        drift = F.zip_with(v, score(v, s, t), lambda a, b: a - 0.5 * diffusion(t) * b)
        moved = _moved(s, drift, t2 - t)
        spread = F.sqrt(F.abs(t2 - t)) * F.sqrt(diffusion(t))
        return F.when(k < n - 1, F.transform(moved, lambda y, i: y + spread * noise(k, i))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, step)


def _mix(x: Column, y: Column, p: float | None) -> tuple[Column, Column]:
    if p is None:
        return x, y
    x2 = F.zip_with(x, y, lambda a, b: p * a + (1 - p) * b)
    return x2, F.zip_with(y, x2, lambda a, b: p * a + (1 - p) * b)


def coupled(x: Column, y: Column, f: Velocity, times: list[float], p: float | None = 0.9, inverse: bool = False, trajectory: bool = False) -> Column:
    """Two coupled states: x moves by the slope at y, then y by that at the new x, then both mix.

    The inverse takes the grid backward, y before x, with the slopes at the times of the forward steps; it is exact only without mixing
    (p None) and from both end states. Gives struct(x, y), and with trajectory also xs, the x of every step.
    """
    ts, n = F.array(*map(F.lit, times)), len(times) - 1

    def step(s: Column, k: Column) -> Column:
        k = F.lit(n - 1) - k if inverse else k
        t, dt = F.element_at(ts, k + 1), F.element_at(ts, k + 2) - F.element_at(ts, k + 1)
        if inverse:
            b = _moved(s["y"], f(s["x"], t), -dt)
            a = _moved(s["x"], f(b, t), -dt)
        else:
            a = _moved(s["x"], f(s["y"], t), dt)
            b = _moved(s["y"], f(a, t), dt)
        a, b = _mix(a, b, p)
        parts = [a.alias("x"), b.alias("y")]
        return F.struct(*parts, F.concat(s["xs"], F.array(a)).alias("xs")) if trajectory else F.struct(*parts)

    start = [x.alias("x"), y.alias("y")] + ([F.array(x).alias("xs")] if trajectory else [])
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.struct(*start), step)


def betas(name: str, n: int, start: float = 1e-4, end: float = 2e-2) -> list[float]:
    """Beta schedules of n steps."""
    lin = lambda a, b: [a + (b - a) * k / (n - 1) for k in range(n)]
    if name == "linear":
        return [x * x for x in lin(math.sqrt(start), math.sqrt(end))]
    if name == "cosine":
        a = [math.cos((k / n + 8e-3) / (1 + 8e-3) * math.pi / 2) ** 2 for k in range(n + 1)]
        return [min(max(1 - a[k + 1] / a[k], 0.0), 0.999) for k in range(n)]
    if name == "sqrt_linear":
        return lin(start, end)
    if name == "sqrt":
        return [math.sqrt(x) for x in lin(start, end)]
    raise ValueError(f"unknown schedule {name}")


def betas_for_alpha_bar(n: int, bar: Callable[[float], float], most: float = 0.999) -> list[float]:
    return [min(1 - bar((k + 1) / n) / bar(k / n), most) for k in range(n)]


def ddim_timesteps(kind: str, n: int, steps: int) -> list[int]:
    """Steps of a schedule of n to visit, plus 1: evenly, or by squares up to 0.8 n."""
    if kind == "uniform":
        return [k + 1 for k in range(0, n, n // steps)]
    if kind == "quad":
        top = math.sqrt(n * 0.8)
        return [int((top * k / (steps - 1)) ** 2) + 1 for k in range(steps)]
    raise ValueError(f"unknown discretisation {kind}")


def cosine_schedule(base: float, final: float, total: int, warm: int = 0, start: float = 0.0, freeze: int = 0) -> list[float]:
    """Zeros while frozen, a line from start to base, then a half cosine to final."""
    lead = [0.0] * freeze + [start + (base - start) * k / max(warm - 1, 1) for k in range(warm)]
    rest = total - len(lead)
    return lead + [final + 0.5 * (base - final) * (1 + math.cos(math.pi * k / rest)) for k in range(rest)]


def rank_seed(seed: int, rank: int, world: int) -> tuple[int, int]:
    """Seeds of a process: of sampling, of evaluation."""
    return (seed + rank) * world // 2, seed + rank
