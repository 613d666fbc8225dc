"""Fixed index tables: permutations, position tables and schedules, made from their rules."""

from __future__ import annotations

import math


def zigzag(h: int, w: int) -> list[int]:
    """Flat places of an h x w grid along its anti-diagonals from the top left, turning at each."""
    return sorted(range(h * w), key=lambda i: (i // w + i % w, i % w if (i // w + i % w) % 2 == 0 else i // w))


def radial(h: int, w: int) -> list[int]:
    """Flat places by distance from the top left; ties by place."""
    return sorted(range(h * w), key=lambda i: ((i // w) ** 2 + (i % w) ** 2, i))


def pixel_unshuffle(c: int, h: int, w: int, f: int) -> list[int]:
    """Source place of each place of the (c f f, h / f, w / f) array."""
    return [(k * h + y * f + i) * w + x * f + j for k in range(c) for i in range(f) for j in range(f) for y in range(h // f) for x in range(w // f)]


def patchify(c: int, h: int, w: int, f: int) -> list[int]:
    """Source place of each place of the (tokens, c f f) array."""
    return [(k * h + y * f + i) * w + x * f + j for y in range(h // f) for x in range(w // f) for k in range(c) for i in range(f) for j in range(f)]


def tokens_to_map(t: int, c: int) -> list[int]:
    """Source place of each place of the (c, side, side) array of t tokens; t must be square."""
    if math.isqrt(t) ** 2 != t:
        raise ValueError("token count is no square")
    return [i * c + k for k in range(c) for i in range(t)]


def unpatchify(side: int, p: int, c: int) -> list[int]:
    """Source place (side * side tokens of p, p, c) of each place of the (c, side p, side p) image."""
    return [((y // p * side + x // p) * p * p + (y % p) * p + x % p) * c + k for k in range(c) for y in range(side * p) for x in range(side * p)]


def inverse(index: list[int]) -> list[int]:
    out = [0] * len(index)
    for place, source in enumerate(index):
        out[source] = place
    return out


def dct_matrix(n: int) -> list[list[float]]:
    """Orthonormal DCT-II."""
    return [[math.cos(math.pi / n * (j + 0.5) * k) * (math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n)) for j in range(n)] for k in range(n)]


def haar_matrix(n: int) -> list[list[float]]:
    """One level: sums, then differences of neighbours, each over sqrt(2)."""
    s = math.sqrt(0.5)
    rows = [[s if j // 2 == k else 0.0 for j in range(n)] for k in range(n // 2)]
    return rows + [[(s if j % 2 == 0 else -s) if j // 2 == k else 0.0 for j in range(n)] for k in range(n // 2)]


def keep_count(spec: int | float | str | None, n: int) -> int:
    """All (None or 'all'), a count, or a ratio of n rounded half to even; always 0 to n."""
    if spec is None or spec == "all":
        return n
    if isinstance(spec, str):
        raise ValueError(f"unknown keep {spec}")
    return max(0, min(n, round(spec * n) if isinstance(spec, float) else spec))


def square_side(n: int) -> int:
    if math.isqrt(n) ** 2 != n:
        raise ValueError("count is no square")
    return math.isqrt(n)


def band_edges(h: int, w: int, bands: int, schedule: list[float] | None = None, eps: float = 2.0**-23) -> list[float]:
    """Edges from 0 to a little (the number type's eps) over the greatest radius: even, or the first bands entries of a schedule scaled to it."""
    top, given = math.hypot(h - 1, w - 1), list(schedule or [])[:bands]
    edges = [0.0, *[x / max(max(given), 1e-6) * top for x in given]] if given else [top * k / bands for k in range(bands + 1)]
    edges[-1] += eps
    return edges


def band_mask(h: int, w: int, mode: str, keep: int, order: str = "zigzag") -> list[int]:
    """1 for kept places: the first (low) or last (high) keep ones of an order, or all but the keep highest (drop_high) or lowest (drop_low).

    With order "square" they are the square at the top left (low, drop_high) or bottom right; their number must be a square.
    """
    n = h * w
    keep = max(0, min(keep, n))
    if order == "square":
        return square_mask(h, w, square_side(keep if mode in ("low", "high") else n - keep), "low" if mode in ("low", "drop_high") else "high")
    places = zigzag(h, w) if order == "zigzag" else radial(h, w)
    if mode in ("drop_high", "drop_low") and keep <= 0:
        return [1] * n
    count = {"low": keep, "high": keep, "drop_high": n - keep, "drop_low": n - keep}[mode]
    chosen = places[:count] if mode in ("low", "drop_high") else places[n - count :]
    return [int(i in set(chosen)) for i in range(n)]


def square_mask(h: int, w: int, side: int, corner: str = "low") -> list[int]:
    """1 in the side x side square at the top left (low) or bottom right (high)."""
    return [int((y < side and x < side) if corner == "low" else (y >= h - side and x >= w - side)) for y in range(h) for x in range(w)]


def relative_position_index(h: int, w: int) -> list[list[int]]:
    """Index of each pair of window places (and a class token first) into a table of relative positions."""
    total = (2 * h - 1) * (2 * w - 1)
    cells = [(y, x) for y in range(h) for x in range(w)]
    inner = [[(a[0] - b[0] + h - 1) * (2 * w - 1) + a[1] - b[1] + w - 1 for b in cells] for a in cells]
    return [[total + 2] + [total] * len(cells)] + [[total + 1, *row] for row in inner]
