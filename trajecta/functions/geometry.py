"""Column builders for plane geometry: angles, distances, masks, grid cells, Hilbert order, step likelihood."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle(dx: Column, dy: Column) -> Column:
    """Degrees from the x axis in [0, 360), but -90 straight down and 0 for no move."""
    slope = F.degrees(F.atan(F.try_divide(dy, dx)))
    upright = F.when(dy > 0, 90.0).when(dy < 0, -90.0).otherwise(0.0)
    return F.when(dx.isNull() | dy.isNull(), F.lit(None).cast("double")).when(dx == 0, upright).when(dx < 0, slope + 180).when(slope < 0, slope + 360).otherwise(slope)


def angle_between(x1: Column, y1: Column, x2: Column, y2: Column, smallest: bool = False) -> Column:
    d = F.abs(angle(x2, y2) - angle(x1, y1))
    return F.least(d, 360 - d) if smallest else d


def vertex_angle(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column, smallest: bool = False) -> Column:
    """At (x1, y1), between the directions to the two others."""
    return angle_between(x0 - x1, y0 - y1, x2 - x1, y2 - y1, smallest)


def normalize_angle(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def in_ranges(a: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Whether the angle lies in any of the ranges, ends included; false for null."""
    n = normalize_angle(a)
    return F.coalesce(reduce(lambda p, q: p | q, [n.between(float(lo), float(hi)) for lo, hi in ranges]), F.lit(False))


def around(a: Column, allowed: float, deviation: float) -> Column:
    """Whether the angle is within deviation of allowed, across 0 too."""
    n, lo, hi = normalize_angle(a), (allowed - deviation) % 360, (allowed + deviation) % 360
    return F.coalesce(n.between(lo, hi) if lo <= hi else (n >= lo) | (n <= hi), F.lit(False))


def in_quadrants(dx: Column, dy: Column, rule: Sequence[int]) -> Column:
    """Quadrants 1 to 4, without the axes."""
    tests = {1: (dx > 0) & (dy > 0), 2: (dx < 0) & (dy > 0), 3: (dx < 0) & (dy < 0), 4: (dx > 0) & (dy < 0)}
    return F.coalesce(reduce(lambda p, q: p | q, [tests[q] for q in rule]), F.lit(False))


def select_moves(dx: Column, dy: Column, rule: Sequence[float], deviation: float | Sequence[float] | None = None) -> Column:
    """Moves by quadrants, or with deviations by angles."""
    if deviation is None:
        return in_quadrants(dx, dy, [int(r) for r in rule])
    each = [deviation] * len(rule) if isinstance(deviation, (int, float)) else list(deviation)
    return reduce(lambda p, q: p | q, [around(angle(dx, dy), a, d) for a, d in zip(rule, each, strict=True)])


def distance(dx: Column, dy: Column, kind: str = "euc") -> Column:
    if kind == "euc":
        return F.sqrt(dx * dx + dy * dy)
    if kind == "manhattan":
        return F.abs(dx) + F.abs(dy)
    if kind == "chebyshev":
        return F.greatest(F.abs(dx), F.abs(dy))
    raise ValueError(f"unknown distance {kind}")


def grid_cell(v: Column, lo: float, hi: float, n: int) -> Column:
    """Truncated toward zero, not clipped at the upper end."""
    return ((v - lo) / (hi - lo) * n).cast("int")


def cell_center(i: Column, lo: float, hi: float, n: int) -> Column:
    return lo + (i + 0.5) * (hi - lo) / n


def hilbert_index(x: Column, y: Column, p: int) -> Column:
    """Place on the Hilbert curve of 2^p x 2^p cells of whole x and y."""
    x, y, h = x.cast("long"), y.cast("long"), F.lit(0).cast("long")
    side = 1 << p
    for level in range(p - 1, -1, -1):
        s = 1 << level
        rx, ry = F.when(x.bitwiseAND(s) > 0, 1).otherwise(0), F.when(y.bitwiseAND(s) > 0, 1).otherwise(0)
        h = h + F.lit(s).cast("long") * s * ((3 * rx).bitwiseXOR(ry))
        turned = (ry == 0) & (rx == 1)
        fx, fy = F.when(turned, side - 1 - x).otherwise(x), F.when(turned, side - 1 - y).otherwise(y)
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
    return h


def asymmetric_normal(v: Column, mu: float, left: float, right: float) -> Column:
    """Density that falls off by left below mu and by right above it."""
    peak = 2 / (math.sqrt(2 * math.pi) * (left + right))
    return peak * F.exp(-((v - mu) ** 2) / (2 * F.when(v < mu, left * left).otherwise(right * right)))
