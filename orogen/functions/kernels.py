"""Radial kernels as column expressions: values, gradients, mixed second derivatives.

r is the distance in four coordinates, d the difference of the first three, s the shape parameter. The gradient at the second
point is minus that at the first; the second derivative is taken once at each point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CUBIC, GAUSSIAN, MULTIQUADRIC, MULTIQUADRIC_CUBIC = "r3", "Gaussian", "Multiquadratics", "Multiquadratics3"
THIN_PLATE, INVERSE_MULTIQUADRIC, LINEAR, WENDLAND, MATERN = "Thin Plate Spline", "Inverse Multiquadratics", "r", "WendlandC2", "MaternC4"
KERNELS = (CUBIC, GAUSSIAN, MULTIQUADRIC, MULTIQUADRIC_CUBIC, INVERSE_MULTIQUADRIC, THIN_PLATE, LINEAR, WENDLAND, MATERN)
AXES = "xyz"


class LinearDerivativeUnavailable(ValueError):
    """The linear kernel has values only."""


@dataclass(frozen=True)
class Pair:
    """Two points: d is the struct of their differences in x, y, z, r their distance."""

    d: tuple[Column, Column, Column]
    r: Column


def pair(a: str, b: str) -> Pair:
    """The pair of two struct columns with fields x, y, z, c."""
    d = [F.col(f"{a}.{k}") - F.col(f"{b}.{k}") for k in "xyzc"]
    return Pair((d[0], d[1], d[2]), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3]))


def value(kernel: str, p: Pair, s: float) -> Column:
    r, q = p.r, F.lit(s) + p.r * p.r
    return {
        CUBIC: lambda: r * r * r,
        GAUSSIAN: lambda: F.exp(-(s * s) * r * r),
        MULTIQUADRIC: lambda: F.sqrt(q),
        MULTIQUADRIC_CUBIC: lambda: q * F.sqrt(q),
        INVERSE_MULTIQUADRIC: lambda: 1 / F.sqrt(q),
        THIN_PLATE: lambda: F.when(r > 0, r * r * r * r * F.ln(r)).otherwise(0.0),
        LINEAR: lambda: r,
        WENDLAND: lambda: F.when(r > s, 0.0).otherwise(F.pow(1 - r / s, F.lit(4)) * (1 + 4 * r / s)),
        MATERN: lambda: F.exp(-s * r) * (3 + 3 * s * r + s * s * r * r),
    }[kernel]()


def _slope(kernel: str, p: Pair, s: float) -> Column:
    """The factor of d in the gradient."""
    r, q = p.r, F.lit(s) + p.r * p.r
    if kernel == LINEAR:
        raise LinearDerivativeUnavailable(kernel)
    return {
        CUBIC: lambda: 3 * r,
        GAUSSIAN: lambda: -2 * s * s * F.exp(-(s * s) * r * r),
        MULTIQUADRIC: lambda: 1 / F.sqrt(q),
        MULTIQUADRIC_CUBIC: lambda: 3 * F.sqrt(q),
        INVERSE_MULTIQUADRIC: lambda: -1 / (q * F.sqrt(q)),
        THIN_PLATE: lambda: F.when(r > 0, r * r + 4 * r * r * F.ln(r)).otherwise(0.0),
        WENDLAND: lambda: F.when(r > s, 0.0).otherwise(20 * F.pow(r - s, F.lit(3)) / s**5),
        MATERN: lambda: -(s * s) * F.exp(-s * r) * (1 + s * r),
    }[kernel]()


def _curve(kernel: str, p: Pair, s: float) -> Column:
    """The slope of _slope over r, the factor of d d' in the second derivative; 0 where it has no limit at r = 0."""
    r, q = p.r, F.lit(s) + p.r * p.r
    return {
        CUBIC: lambda: F.when(r > 0, 3 / r).otherwise(0.0),
        GAUSSIAN: lambda: 4 * s**4 * F.exp(-(s * s) * r * r),
        MULTIQUADRIC: lambda: -1 / (q * F.sqrt(q)),
        MULTIQUADRIC_CUBIC: lambda: 3 / F.sqrt(q),
        INVERSE_MULTIQUADRIC: lambda: 3 / (q * q * F.sqrt(q)),
        THIN_PLATE: lambda: F.when(r > 0, 6 + 8 * F.ln(r)).otherwise(0.0),
        WENDLAND: lambda: F.when((r > s) | (r == 0), 0.0).otherwise(60 * F.pow(r - s, F.lit(2)) / (s**5 * r)),
        MATERN: lambda: s**4 * F.exp(-s * r),
    }[kernel]()


def gradient(kernel: str, p: Pair, s: float) -> tuple[Column, Column, Column]:
    """At the first point."""
    slope = _slope(kernel, p, s)
    return tuple(slope * d for d in p.d)


def second(kernel: str, p: Pair, s: float, i: int, j: int) -> Column:
    """d2 / d(first point, axis i) d(second point, axis j)."""
    if kernel == LINEAR:
        raise LinearDerivativeUnavailable(kernel)
    r, q = p.r, F.lit(s) + p.r * p.r
    a, b = p.d[i], p.d[j]
    same = i == j
    others = [p.d[k] * p.d[k] for k in range(3) if k != i]
    one = 1.0 if same else 0.0
    gauss, mat = F.exp(-(s * s) * r * r), F.exp(-s * r)
    if kernel == WENDLAND:
        inner = -20 / (s**5 * r * r) * (s - r) * (s - r) * (-s * r * r + r * (4 * a * a + others[0] + others[1])) if same else -60 * a * b * (s - r) * (s - r) / (s**5 * r)
        return F.when(r > s, 0.0).when(r == 0, 20.0 / (s * s) * one).otherwise(inner)
    if kernel == THIN_PLATE:
        inner = -7 * a * a - others[0] - others[1] - 8 * a * a * F.ln(r) - 4 * r * r * F.ln(r) if same else -6 * a * b - 8 * a * b * F.ln(r)
        return F.when(r > 0, inner).otherwise(0.0)
    return {
        CUBIC: lambda: F.when(r > 0, -3 * (a * b / r + one * r)).otherwise(0.0),
        GAUSSIAN: lambda: (2 * s * s * one - 4 * s**4 * a * b) * gauss,
        MULTIQUADRIC: lambda: a * b / (q * F.sqrt(q)) - one / F.sqrt(q),
        MULTIQUADRIC_CUBIC: lambda: -3 * a * b / F.sqrt(q) - 3 * one * F.sqrt(q),
        INVERSE_MULTIQUADRIC: lambda: -3 * a * b / (q * q * F.sqrt(q)) + one / (q * F.sqrt(q)),
        MATERN: lambda: mat * (one * (s * s + r * s**3) - s**4 * a * b),
    }[kernel]()


def hessian(kernel: str, p: Pair, s: float) -> list[list[Column]]:
    return [[second(kernel, p, s, i, j) for j in range(3)] for i in range(3)]


#: Rows of the transform that leaves space as it is.
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def stretched(d: tuple[Column, Column, Column], m: Column) -> Pair:
    """The pair with difference d after the transform m, an array of nine; the fourth coordinate does not count. Its d is m' m d, so that
    values, and gradients at the first point, are those of any pair."""
    t = [sum((m[3 * i + j] * d[j] for j in range(1, 3)), m[3 * i] * d[0]) for i in range(3)]
    q = tuple(sum((m[3 * i + j] * t[i] for i in range(1, 3)), m[j] * t[0]) for j in range(3))
    return Pair(q, F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]))


def metric(m: Column) -> list[list[Column]]:
    """m' m of an array of nine."""
    return [[m[i] * m[j] + m[3 + i] * m[3 + j] + m[6 + i] * m[6 + j] for j in range(3)] for i in range(3)]


def along(p: Pair, u: tuple[Column, ...]) -> Column:
    return p.d[0] * u[0] + p.d[1] * u[1] + p.d[2] * u[2]


def at_first(kernel: str, p: Pair, s: float, u: tuple[Column, ...]) -> Column:
    """The derivative along u at the first point."""
    return _slope(kernel, p, s) * along(p, u)


def at_both(kernel: str, p: Pair, s: float, u: tuple[Column, ...], v: tuple[Column, ...], m: Column | None = None) -> Column:
    """The derivative along u at the first and along v at the second point, of a pair that m has stretched, if it has."""
    turned = u if m is None else [sum((g[j] * u[j] for j in range(1, 3)), g[0] * u[0]) for g in metric(m)]
    inner = turned[0] * v[0] + turned[1] * v[1] + turned[2] * v[2]
    return -(_slope(kernel, p, s) * inner + _curve(kernel, p, s) * along(p, u) * along(p, v))


def polynomial_along(order: int, x: Column, y: Column, z: Column, u: tuple[Column, ...], truncated: bool = False) -> list[Column]:
    """The derivatives of the polynomial basis along u."""
    a, b, c = u
    terms = [2 * x * a, 2 * y * b, 2 * z * c, y * a + x * b, z * a + x * c, z * b + y * c][: 6 * (order == 2)] + [a, b, c][: 3 * (order >= 1)]
    return terms + ([] if truncated else [F.lit(0.0)])


def polynomial(order: int, x: Column, y: Column, z: Column, truncated: bool = False) -> list[Column]:
    """The polynomial basis of order 0, 1 or 2, the constant last; a truncated basis has no constant."""
    terms = [x * x, y * y, z * z, x * y, x * z, y * z][: 6 * (order == 2)] + [x, y, z][: 3 * (order >= 1)]
    return terms + ([] if truncated else [F.lit(1.0)])
