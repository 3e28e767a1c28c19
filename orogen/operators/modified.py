"""The modified kernel: a radial kernel that annihilates planes, from four unisolvent points and their Lagrange polynomials."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import FieldError
from . import dense


def unisolvent_points(groups: list[np.ndarray]) -> np.ndarray:
    """Four points (rows x, y, z) of the largest group, the first of equals: the ends of the widest axis and of the next one.

    If they share a coordinate, the last pick gives way to the group's first point that differs there; if there is none, the first pick
    is moved by 1e-3 on each flat axis.
    """
    group = max(groups, key=len, default=np.zeros((0, 3)))
    if len(group) < 4:
        raise FieldError("InvalidInputData", "no level has four points")
    ranges = np.ptp(group, axis=0)
    picks: list[int] = []
    for axis in range(3):
        others = [k for k in range(3) if k != axis]
        if all(ranges[axis] >= ranges[k] for k in others):
            second = others[0] if ranges[others[0]] >= ranges[others[1]] else others[1]
            main, side = (np.argsort(group[:, k], kind="stable") for k in (axis, second))
            for pick in (main[0], main[-1]):
                if int(pick) not in picks:
                    picks.append(int(pick))
            free = [int(i) for i in side if int(i) not in picks]
            picks += [free[0], free[-1]] if len(free) > 1 else free
    if len(picks) != 4:
        raise FieldError("InvalidInputData", "the axes of the largest level have equal ranges")
    chosen = group[picks].copy()
    flat = [k for k in range(3) if (chosen[:, k] == chosen[0, k]).all()]
    if flat:
        other = next((p for p in group if p[flat[0]] != chosen[0, flat[0]]), None)
        if other is None:
            chosen[3] = chosen[0]
            chosen[3, flat] += 1e-3
        else:
            chosen[3] = other
    return chosen


@dataclass
class ModifiedKernel:
    """K(p, q) less its interpolation by planes in both arguments. The points' own values count as 1. A stack of points, each for a model,
    takes stacked terms."""

    points: np.ndarray
    kernel: str
    shape: float
    transform: np.ndarray | None = None

    def __post_init__(self):
        one = np.ones((*self.points.shape[:-1], 1))
        whole = np.concatenate([self.points, one], axis=-1)
        size = abs(np.linalg.det(whole))
        if not (size > 0).all() or not np.isfinite(size).all():
            raise FieldError("InvalidInputData", "the four points lie in a plane")
        #: Columns are the polynomials' coefficients of x, y, z, 1.
        self.coefficients = np.linalg.inv(whole)
        self.terms = dense.Terms(np.arange(4), one[..., 0], np.concatenate([self.points, 0 * one], axis=-1), np.zeros(self.points.shape))
        self.between = dense.kernel_matrix(self.terms, self.terms, self.kernel, self.shape, self.transform)
        self.between[..., np.arange(4), np.arange(4)] = 1.0

    def planes(self, a: dense.Terms) -> np.ndarray:
        return dense.polynomial_matrix(a, 1) @ self.coefficients

    def matrix(self, a: dense.Terms, b: dense.Terms) -> np.ndarray:
        of = lambda x, y: dense.kernel_matrix(x, y, self.kernel, self.shape, self.transform)
        p, q = self.planes(a), np.swapaxes(self.planes(b), -1, -2)
        return of(a, b) - p @ of(self.terms, b) - of(a, self.terms) @ q + p @ self.between @ q
