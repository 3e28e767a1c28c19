"""Interior-point solvers of small convex quadratic programs, one program in one task.

predictor_corrector: min x'Kx with Ax = b and Cx >= d. bounded: min x'Kx with b <= Ax <= b + r for a square A.
Both follow published primal-dual methods: a predictor step, a centring parameter from it, a corrector step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import FieldError

ITERATIONS = 300


@dataclass
class Solution:
    """x, the multipliers and slacks of the inequalities, how far an inequality may be missed, and the iterations."""

    x: np.ndarray
    dual: np.ndarray
    slack: np.ndarray
    tolerance: float
    iterations: int


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


def _step(v: np.ndarray, dv: np.ndarray, s: np.ndarray, ds: np.ndarray) -> float:
    """The longest step, at most 1, that the ratios of values and directions allow. Signs as in the published rule."""
    with np.errstate(all="ignore"):
        ratios = np.concatenate([np.where(x > 0, x / dx, -x / dx) for x, dx in ((v, dv), (s, ds))])
    usable = ratios[(ratios > 1e-14) & (ratios < 100)]
    return min(1.0, float(usable.min())) if len(usable) else 1.0


def _inner_step(v: np.ndarray, dv: np.ndarray, s: np.ndarray, ds: np.ndarray) -> float:
    """The longest step, at most 1, that keeps 1 % of the distance to the boundary."""
    both, move = np.concatenate([v, s]), np.concatenate([dv, ds])
    return min(1.0, 0.99 * float((both[move < 0] / -move[move < 0]).min(initial=np.inf)))


def _iterated(k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, published: bool) -> Solution:
    """The optimum; the category of the failure is raised otherwise. published: with its step rule."""
    n, ne, nc = len(k), len(b), len(d)
    if not nc:
        raise FieldError("MissingInequalities")
    if not all(np.isfinite(m).all() for m in (k, a, b, c, d)):
        raise FieldError("NonFiniteInput")
    h = 2 * k
    start = np.sqrt(max(h.max(), 0.0)) or 1.0
    x, y, z, s = np.zeros(n), np.zeros(ne), np.full(nc, start), np.full(nc, start)

    def direction(last: np.ndarray) -> list[np.ndarray]:
        kkt = np.block(
            [
                [h, -a.T, -c.T, np.zeros((n, nc))],
                [a, np.zeros((ne, ne + 2 * nc))],
                [c, np.zeros((nc, ne + nc)), -np.eye(nc)],
                [np.zeros((nc, n + ne)), np.diag(s), np.diag(z)],
            ]
        )
        right = -np.concatenate([h @ x - a.T @ y - c.T @ z, a @ x - b, c @ x - s - d, last])
        return np.split(_solve(kkt, right), [n, n + ne, n + ne + nc])

    dx, dy, dz, ds = direction(s * z)
    x, y, z, s = x + dx, y + dy, z + dz, s + ds
    shift = 1000 + 2 * max(0.0, float(np.maximum(-z, -s).max()))
    z, s = z + shift, s + shift
    previous = np.inf
    for iteration in range(1, ITERATIONS + 1):
        rule = _step if published else _inner_step
        mu = float(s @ z) / nc
        if published and iteration > 6 and mu > previous or mu < (1e-8 if published else 1e-13):
            break
        previous = mu
        _, _, dz, ds = direction(s * z)
        first = rule(z, dz, s, ds)
        sigma = (float((z + first * dz) @ (s + first * ds)) / nc / mu) ** 3
        dx, dy, dz, ds = direction(s * z - sigma * mu + dz * ds)
        step = rule(z, dz, s, ds)
        x, y, z, s = x + step * dx, y + step * dy, z + step * dz, s + step * ds
    else:
        raise FieldError("IterationLimit")
    return _checked(h, a, b, c, d, x, y, z, s, iteration)


def _checked(h: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, s: np.ndarray, iteration: int) -> Solution:
    """The optimum that a program ended at; the category of the failure is raised if it is none."""
    nc = len(d)
    if not np.isfinite(x).all():
        raise FieldError("NonFiniteSolution")
    limit = lambda *parts: 1e-10 + 1e-6 * max([1.0, *(float(np.abs(p).max()) for p in parts if len(p))])
    if len(b) and np.abs(a @ x - b).max() > limit(b, x) or (c @ x - d).min() < -limit(d, x):
        raise FieldError("InfeasibleSolution")
    if z.min() < -limit(z) or abs(float(s @ z)) > nc * limit(h @ x):
        raise FieldError("ResidualTooLarge")
    if np.abs(h @ x - a.T @ y - c.T @ z).max() > limit(h @ x, z):
        raise FieldError("ResidualTooLarge")
    return Solution(x, z, s, limit(d, x), iteration)


def constrained(k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Solution:
    """min x'Kx with Ax = b and Cx >= d. Where the published step rule ends away from the optimum (its ratios may pass the
    boundary), the plain rule is run."""
    try:
        return _iterated(k, a, b, c, d, True)
    except FieldError as e:
        if e.category not in ("ResidualTooLarge", "InfeasibleSolution", "IterationLimit", "NonFiniteSolution"):
            raise
        return _iterated(k, a, b, c, d, False)


def constrained_all(k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[Solution | FieldError]:
    """constrained() of each program of a stack of one shape, or why it has no solution. All take their steps together; a program that
    leaves the published rule, or that the stack cannot tell, is solved alone."""
    found = _stacked(k, a, b, c, d) if len(k) > 1 and d.shape[1] else [None] * len(k)
    for i, one in enumerate(found):
        if one is None:
            try:
                found[i] = constrained(k[i], a[i], b[i], c[i], d[i])
            except FieldError as e:
                found[i] = e
    return found


def _steps(v: np.ndarray, dv: np.ndarray, s: np.ndarray, ds: np.ndarray) -> np.ndarray:
    """_step() of each program of a stack."""
    with np.errstate(all="ignore"):
        ratios = np.concatenate([np.where(x > 0, x / dx, -x / dx) for x, dx in ((v, dv), (s, ds))], axis=1)
        return np.minimum(1.0, np.where((ratios > 1e-14) & (ratios < 100), ratios, np.inf).min(axis=1))


def _stacked(k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[Solution | None]:
    """_iterated() of a stack by the published rule; None: not solved by it."""
    m, n, ne, nc = len(k), k.shape[1], b.shape[1], d.shape[1]
    out: list[Solution | None] = [None] * m
    whole = np.logical_and.reduce([np.isfinite(x).reshape(m, -1).all(axis=1) for x in (k, a, b, c, d)])
    times = lambda matrix, v: np.einsum("mij,mj->mi", matrix, v)
    turned = lambda matrix, v: np.einsum("mji,mj->mi", matrix, v)
    at = np.flatnonzero(whole)
    h = 2 * k[at]
    a, b, c, d = a[at], b[at], c[at], d[at]
    start = np.sqrt(np.maximum(h.reshape(len(at), -1).max(axis=1, initial=0.0), 0.0))
    start[start == 0] = 1.0
    x, y, z = np.zeros((len(at), n)), np.zeros((len(at), ne)), np.repeat(start[:, None], nc, axis=1)
    s, lost = z.copy(), np.zeros(len(at), bool)
    rows, places = n + ne + nc, np.arange(nc)

    def direction(last: np.ndarray) -> list[np.ndarray]:
        kkt = np.zeros((len(h), rows + nc, rows + nc))
        kkt[:, :n, :n], kkt[:, :n, n : n + ne], kkt[:, :n, n + ne : rows] = h, -a.transpose(0, 2, 1), -c.transpose(0, 2, 1)
        kkt[:, n : n + ne, :n], kkt[:, n + ne : rows, :n] = a, c
        kkt[:, n + ne + places, rows + places] = -1
        kkt[:, rows + places, n + ne + places], kkt[:, rows + places, rows + places] = s, z
        right = -np.concatenate([times(h, x) - turned(a, y) - turned(c, z), times(a, x) - b, times(c, x) - s - d, last], axis=1)
        try:
            found = np.linalg.solve(kkt, right[..., None])[..., 0]
        except np.linalg.LinAlgError:
            # one singular system fails the stack: that program is solved alone
            found = np.zeros_like(right)
            for i in np.flatnonzero(~lost):
                try:
                    found[i] = np.linalg.solve(kkt[i], right[i])
                except np.linalg.LinAlgError:
                    lost[i] = True
        return np.split(found, [n, n + ne, rows], axis=1)

    dx, dy, dz, ds = direction(s * z)
    x, y, z, s = x + dx, y + dy, z + dz, s + ds
    shift = 1000 + 2 * np.maximum(0.0, np.maximum(-z, -s).max(axis=1, initial=0.0))[:, None]
    z, s = z + shift, s + shift
    previous = np.full(len(at), np.inf)
    for iteration in range(1, ITERATIONS + 1):
        mu = (s * z).sum(axis=1) / nc
        ends = (iteration > 6) & (mu > previous) | (mu < 1e-8)
        for i in np.flatnonzero(ends & ~lost):
            try:
                out[at[i]] = _checked(h[i], a[i], b[i], c[i], d[i], x[i], y[i], z[i], s[i], iteration)
            except FieldError:
                # constrained() takes the plain rule then, or says why
                pass
        on = ~(ends | lost)
        if not on.any():
            break
        at, h, a, b, c, d, x, y, z, s, mu, lost = (v[on] for v in (at, h, a, b, c, d, x, y, z, s, mu, lost))
        previous = mu
        _, _, dz, ds = direction(s * z)
        first = _steps(z, dz, s, ds)[:, None]
        sigma = (((z + first * dz) * (s + first * ds)).sum(axis=1) / nc / mu) ** 3
        dx, dy, dz, ds = direction(s * z - (sigma * mu)[:, None] + dz * ds)
        step = _steps(z, dz, s, ds)[:, None]
        x, y, z, s = x + step * dx, y + step * dy, z + step * dz, s + step * ds
    return out


def boxed(k: np.ndarray, a: np.ndarray, lower: np.ndarray, width: np.ndarray) -> Solution:
    """min x'Kx with lower <= Ax <= lower + width, as inequalities of both sides, the lower ones first; a box without width has no
    interior and fails."""
    if len(width) and (width <= 0).any():
        raise FieldError("InfeasibleSolution", "a bound has no width")
    return _iterated(k, np.zeros((0, len(k))), np.zeros(0), np.concatenate([a, -a]), np.concatenate([lower, -(lower + width)]), False)


def predictor_corrector(k: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
    """x and the iterations of constrained()."""
    found = constrained(k, a, b, c, d)
    return found.x, found.iterations


def bounded(k: np.ndarray, a: np.ndarray, lower: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, int]:
    """x and the iterations of boxed()."""
    found = boxed(k, a, lower, width)
    return found.x, found.iterations
