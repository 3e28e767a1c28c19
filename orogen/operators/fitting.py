"""Fitting: constraints of many models to many fitted fields, one model in one task.

Constraints are one tagged table: model_id, category (interface, inequality, planar, tangent), constraint_id (order of insertion),
x, y, z, c, level, and vx, vy, vz (a planar's normal or a tangent). orogen.operators.layout makes the table of each model's unknowns with
DataFrame operators; here the rows of a model meet in one task for the dense solution alone. A linear model of more than MOST_DOFS unknowns
is solved over the cluster (orogen.operators.iterative); one with inequalities or bounds is refused, and its rows are not gathered beyond that, so a task's
memory is bounded. Small models of one shape are solved together.

A fitted model is a row: the terms of its functionals, their weights, the polynomial's coefficients, or an error category.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FieldError
from ..parameters import LAJAUNIE, SINGLE_SURFACE, STRATIGRAPHIC, Parameters
from . import dense, layout, quadratic
from .grouping import remove_collocated
from .modified import ModifiedKernel, unisolvent_points

MOST_DOFS, SMALL, BATCH = 5000, 64, 512
CONSTRAINTS = "model_id long, category string, constraint_id long, x double, y double, z double, c double, level double, vx double, vy double, vz double"
MODELS = (
    "model_id long, error string, kernel string, shape double, polynomial_order int, truncated boolean, transform array<double>, owner array<int>, coefficient array<double>, "
    "point array<double>, direction array<double>, weight array<double>, polynomial array<double>, n_dofs int, basis_points array<double>, iterations int, "
    "dual array<double>, slack array<double>, tolerance double"
)


@dataclass
class Rows:
    """Layout rows as arrays: section, first and second point (NaN: none), direction (NaN: a value), sign, lower, upper, value, error."""

    section: np.ndarray
    first: np.ndarray
    second: np.ndarray
    direction: np.ndarray
    bounds: np.ndarray
    error: np.ndarray

    def __getitem__(self, rows) -> Rows:
        return Rows(self.section[rows], self.first[rows], self.second[rows], self.direction[rows], self.bounds[rows], self.error[rows])

    @staticmethod
    def of(found: pd.DataFrame) -> Rows:
        take = lambda *names: found[list(names)].to_numpy(float)
        return Rows(found["section"].to_numpy(), take("x1", "y1", "z1", "c1"), take("x2", "y2", "z2", "c2"), take("dx", "dy", "dz"), take("sign", "lower", "upper", "value"), found["error"].to_numpy())

    def of_sections(self, *sections: int) -> Rows:
        return self[np.isin(self.section, sections)]

    @property
    def unknowns(self) -> Rows:
        return self[(self.section >= layout.SEQUENCED) & (self.section <= layout.TANGENT)]

    def shape(self) -> tuple[int, bytes, bytes]:
        """Models with equal shapes differ in numbers alone."""
        return len(self.section), np.isnan(self.second[:, 0]).tobytes(), np.isnan(self.direction[:, 0]).tobytes()

    def terms(self) -> dense.Terms:
        return terms_of([self])


def terms_of(systems: list[Rows]) -> dense.Terms:
    """The terms of models of one shape, stacked if there are several."""
    one = systems[0]
    two, directed = ~np.isnan(one.second[:, 0]), ~np.isnan(one.direction[:, 0])
    start = np.arange(len(two)) + np.cumsum(two) - two
    n = len(two) + int(two.sum())
    coefficient, point, direction = np.ones((len(systems), n)), np.empty((len(systems), n, 4)), np.zeros((len(systems), n, 3))
    coefficient[:, start[two] + 1] = -1
    point[:, start] = [s.first for s in systems]
    point[:, start[two] + 1] = [s.second[two] for s in systems]
    direction[:, start[directed]] = [s.direction[directed] for s in systems]
    owner = np.repeat(np.arange(len(two)), 1 + two)
    return dense.Terms(owner, coefficient, point, direction) if len(systems) > 1 else dense.Terms(owner, coefficient[0], point[0], direction[0])


def polynomial_of(parameters: Parameters) -> tuple[int, bool]:
    """Order of the polynomial (-1: none) and whether its constant is left out."""
    if parameters.model == SINGLE_SURFACE:
        return parameters.polynomial_order, False
    return (parameters.polynomial_order, True) if parameters.model == LAJAUNIE else (-1, False)


def _transform(found: Rows, parameters: Parameters) -> np.ndarray | None:
    return dense.transform_of(parameters.kernel, found.of_sections(layout.PLANAR).bounds[:, 3].reshape(-1, 3)) if parameters.anisotropy else None


def system_matrix(terms: dense.Terms, smoothed: int, kernel: str, shape: float, transform: np.ndarray | None, order: int, truncated: bool, smoothing: float | None) -> np.ndarray:
    """The kernel block, its smoothed diagonal, and the polynomial blocks; of stacked terms a stack."""
    n = terms.size
    block = dense.kernel_matrix(terms, terms, kernel, shape, transform)
    if smoothing is not None and smoothed:
        ends = [dense.Terms(np.zeros(1, int), np.ones(1), np.array([[0.0, 0, z, 0]]), np.zeros((1, 3))) for z in (0.0, smoothing)]
        block[..., np.arange(smoothed), np.arange(smoothed)] = dense.kernel_matrix(*ends, kernel, shape, transform)[0, 0]
    poly = dense.polynomial_matrix(terms, order, truncated) if order >= 0 else np.zeros((*block.shape[:-1], 0))
    m = poly.shape[-1]
    matrix = np.zeros((*block.shape[:-2], n + m, n + m))
    matrix[..., :n, :n], matrix[..., :n, n:], matrix[..., n:, :n] = block, poly, np.swapaxes(poly, -1, -2)
    return matrix


def _linear(systems: list[Rows], parameters: Parameters) -> tuple[dense.Terms, list[np.ndarray | FieldError], np.ndarray | None, int, bool]:
    """The weights (or the failure) of linear models of one shape; a transform for one model alone."""
    order, truncated = polynomial_of(parameters)
    terms, transform = terms_of(systems), _transform(systems[0], parameters)
    smoothed = int((systems[0].section <= layout.INCREMENT).sum())
    matrix = system_matrix(terms, smoothed, parameters.kernel, parameters.shape, transform, order, truncated, parameters.smoothing)
    right = np.zeros((len(systems), matrix.shape[-1]))
    right[:, : terms.size] = [s.bounds[:, 3] for s in systems]
    return terms, dense.solve_all(matrix.reshape(len(systems), *matrix.shape[-2:]), right), transform, order, truncated


def _modified(found: Rows, parameters: Parameters) -> ModifiedKernel:
    return ModifiedKernel(unisolvent_points([found.of_sections(layout.BASIS).first[:, :3]]), parameters.kernel, parameters.shape, _transform(found, parameters))


def _modified_stack(systems: list[Rows], parameters: Parameters) -> ModifiedKernel:
    points = np.stack([unisolvent_points([s.of_sections(layout.BASIS).first[:, :3]]) for s in systems])
    return ModifiedKernel(points, parameters.kernel, parameters.shape)


def _programs(systems: list[Rows], parameters: Parameters) -> tuple[dense.Terms, list[quadratic.Solution | FieldError], ModifiedKernel]:
    """What _quadratic() gives for several models with inequalities of one shape, as stacks."""
    own = [s.unknowns for s in systems]
    terms, kernel = terms_of(own), _modified_stack(systems, parameters)
    whole, n = kernel.matrix(terms, terms), int((own[0].section <= layout.LITHOLOGY).sum())
    sign, lower, _, value = np.moveaxis(np.stack([o.bounds for o in own]), -1, 0)
    return terms, quadratic.constrained_all(whole, whole[:, n:], value[:, n:], whole[:, :n] * sign[:, :n, None], lower[:, :n]), kernel


def _quadratic(found: Rows, parameters: Parameters) -> tuple[dense.Terms, quadratic.Solution, ModifiedKernel]:
    """Terms, weights with their multipliers, and modified kernel: the least energy that meets the inequalities or bounds."""
    own = found.unknowns
    terms, kernel = own.terms(), _modified(found, parameters)
    whole = kernel.matrix(terms, terms)
    sign, lower, upper, value = own.bounds.T
    if parameters.restricted:
        solution = quadratic.boxed(whole, whole, lower, upper - lower)
    else:
        n = int((own.section <= layout.LITHOLOGY).sum())
        solution = quadratic.constrained(whole, whole[n:], value[n:], whole[:n] * sign[:n, None], lower[:n])
    return terms, solution, kernel


def _row(model_id: int, parameters: Parameters, error: str | None = None) -> dict:
    empty = {c: [] for c in ("owner", "coefficient", "point", "direction", "weight", "polynomial")}
    return {"model_id": model_id, "error": error, "kernel": parameters.kernel, "shape": parameters.shape, "polynomial_order": -1, "truncated": False, "transform": None} | empty | {"n_dofs": 0, "basis_points": None, "iterations": 0, "dual": None, "slack": None, "tolerance": None}


def _fitted(terms: dense.Terms, k: int | None, weight: np.ndarray) -> dict:
    """The columns of terms and weights; k picks one of a stack."""
    n, pick = terms.size, (lambda a: a) if k is None else (lambda a: a[k])
    return {"owner": terms.owner, "coefficient": pick(terms.coefficient), "point": pick(terms.point).ravel(), "direction": pick(terms.direction).ravel(), "weight": weight[:n], "polynomial": weight[n:], "n_dofs": len(weight)}


def _fitted_programs(part: list[tuple[int, Rows]], parameters: Parameters) -> list[dict]:
    """The rows of models with inequalities or bounds of one shape."""
    if len(part) > 1:
        try:
            terms, solutions, kernel = _programs([found for _, found in part], parameters)
        except FieldError:
            # one that cannot be set up fails the stack: each for itself
            return [row for one in part for row in _fitted_programs([one], parameters)]
    else:
        try:
            terms, solution, kernel = _quadratic(part[0][1], parameters)
            solutions = [solution]
        except FieldError as e:
            solutions = [e]
    out = []
    for k, ((model_id, _), s) in enumerate(zip(part, solutions, strict=True)):
        if isinstance(s, FieldError):
            out.append(_row(model_id, parameters, s.category))
            continue
        own, points = (k, kernel.points[k]) if len(part) > 1 else (None, kernel.points)
        out.append(_row(model_id, parameters) | _fitted(terms, own, s.x) | {"transform": None if kernel.transform is None else kernel.transform.astype(float).ravel(), "basis_points": points.ravel(), "iterations": s.iterations, "dual": s.dual, "slack": s.slack, "tolerance": s.tolerance})
    return out


def fit_many(models: list[tuple[int, Rows]], parameters: Parameters) -> list[dict]:
    """The rows of some models."""
    out, alike, programs = [], {}, {}
    restricted = parameters.restricted and parameters.model in (SINGLE_SURFACE, LAJAUNIE, STRATIGRAPHIC)
    for model_id, found in models:
        own, error = found.unknowns, found.error[0]
        if not isinstance(error, str) and len(own.section) + 10 > MOST_DOFS:
            error = "ModelTooLarge"
        if isinstance(error, str) or not len(own.section):
            out.append(_row(model_id, parameters, error if isinstance(error, str) else None))
        elif restricted or (own.section <= layout.LITHOLOGY).any():
            alone = restricted or parameters.anisotropy or len(own.section) > SMALL
            programs.setdefault((model_id,) if alone else (*own.shape(), own.section.tobytes()), []).append((model_id, found))
        else:
            alone = parameters.anisotropy or len(own.section) > SMALL
            alike.setdefault((model_id,) if alone else own.shape(), []).append((model_id, own))
    for some in programs.values():
        for part in (some[k : k + BATCH] for k in range(0, len(some), BATCH)):
            out += _fitted_programs(part, parameters)
    for some in alike.values():
        for part in (some[k : k + BATCH] for k in range(0, len(some), BATCH)):
            try:
                terms, weights, transform, order, truncated = _linear([own for _, own in part], parameters)
            except FieldError as e:
                out += [_row(model_id, parameters, e.category) for model_id, _ in part]
                continue
            for k, ((model_id, _), weight) in enumerate(zip(part, weights, strict=True)):
                if isinstance(weight, FieldError):
                    out.append(_row(model_id, parameters, weight.category))
                else:
                    out.append(_row(model_id, parameters) | _fitted(terms, k if len(part) > 1 else None, weight) | {"polynomial_order": order, "truncated": truncated, "transform": None if transform is None else transform.astype(float).ravel()})
    return out


def cleaned(constraints: DataFrame) -> DataFrame:
    """Without rows that are collocated with the last one kept of their model and category, in order of place."""
    return remove_collocated(constraints)


def fit(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """A row of MODELS for each model_id. Spark deals the models to tasks by model_id."""
    from . import iterative

    parameters = parameters.checked()
    large = iterative.large_of(constraints, parameters, MOST_DOFS)
    if large is None:
        return _fitted_in_tasks(constraints, parameters)
    functionals, ids = large
    return _fitted_in_tasks(constraints.filter(F.col("model_id").isNull() | ~F.col("model_id").isin(ids)), parameters).unionByName(iterative.models(functionals, parameters))


def _fitted_in_tasks(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """The models, each in one task."""

    def fitted(found: pd.DataFrame) -> pd.DataFrame:
        ids, rows = found["model_id"].to_numpy(), Rows.of(found)
        cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
        return pd.DataFrame(fit_many([(int(ids[a]), rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], parameters))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part])
            # the last model may go on in the next batch
            cut = int(np.searchsorted(part["model_id"].to_numpy(), part["model_id"].iloc[-1]))
            if cut:
                yield fitted(part.iloc[:cut])
            # a model has no more basis rows than unknowns and levels: what is cut off here is refused by its size
            left = part.iloc[cut:].iloc[: 4 * MOST_DOFS]
        if left is not None and len(left):
            yield fitted(left)

    flat = layout.rows(constraints, parameters).select(
        "model_id", "section", *(F.col(f"{side}.{k}").alias(f"{k}{n}") for n, side in ((1, "first"), (2, "second")) for k in "xyzc"), "dx", "dy", "dz", "sign", "lower", "upper", "value", "error", "dof"
    )
    return flat.sortWithinPartitions("model_id", "dof").drop("dof").mapInPandas(run, MODELS)


def smoothed(parameters: Parameters, amount: float) -> Parameters:
    return replace(parameters, smoothing=amount)
