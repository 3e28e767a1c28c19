"""Anisotropy and systems as columns, against published values and the dense arithmetic of the fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.errors import FieldError
from orogen.functions import kernels as K
from orogen.operators import anisotropy, assembly, dense, fitting, layout
from orogen.parameters import CONTINUOUS, LAJAUNIE, SINGLE_SURFACE, STRATIGRAPHIC, VECTOR, Parameters

from .test_engine import HORIZON, MORE, PLANARS, bits, constraints

OBLIQUE = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0.36, -0.48, 0.8), (-0.48, 0.64, 0.6)]
TANGENTS = [((-1, 2, 1), (0.2, 0.7, 0.1)), ((3, 0, -1), (0.5, -0.5, 0.25))]


def planars(spark, normals, model_id=1):
    return constraints(spark, planars=[((k, 0, 0), n) for k, n in enumerate(normals)], model_id=model_id)


def test_transform_of_oblique_planars(spark):
    """Published values in single precision; the sum here is in double precision."""
    found = anisotropy.transforms(planars(spark, OBLIQUE)).first()
    want = np.array([0x3F931644, 0xBE4B9820, 0, 0xBE4B9824, 0x3FA1EEB0, 0, 0, 0, 0x3FB504F3], np.uint32).view(np.float32)
    assert found.error is None and found.transform == pytest.approx(want.astype(float), abs=2e-6)
    assert found.eigenvalues == pytest.approx([1, 2, 2], abs=1e-6) and np.abs(found.plunge) == pytest.approx([0.8, 0.6, 0], abs=1e-6)
    same = np.array(found.transform).reshape(3, 3)
    assert same == pytest.approx(dense.transform_of(K.CUBIC, np.array(OBLIQUE, float)), abs=2e-6)


def test_transforms_of_edge_cases(spark):
    """Equal sums give the identity; eigenvalues below 1e-4 count as that; one planar or a null normal is an error; none is no row."""
    many = [OBLIQUE[:3], [(0, 0, 1), (0, 0, 1)], [(0, 0, 1)], [(0, 0, 1), (1, 0, float("nan"))], [(1, 2, 3), (0.5, -1, 2), (-3, 1, 0.25), (1, 2, 3)]]
    rows = planars(spark, many[0], 0)
    for k, some in enumerate(many[1:], 1):
        rows = rows.unionByName(planars(spark, some, k))
    found = {r.model_id: r for r in anisotropy.transforms(rows).collect()}
    assert found[0].transform == pytest.approx(K.IDENTITY)
    assert found[1].eigenvalues == pytest.approx([0, 0, 2]) and found[1].transform == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, np.sqrt(2e4)])
    assert found[2].error == "InvalidInputData" and found[3].error == "NonFiniteInput" and found[2].transform is None and found[3].transform is None
    values, vectors = np.linalg.eigh(np.array(many[4]).T @ np.array(many[4]))
    assert found[4].eigenvalues == pytest.approx(values) and np.array(found[4].transform).reshape(3, 3) == pytest.approx(vectors * np.sqrt(values / values[0]) @ vectors.T)
    assert anisotropy.transforms(rows.limit(0)).count() == 0


def test_published_kernel_of_oblique_planars(spark):
    """The cubic kernel at two points: value, both gradients, mixed second derivatives by rows."""
    want = [0x403EB0CB0E38DF50, 0xC03CEDF1E0751366, 0x403491EA1F3FAB2C, 0x4032C90DD250B6C1, 0x403CEDF1E0751366, 0xC03491EA1F3FAB2C, 0xC032C90DD250B6C1, 0xC035DD258A3A2EAF, 0x4025F181800960C2, 0x40179C205E10B7D8,
            0x4025F181800960C2, 0xC033FFE51594225E, 0xC010C99BD6BA3394, 0x40179C205E10B7D8, 0xC010C99BD6BA3394, 0xC0369E3E3556BF5B]
    one = anisotropy.transforms(planars(spark, OBLIQUE))
    pair, axes = K.stretched(tuple(F.lit(v) for v in (-2.0, 0.75, 1.0)), F.col("transform")), [tuple(F.lit(float(k == j)) for j in range(3)) for k in range(3)]
    slopes = [K.at_first(K.CUBIC, pair, 0.7, u) for u in axes]
    found = one.select(K.value(K.CUBIC, pair, 0.7), *slopes, *(-s for s in slopes), *(K.at_both(K.CUBIC, pair, 0.7, u, v, F.col("transform")) for u in axes for v in axes)).first()
    assert list(found) == pytest.approx([bits(w) for w in want], rel=2e-6)


SETTINGS = [
    Parameters(LAJAUNIE), Parameters(LAJAUNIE, K.MULTIQUADRIC, shape=0.7, polynomial_order=2, smoothing=0.5), Parameters(SINGLE_SURFACE, K.THIN_PLATE, polynomial_order=0), Parameters(SINGLE_SURFACE, K.GAUSSIAN, shape=0.4, anisotropy=True, smoothing=0.25),
    Parameters(LAJAUNIE, K.INVERSE_MULTIQUADRIC, shape=1.5, anisotropy=True), Parameters(VECTOR, K.MATERN, shape=0.5), Parameters(SINGLE_SURFACE, K.WENDLAND, shape=6.0), Parameters(LAJAUNIE, K.MULTIQUADRIC_CUBIC, shape=1.0),
]


def dense_system(rows, p: Parameters) -> np.ndarray:
    flat = layout.rows(rows, p).orderBy("dof").select("model_id", "section", *(F.col(f"{side}.{k}").alias(f"{k}{n}") for n, side in ((1, "first"), (2, "second")) for k in "xyzc"), "dx", "dy", "dz", "sign", "lower", "upper", "value", "error").toPandas()
    own = fitting.Rows.of(flat).unknowns
    order, truncated = fitting.polynomial_of(p)
    return fitting.system_matrix(own.terms(), int((own.section <= layout.INCREMENT).sum()), p.kernel, p.shape, fitting._transform(own, p), order, truncated, p.smoothing)


@pytest.mark.parametrize("p", SETTINGS, ids=lambda p: f"{p.model}-{p.kernel}-{p.anisotropy}")
def test_system_is_the_dense_one(spark, monkeypatch, p):
    """Squares of three a side, so that models have several and unequal ones."""
    monkeypatch.setattr(assembly, "BLOCK", 3)
    rows = constraints(spark, HORIZON + MORE + [((5.5, 2, 0), 20)], PLANARS, TANGENTS)
    want = dense_system(rows, p)
    found = np.zeros_like(want)
    entries = assembly.system(rows, p).collect()
    for e in entries:
        found[e.row, e.col] += e.value
    assert len({(e.row, e.col) for e in entries}) == len(entries)
    assert found == pytest.approx(want, abs=1e-5 * max(1.0, np.abs(want).max()) if p.anisotropy else 1e-9 * max(1.0, np.abs(want).max()))


def test_systems_of_refused_models(spark):
    rows = constraints(spark, HORIZON, PLANARS[:1]).unionByName(constraints(spark, HORIZON + MORE, PLANARS, model_id=2))
    assert {e.model_id for e in assembly.system(rows, Parameters(SINGLE_SURFACE, anisotropy=True)).collect()} == {2}
    assert [tuple(e) for e in assembly.errors(rows, Parameters(SINGLE_SURFACE, anisotropy=True)).collect()] == [(1, "InvalidInputData")]
    assert {e.error for e in assembly.errors(rows, Parameters(SINGLE_SURFACE, K.LINEAR)).collect()} == {"LinearDerivativeUnavailable"}
    assert assembly.system(rows, Parameters(SINGLE_SURFACE, K.LINEAR)).count() == 0
    assert {e.error for e in assembly.errors(rows, Parameters(CONTINUOUS)).collect()} == {"EqualityVectorOutOfBounds"}
    with pytest.raises(FieldError, match="UnsupportedKernel"):
        assembly.system(rows, Parameters(SINGLE_SURFACE, K.MATERN, anisotropy=True))
    assert assembly.system(rows.limit(0), Parameters(STRATIGRAPHIC)).count() == 0


def test_multipliers_of_bounds(spark):
    """At the optimum the weights are half the difference of both bounds' multipliers, and a multiplier or its slack is 0."""
    from orogen.operators import reconstruction

    p = Parameters(LAJAUNIE, restricted=True, interface_uncertainty=0.25, angular_uncertainty=8.0)
    rows = constraints(spark, HORIZON + MORE, PLANARS[:1])
    models = fitting.fit(rows, p)
    found = {r.dof: r for r in reconstruction.evidence(models, rows, p).collect()}
    weight = models.first().weight
    assert len(found) == len(weight) and all(r.accepted for r in found.values())
    for k, r in found.items():
        assert (r.dual - r.dual_upper) / 2 == pytest.approx(weight[k], abs=1e-6 * max(1.0, np.abs(weight).max()))
        assert abs(r.dual * r.solver_slack) < 1e-6 and abs(r.dual_upper * r.solver_slack_upper) < 1e-6
        assert r.solver_slack == pytest.approx(r.prediction - r.lower, abs=1e-5) and r.solver_slack_upper == pytest.approx(r.upper - r.prediction, abs=1e-5)
