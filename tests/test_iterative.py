"""Models of more unknowns than one task takes: solved over all rows by Spark, with the weights of the dense solution."""

from __future__ import annotations

import math

import pytest

from orogen.functions import kernels as K
from orogen.operators import evaluation, fitting
from orogen.parameters import CONTINUOUS, LAJAUNIE, SINGLE_SURFACE, Parameters
from orogen.sources import tables

_ROW = "model_id long, constraint_id long, x double, y double, z double, level double"


def _sites(spark, n, level):
    at = [(i, i % 4 + 0.1 * math.sin(i), i // 4 % 4 + 0.1 * math.cos(3 * i), i // 16 + 0.05 * (i % 3)) for i in range(n)]
    return tables.constraints_of(spark.createDataFrame([(5, i, x, y, z, float(level(i, x, y, z))) for i, x, y, z in at], _ROW), "interface")


def _same(spark, monkeypatch, own, parameters):
    dense = fitting.fit(own, parameters).collect()
    monkeypatch.setattr(fitting, "MOST_DOFS", 20)
    models = fitting.fit(own, parameters).collect()
    assert len(dense) == len(models) == 1 and models[0]["error"] is None
    for name in ("owner", "coefficient", "point", "direction", "n_dofs", "polynomial_order", "truncated"):
        assert models[0][name] == dense[0][name]
    size = max(map(abs, dense[0]["weight"]))
    assert models[0]["weight"] == pytest.approx(dense[0]["weight"], abs=1e-7 * size)
    assert models[0]["polynomial"] == pytest.approx(dense[0]["polynomial"], abs=1e-7 * size)
    return models[0]


def test_values_of_a_polynomial_take_no_iteration(spark, monkeypatch):
    own = _sites(spark, 40, lambda i, x, y, z: x * x + 2 * y * y + 3 * z * z + 4 * x * y + 7 * x + 10)
    monkeypatch.setattr(fitting, "MOST_DOFS", 20)
    models = fitting.fit(own, Parameters(SINGLE_SURFACE, polynomial_order=2))
    one = models.collect()[0]
    assert one["error"] is None and one["iterations"] == 0 and not any(one["weight"])
    at = spark.createDataFrame([(5, 0, 1.5, -0.5, 2.0)], "model_id long, query_id long, x double, y double, z double")
    assert evaluation.evaluate(models, at).collect()[0]["value"] == pytest.approx(2.25 + 0.5 + 12 - 3 + 10.5 + 10, abs=1e-8)


def test_weights_are_the_dense_ones(spark, monkeypatch):
    """With a polynomial beside a kernel that is nearly diagonal, and squares of four functionals."""
    from orogen.operators import assembly

    monkeypatch.setattr(assembly, "BLOCK", 16)
    found = _same(spark, monkeypatch, _sites(spark, 30, lambda i, x, y, z: i % 5 + x), Parameters(SINGLE_SURFACE, K.GAUSSIAN, shape=2.0, polynomial_order=1))
    assert 0 < found["iterations"] < 30


def test_without_polynomial(spark, monkeypatch):
    _same(spark, monkeypatch, _sites(spark, 24, lambda i, x, y, z: i % 3 - 1), Parameters(CONTINUOUS, K.GAUSSIAN, shape=3.0))


def test_increments_and_planars_on_planes(spark, monkeypatch):
    own = _sites(spark, 32, lambda i, x, y, z: 0).selectExpr("model_id", "constraint_id", "x", "y", "x * 0 + z - z + (constraint_id % 2 * 5 - 0.6 * x) / 0.8 as z", "constraint_id % 2 * 5.0 as level")
    planar = spark.createDataFrame([(5, 0, 1.0, 2.0, 3.0, 0.6, 0.0, 0.8)], "model_id long, constraint_id long, x double, y double, z double, vx double, vy double, vz double")
    own = tables.constraints_of(own, "interface").unionByName(tables.constraints_of(planar, "planar"))
    monkeypatch.setattr(fitting, "MOST_DOFS", 20)
    models = fitting.fit(own, Parameters(LAJAUNIE))
    at = spark.createDataFrame([(5, 0, 1.0, 0.5, 2.0)], "model_id long, query_id long, x double, y double, z double")
    slope = evaluation.evaluate(models, at, gradient=True).collect()[0]
    assert [slope[c] for c in ("gx", "gy", "gz")] == pytest.approx([0.6, 0.0, 0.8], abs=1e-8)
