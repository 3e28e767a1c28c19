"""Very many small models: they meet their queries in the tasks, and the driver gets none of them."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from orogen.functions import kernels as K
from orogen.operators import evaluation, fitting
from orogen.parameters import CONTINUOUS, SINGLE_SURFACE, Parameters
from orogen.sources import tables


def _refused(*_):
    raise AssertionError("models went through the driver")


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", _refused)


def _two_sites(spark, n):
    sites = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("model_id"), (F.col("id") % 2).alias("constraint_id"), (F.col("id") % 2 + 0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("id") % 7 + 0.0).alias("level"))
    return tables.constraints_of(sites, "interface")


def test_more_models_than_a_broadcast_takes(spark, no_broadcast):
    n = evaluation.BROADCAST_MODELS + 200
    models = fitting.fit(_two_sites(spark, n), Parameters(CONTINUOUS, K.GAUSSIAN, shape=1.0))
    at = spark.range(-1, n + 1).select(F.col("id").alias("model_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("query_id"), F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    at = at.unionByName(spark.createDataFrame([(None, 0, 0.5, 0.0, 0.0)], "model_id long, query_id long, x double, y double, z double"))
    rows = evaluation.evaluate(models, at).collect()
    assert len(rows) == 3 * n
    k, near = math.exp(-1.0), math.exp(-0.25)
    for r in rows:
        a, b = (2 * r["model_id"]) % 7, (2 * r["model_id"] + 1) % 7
        assert r["value"] == pytest.approx((a + b) / (1 + k) * near, abs=1e-9)


def test_queries_of_a_model_in_parts_and_batches(spark, no_broadcast, monkeypatch):
    """Parts of five queries and batches of seven rows; one model has no solution, one has a modified kernel with an inequality."""
    monkeypatch.setattr(evaluation, "BROADCAST_MODELS", 0)
    monkeypatch.setattr(evaluation, "PART_ROWS", 5)
    sites = [(m, i, *map(float, p), 2.0) for m in (1, 2) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])]
    own = tables.constraints_of(spark.createDataFrame(sites, "model_id long, constraint_id long, x double, y double, z double, level double"), "interface")
    own = own.unionByName(tables.constraints_of(spark.createDataFrame([(2, 0, 0.5, 0.5, 0.5, 1.0)], "model_id long, constraint_id long, x double, y double, z double, level double"), "inequality"))
    bad = tables.constraints_of(spark.createDataFrame([(3, 0, math.nan, 0.0, 0.0, 1.0)], "model_id long, constraint_id long, x double, y double, z double, level double"), "interface")
    models = fitting.fit(own.unionByName(bad), Parameters(SINGLE_SURFACE))
    at = spark.range(23).select(F.explode(F.array(*(F.lit(m).cast("long") for m in (1, 2, 3)))).alias("model_id"), F.col("id").alias("query_id"), (F.col("id") / 23).alias("x"), F.lit(0.25).alias("y"), F.lit(-0.5).alias("z"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scalars = evaluation.evaluate(models, at).collect()
        slopes = evaluation.evaluate(models, at, gradient=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(scalars) == len(slopes) == 69 and len({(r["model_id"], r["query_id"]) for r in scalars}) == 69
    for r in scalars:
        # the plane of the sites has their level everywhere
        assert (r["value"] is None or math.isnan(r["value"])) if r["model_id"] == 3 else r["value"] == pytest.approx(2.0, abs=1e-4)
    assert all(r["model_id"] == 3 or abs(r["gx"]) + abs(r["gy"]) + abs(r["gz"]) < 1e-3 for r in slopes)
