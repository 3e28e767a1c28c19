"""Nearest and farthest points against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from orogen.operators import boxes, evaluation, fitting, grouping, spatial
from orogen.parameters import CONTINUOUS, Parameters

SCHEMA = "model_id long, idx long, x double, y double, z double, c double"


def cloud(seed: int):
    """Models with a wide cloud and a dense cluster, with many points at one place, on a line, and of one point; ties on a lattice."""
    rng, rows = random.Random(seed), []
    for i in range(150):
        rows.append((1, i, *(rng.gauss(0, 1) if i % 2 else 5 + rng.random() * 1e-4 for _ in range(3)), 0.0))
    rows += [(2, i, 1.0, 2.0, 3.0, 0.0) for i in range(40)] + [(2, 40 + i, rng.random(), 0.0, -0.0, 0.0) for i in range(60)]
    rows += [(3, i, float(i % 4), float(i // 4 % 4), float(i // 16), float(i % 2)) for i in range(64)]
    return [*rows, (4, 7, 0.5, 0.5, 0.5, 0.0)]


def distance(a, b):
    return math.sqrt(sum((u - v) ** 2 for u, v in zip(a[2:], b[2:], strict=True)))


@pytest.fixture(scope="module")
def points(spark):
    rows = cloud(3)
    pairs = {}
    for a in rows:
        pairs[a[:2]] = [(distance(a, b), b[1]) for b in rows if b[0] == a[0]]
    return spark.createDataFrame(rows, SCHEMA), pairs


def test_nearest_ones(points):
    table, pairs = points
    got = {(r.model_id, r.idx, r["rank"]): (r.d, r.near) for r in spatial.nearest_k(table, table, 3).collect()}
    want = {(*key, k + 1): near for key, some in pairs.items() for k, near in enumerate(sorted(p for p in some if p[0] > 0)[:3])}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-12) for k in want)


def test_farthest_ones(points):
    table, pairs = points
    got = {(r.model_id, r.idx): r.farthest for r in spatial.farthest(table, table).collect()}
    assert got == {key: min((-d, b) for d, b in some)[1] for key, some in pairs.items()}


def test_closest_to_a_distance_and_whole_models(points):
    table, pairs = points
    got = {(r.model_id, r.idx): r.closest for r in spatial.closest_to_distance(table, table, 0.9).collect()}
    assert got == {key: min((abs(d - 0.9), b) for d, b in some)[1] for key, some in pairs.items()}
    most = {}
    for (model, a), some in pairs.items():
        for d, b in some:
            most[model] = min(most.get(model, (1, 0, 0)), (-d, a, b))
    assert {r.model_id: (r.i, r.j) for r in spatial.farthest_pair(table).collect()} == {m: v[1:] for m, v in most.items()}
    means = {}
    for (model, a), some in pairs.items():
        means.setdefault(model, []).append(min((d for d, b in some if b != a), default=0.0))
    assert {r.model_id: r.average for r in spatial.average_nearest(table).collect()} == pytest.approx({m: sum(v) / len(v) for m, v in means.items()})


def test_cells_hold_few_places_however_dense(points):
    own = boxes.Boxes(points[0])
    filled = own.places.groupBy("model_id", own._key(own.levels[-1])).count()
    assert filled.filter(f"count > {boxes.LEAF}").count() == 0
    # dozens of digits lie between the cloud's cells and the cluster's; those that divide nothing are passed over
    assert len(own.levels) < max(own.levels)


def test_no_points(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert spatial.nearest(nothing, nothing).count() == 0 and spatial.largest_distance(nothing).count() == 0


def greedy(rows):
    kept, last = [], None
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4], r[1])):
        if last is None or any(abs(u - v) >= 1e-3 for u, v in zip(r[2:5], last[2:5], strict=True)):
            kept.append(r[:2])
            last = r
    return kept


def test_collocated_points_are_dropped_in_order(spark):
    rng = random.Random(8)
    rows = [(m, i, rng.choice([0.0, 0.5, rng.random() * 0.01]), rng.random() * 0.003, rng.choice([0.0, -0.0, 0.0005]), 0.0) for m in (1, 2) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("idx", "constraint_id")
    got = sorted((r.model_id, r.constraint_id) for r in grouping.remove_collocated(table, ("model_id",)).collect())
    assert got == sorted(k for m in (1, 2) for k in greedy([r for r in rows if r[0] == m])) and len(got) < 550


def test_a_million_points_at_one_x(spark):
    table = spark.range(1_000_000).selectExpr("1L AS model_id", "id AS constraint_id", "0.5D AS x", "id * 4e-4 AS y", "0D AS z")
    assert grouping.remove_collocated(table, ("model_id",)).count() == 333_334


def test_evaluation_leaves_the_callers_cache(spark):
    rows = [(1, "interface", i, float(i), float(i % 2), 0.0, 0.0, float(i % 3), None, None, None) for i in range(6)]
    constraints = spark.createDataFrame(rows, "model_id long, category string, constraint_id long, x double, y double, z double, c double, level double, vx double, vy double, vz double")
    models = fitting.fit(constraints, Parameters(CONTINUOUS)).persist()
    at = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5)], "model_id long, query_id long, x double, y double, z double")
    assert evaluation.evaluate(models, at).count() == 1 and models.storageLevel.useMemory
    models.unpersist()
