from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.errors import FieldError
from orogen.functions import kernels as K
from orogen.functions import orientation as O
from orogen.operators import dense, evaluation, fitting, grouping, quadratic, spatial
from orogen.parameters import CONTINUOUS, LAJAUNIE, SINGLE_SURFACE, STRATIGRAPHIC, VECTOR, Parameters

W = (0.25, 0.75, 0.5)
COLUMNS = "model_id long, category string, constraint_id long, x double, y double, z double, c double, level double, vx double, vy double, vz double"


def bits(x: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", x))[0]


def constraints(spark, interfaces=(), planars=(), tangents=(), model_id=1):
    rows = [(model_id, "interface", i, *map(float, p), 0.0, float(v), None, None, None) for i, (p, v) in enumerate(interfaces)]
    rows += [(model_id, k, i, *map(float, p), 0.0, None, *map(float, v)) for k, some in (("planar", planars), ("tangent", tangents)) for i, (p, v) in enumerate(some)]
    return spark.createDataFrame(rows, COLUMNS)


def at(spark, points=(W,), model_id=1):
    return spark.createDataFrame([(model_id, i, *map(float, p)) for i, p in enumerate(points)], "model_id long, query_id long, x double, y double, z double")


def field(spark, rows, parameters, points=(W,)):
    models = fitting.fit(rows, parameters)
    value = {r.query_id: r.value for r in evaluation.evaluate(models, at(spark, points)).collect()}
    slope = {r.query_id: (r.gx, r.gy, r.gz) for r in evaluation.evaluate(models, at(spark, points), gradient=True).collect()} if parameters.kernel != K.LINEAR else None
    return models.first(), value, slope


CONTINUOUS_SITES = [((0, 0, 0), 1), ((2, 0, 0), -0.5), ((0, 3, 0), 2.25), ((0, 0, 4), -1.75), ((1.5, -2, 2.5), 0.75)]
PLANARS = [((1, 2, 3), (0.6, 0, 0.8)), ((-2, 1, 0.5), (0, 0.8, 0.6)), ((0.5, -1, 2), (0.36, -0.48, 0.8))]
HORIZON = [((0, 0, 0), 30), ((2, 0, 0), 30), ((0, 3, 0), 30), ((0, 0, 4), 30)]


def test_single_surface(spark):
    base = [((0, 0, 0), 0), ((1, 0, 0), 0), ((0, 1, 0), 0), ((1, 1, 0), 0)]
    _, value, slope = field(spark, constraints(spark, base, [((0.5, 0.5, 0), (0, 0, 1))]), Parameters(SINGLE_SURFACE))
    assert value[0] == pytest.approx(0.5, abs=1e-12) and slope[0] == pytest.approx((0, 0, 1), abs=1e-12)


def test_lajaunie(spark):
    more = [((5, 1, 1), 20), ((6, 2, 1), 20), ((7, -1, 2), 10)]
    _, value, slope = field(spark, constraints(spark, HORIZON + more, PLANARS[:1], [((-1, 2, 1), (0.2, 0.7, 0.1))]), Parameters(LAJAUNIE))
    assert value[0] == pytest.approx(bits(0x3FB17133D7C05E86), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FA9CEF53CB22C2B, 0xBFA600938A9A2F5C, 0xBFCE52AFDD98707A)], abs=1e-8)


def test_lajaunie_with_one_level(spark):
    _, value, slope = field(spark, constraints(spark, HORIZON, PLANARS[:1]), Parameters(LAJAUNIE))
    assert value[0] == pytest.approx(bits(0x3FEC10F9D2E29C4A), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FA65F27D256BC1C, 0xBFAAF1837D945DA0, 0xBFCF96397E7EAA36)], abs=1e-8)


@pytest.mark.parametrize(
    ("kernel", "want"),
    [
        (K.CUBIC, 0x3FF21391A86D8A8D), (K.GAUSSIAN, 0x3F9EEC0A0E17F202), (K.MULTIQUADRIC, 0x3FE6E775983FCE58), (K.MULTIQUADRIC_CUBIC, 0x3FF1D7D461E51C37), (K.INVERSE_MULTIQUADRIC, 0x3FED1D74B8DC8B20),
        (K.THIN_PLATE, 0x3FE7445B91E8A342), (K.LINEAR, 0x3FE78D8358F309C4), (K.WENDLAND, 0x3FCD7FF46CDB6E64), (K.MATERN, 0x3FE8166665D705B4),
    ],
)
def test_continuous_property_with_each_kernel(spark, kernel, want):
    _, value, _ = field(spark, constraints(spark, CONTINUOUS_SITES), Parameters(CONTINUOUS, kernel, shape=2.0))
    assert value[0] == pytest.approx(bits(want), abs=2e-10)


def test_continuous_gradient(spark):
    _, _, slope = field(spark, constraints(spark, CONTINUOUS_SITES), Parameters(CONTINUOUS))
    assert slope[0] == pytest.approx([bits(x) for x in (0xBFE7F9ECD70BDD0F, 0x3FD98D71533F4E3E, 0x3FBA5E421840A4E0)], abs=1e-9)


def test_vector_field(spark):
    _, value, slope = field(spark, constraints(spark, planars=PLANARS), Parameters(VECTOR))
    assert value[0] == pytest.approx(bits(0xBFC26789DA3F9380), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FCD628D517A9EAF, 0x3FCACA9278ECA8F8, 0x3FE60BAA7247F0F4)], abs=1e-8)


def test_smoothing_overwrites_the_diagonal(spark):
    rows = constraints(spark, [((0, 0, 0), -1), ((2, 1, 3), 2)], PLANARS[:1], [((-1, 2, 1), (0.2, 0.7, 0.1))])
    _, value, slope = field(spark, rows, Parameters(SINGLE_SURFACE, smoothing=0.75))
    assert value[0] == pytest.approx(bits(0xBFE5E30880D3FF4F), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FDE7399F2324D80, 0xBFC68F72924E78E2, 0x3FE5813C5C3990DD)], abs=1e-8)


def test_constant_with_order_0(spark):
    rows = constraints(spark, [((0, 0, 0), 3), ((1, 0, 0), 3), ((0, 1, 0), 3), ((0, 0, 1), 3)])
    _, value, slope = field(spark, rows, Parameters(SINGLE_SURFACE, polynomial_order=0), [W, (9, -4, 2)])
    assert list(value.values()) == pytest.approx([3.0, 3.0]) and np.allclose(list(slope.values()), 0)


MORE = [((5, 1, 1), 20), ((7, -1, 2), 10)]


def with_inequalities(spark, some):
    rows = [(1, "inequality", i, *map(float, p), 0.0, float(v), None, None, None) for i, (p, v) in enumerate(some)]
    return constraints(spark, HORIZON + MORE, PLANARS[:1]).unionByName(spark.createDataFrame(rows, COLUMNS))


def test_single_surface_with_inequalities(spark):
    model, value, slope = field(spark, with_inequalities(spark, [((3, -2, 2), 1), ((4, 2, -1), -1)]), Parameters(SINGLE_SURFACE))
    assert model.iterations == 9 and value[0] == pytest.approx(bits(0x404068505733409F), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FE9ECC8119E9754, 0x3FE3CC95A65D5675, 0x400B0675074328A5)], abs=1e-8)


def test_stratigraphic(spark):
    _, value, slope = field(spark, with_inequalities(spark, [((3, -2, 2), 25), ((4, 2, -1), 5)]), Parameters(STRATIGRAPHIC))
    assert value[0] == pytest.approx(bits(0xBFC225A5E3C21329), abs=1e-9)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FBAF56640FD4EBD, 0xBFA9238F043FE56E, 0xBFD0454C51D39C86)], abs=1e-8)
    assert fitting.fit(with_inequalities(spark, [((3, -2, 2), 20)]), Parameters(STRATIGRAPHIC)).first().error == "InvalidInputData"


@pytest.mark.parametrize(("model", "want"), [(SINGLE_SURFACE, 0xBFC3DA1FB38BE001), (LAJAUNIE, 0xBFC3DA1F8F9C5EE9)])
def test_restricted(spark, model, want):
    rows = constraints(spark, HORIZON, PLANARS[:1])
    _, value, slope = field(spark, rows, Parameters(model, restricted=True, interface_uncertainty=0.25, angular_uncertainty=8.0))
    assert value[0] == pytest.approx(bits(want), abs=1e-7)
    assert slope[0] == pytest.approx([bits(x) for x in (0x3FAAA5A00C4CC82A, 0xBFA5362FA47DF96A, 0xBFCAA33520C9AE36)], abs=1e-6)


def test_quadratic_programs():
    half, one = np.array([[1.0, 0]]), np.array([[1.0, 1]])
    x, iterations = quadratic.predictor_corrector(np.eye(2), one, np.array([1.0]), half, np.array([0.2]))
    assert x == pytest.approx([0.5, 0.5]) and iterations == 12
    assert quadratic.predictor_corrector(np.eye(2), one, np.array([1.0]), half, np.array([0.8]))[0] == pytest.approx([0.8, 0.2])
    assert quadratic.bounded(np.diag([1.0, 2]), np.eye(2), np.array([0.5, -2]), np.ones(2))[0] == pytest.approx([0.5, -1], abs=1e-6)
    with pytest.raises(FieldError, match="InfeasibleSolution"):
        quadratic.bounded(np.eye(1), np.eye(1), np.ones(1), np.zeros(1))


def test_errors_are_rows(spark):
    one = constraints(spark, planars=PLANARS[:1])
    assert fitting.fit(one, Parameters(VECTOR)).first().error == "SingularSystem"
    assert fitting.fit(constraints(spark, CONTINUOUS_SITES, PLANARS), Parameters(CONTINUOUS)).first().error == "EqualityVectorOutOfBounds"
    assert fitting.fit(one, Parameters(SINGLE_SURFACE)).first().error == "NoInterfaceData"
    assert evaluation.evaluate(fitting.fit(one, Parameters(SINGLE_SURFACE)), at(spark)).first().value is None
    with pytest.raises(FieldError):
        fitting.fit(one, Parameters(polynomial_order=3))


def test_both_ways_of_evaluation_agree(spark, monkeypatch):
    models = fitting.fit(constraints(spark, CONTINUOUS_SITES), Parameters(CONTINUOUS))
    points = at(spark, [(k / 7, k / 5, -k / 3) for k in range(50)])
    near = sorted(map(tuple, evaluation.evaluate(models, points).collect()))
    monkeypatch.setattr(evaluation, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(evaluation, "PART_ROWS", 9)
    assert sorted(map(tuple, evaluation.evaluate(models, points).collect())) == near


def test_lu():
    assert dense.solve_lu(np.array([[4.0, 1], [1, 3]]), np.array([1.0, 2])) == pytest.approx([bits(0x3FB745D1745D1746), bits(0x3FE45D1745D1745D)], abs=1e-15)
    assert dense.solve_lu(np.array([[1.0, 2], [2, 4]]), np.array([3.0, 6])).tolist() == [3.0, 0.0]
    with pytest.raises(FieldError, match="SingularSystem"):
        dense.solve_lu(np.array([[1.0, 2], [2, 4]]), np.array([3.0, 7]))


def test_kernel_expressions_equal_the_arithmetic(spark):
    points = [(-1.25, 0.5, 2.0, 0.0), (0.75, -0.25, 1.0, 0.0), (0.1, 0.2, 0.3, 0.4)]
    rows = spark.createDataFrame([((*a,), (*b,)) for a in points for b in points if a != b], "a struct<x:double,y:double,z:double,c:double>, b struct<x:double,y:double,z:double,c:double>")
    unit = np.eye(3)
    for kernel in K.KERNELS:
        p, s = K.pair("a", "b"), 0.7
        columns = [K.value(kernel, p, s)]
        if kernel != K.LINEAR:
            columns += [*K.gradient(kernel, p, s), *(h for line in K.hessian(kernel, p, s) for h in line)]
        for r in rows.select("a", "b", F.array(*columns).alias("v")).collect():
            left, right = np.array(r.a), np.array(r.b)
            if kernel in (K.THIN_PLATE, K.WENDLAND) and left[3] != right[3]:
                continue  # with a fourth coordinate their second derivatives are defined by place alone
            one = lambda x, d=None: dense.Terms.build([[(1.0, x, d)]])
            want = [dense.kernel_matrix(one(left), one(right), kernel, s)[0, 0]]
            if kernel != K.LINEAR:
                want += [dense.kernel_matrix(one(left, unit[i]), one(right), kernel, s)[0, 0] for i in range(3)]
                want += [dense.kernel_matrix(one(left, unit[i]), one(right, unit[j]), kernel, s)[0, 0] for i in range(3) for j in range(3)]
            assert r.v == pytest.approx(want, rel=1e-9, abs=1e-12), kernel
    with pytest.raises(K.LinearDerivativeUnavailable):
        K.gradient(K.LINEAR, K.pair("a", "b"), 1.0)


def test_orientation(spark):
    row = spark.range(1).select(
        O.normal_of(F.lit(30.0), F.lit(40.0), F.lit(0)).alias("n"), O.normal_bounds(F.lit(30.0), F.lit(40.0), F.lit(10.0), F.lit(5.0)).alias("b"), O.angle_bounds(F.lit(10.0)).alias("a"), O.angle_bounds(F.lit(-10.0)).alias("m")
    ).first()
    assert tuple(row.n) == pytest.approx((0.5566703992264194, -0.3213938048432696, 0.766044443118978))
    assert (row.b.x_lo, row.b.y_lo, row.b.z_lo) == pytest.approx((0.439385041770705, -0.4545194776720436, 0.7071067811865476))
    assert (row.b.x_hi, row.b.y_hi, row.b.z_hi) == pytest.approx((0.6644630243886747, -0.19617469496901105, 0.8191520442889918))
    assert tuple(row.a) == pytest.approx((0, 0.34729635533386083)) and tuple(row.m) == pytest.approx((-0.3472963553338606, 0))
    normals = [(1.0, 0.0, 0.0, 90, 360, 0), (0.0, 1.0, 0.0, 90, 270, 0), (-1.0, 0.0, 0.0, 90, 180, 0), (0.0, -1.0, 0.0, 90, 90, 0), (0.0, 0.0, 1.0, 0, 360, 0), (0.0, 0.0, -1.0, 180, 360, 1)]
    df = spark.createDataFrame(normals, "x double, y double, z double, dip int, strike int, polarity int")
    for r in df.select("*", O.dip_of_normal(F.col("z")).alias("d"), O.strike_of_normal(F.col("x"), F.col("y")).alias("s"), O.polarity_of_normal(F.col("z")).alias("p")).collect():
        assert (r.d, r.s, r.p) == pytest.approx((r.dip, r.strike, r.polarity))


def test_collocated_rows_are_compared_with_the_last_kept(spark):
    rows = spark.createDataFrame([(1, "interface", i, x, 0.0, 0.0) for i, x in enumerate((0.0, 0.0005, 0.001, 0.0015))], "model_id long, category string, constraint_id long, x double, y double, z double")
    assert sorted(r.constraint_id for r in grouping.remove_collocated(rows).collect()) == [0, 2]


def test_metrics_leave_out_collocated_points(spark):
    points = spark.createDataFrame([(1, i, x, 0.0, 0.0, 0.0) for i, x in enumerate((0.0, 0.0005, 4.0))], "model_id long, idx long, x double, y double, z double, c double")
    assert spatial.metrics(points).first().resolution == 2.0


def test_spatial(spark):
    points = spark.createDataFrame([(1, i, *map(float, p), 0.0) for i, p in enumerate([(0, 0, 0), (3, 4, 0), (-3, -4, 0)])], "model_id long, idx long, x double, y double, z double, c double")
    r = spatial.farthest_pair(points).first()
    assert (r.i, r.j, r.distance) == (1, 2, 10.0)
    line = spark.createDataFrame([(1, i, x, 0.0, 0.0, 0.0) for i, x in enumerate((0.0, 0.0, 4.0))], points.schema)
    assert spatial.average_nearest(line).first().average == pytest.approx(4 / 3)
    assert spatial.average_nearest(line.limit(1)).first().average == 0.0
    assert [r.idx for r in spatial.extremal_points(points).orderBy("rank").collect()] == [2, 1, 0]


def test_stream_scoring(spark, tmp_path):
    from orogen.streaming import scored_stream

    models = fitting.fit(constraints(spark, CONTINUOUS_SITES), Parameters(CONTINUOUS))
    points = at(spark, [(k / 7, k / 5, -k / 3) for k in range(20)])
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    done = scored_stream(models, stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, evaluation.evaluate(models, points).collect()))


def test_entry_has_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reconstruction_and_what_follows_a_fit(spark):
    from orogen.operators import layout, reconstruction

    rows = constraints(spark, HORIZON, PLANARS[:1]).persist()
    restricted = Parameters(LAJAUNIE, restricted=True, interface_uncertainty=0.25, angular_uncertainty=8.0)
    models = fitting.fit(rows, restricted).persist()
    after = reconstruction.reconstructed(models, restricted).persist()
    r = reconstruction.witnesses(models, after, at(spark)).first()
    assert r.source == pytest.approx(bits(0xBFC3DA1F8F9C5EE9), abs=1e-7) and r.reconstructed == pytest.approx(bits(0x3FEB99841A674D4B), abs=1e-6)
    assert (r.reconstructed_gx, r.reconstructed_gy, r.reconstructed_gz) == pytest.approx([bits(x) for x in (0x3FAAA59F4D2703DC, 0xBFA536304179F65C, 0xBFCAA3353C85FFE8)], abs=1e-6)
    iso = reconstruction.iso_values(after, rows).collect()
    assert [(i.level, i.reference, i.members) for i in iso] == [(30.0, 0, 4)] and iso[0].iso_value == pytest.approx(bits(0x3FEFF5BC3BBB0AFA), abs=1e-6)
    before, now = ({p.dof: p.prediction for p in reconstruction.predictions(m).collect()} for m in (models, after))
    assert before == pytest.approx(now, abs=1e-9) and len(before) == 6
    told = reconstruction.evidence(models, rows, restricted).collect()
    assert len(told) == 6 and all(t.accepted and t.lower - 1e-6 <= t.prediction <= t.upper + 1e-6 for t in told)
    assert {(s.section, s.start, s.stop) for s in layout.sizes(rows, restricted).collect()} == {("increment", 0, 3), ("planar", 3, 6)}
    # a linear model has nothing to reconstruct
    assert reconstruction.reconstructed(fitting.fit(rows, Parameters(LAJAUNIE)), Parameters(LAJAUNIE)).first().error == "InvalidInputData"


def test_layout_of_horizons(spark):
    from orogen.operators import layout, reconstruction

    rows = with_inequalities(spark, [((3, -2, 2), 25), ((4, 2, -1), 5)])
    found = layout.dofs(rows, Parameters(STRATIGRAPHIC)).orderBy("dof").collect()
    short = lambda c, i: None if c is None else ("i" if c == "inequality" else "") + str(i)
    # interfaces by place: (0,0,0) 0, (0,0,4) 3, (0,3,0) 2, (2,0,0) 1
    assert [(short(f.first_category, f.first_id), short(f.second_category, f.second_id)) for f in found if f.section != "planar"] == [("0", "4"), ("4", "5"), ("0", "i0"), ("i0", "4"), ("5", "i1"), ("0", "3"), ("0", "2"), ("0", "1")]
    assert [f.dof for f in found] == list(range(11)) and [f.role for f in found] == ["inequality"] * 5 + ["equality"] * 6
    told = reconstruction.evidence(fitting.fit(rows, Parameters(STRATIGRAPHIC)), rows, Parameters(STRATIGRAPHIC), 1e-5).collect()
    assert len(told) == 11 and all(t.accepted for t in told)
    assert [e.error for e in layout.errors(with_inequalities(spark, [((3, -2, 2), 20)]), Parameters(STRATIGRAPHIC)).collect()] == ["InvalidInputData"]


def test_refused_rows_and_categories(spark):
    from orogen.sources import tables

    rows = constraints(spark, [((0, 0, 0), 1), ((0, 0, float("nan")), 1), ((3, 0, 0), 1)], tangents=[((0, 0, 0), (0, 0, 0)), ((0, 0, 0), (0, 0, 1))])
    assert sorted((r.category, r.constraint_id, r.error) for r in tables.with_error(rows).filter("error is not null").collect()) == [("interface", 1, "NonFiniteInput"), ("tangent", 0, "InvalidInputData")]
    assert [r.e for r in spark.createDataFrame([(0,), (1,), (2,), (None,)], "p int").select(O.polarity_error(F.col("p")).alias("e")).collect()] == [None, None, "InvalidInputData", "InvalidInputData"]
    near = constraints(spark, [((0, 0, 0), 1), ((0.0005, 0, 0), 1), ((3, 0, 0), 1)])
    assert [(r.category, r.removed) for r in grouping.removed(near).collect()] == [("interface", 1)]
    assert {(r.category, r.average) for r in spatial.average_nearest_by_category(constraints(spark, [((0, 0, 0), 1), ((2, 0, 0), 1)], PLANARS[:1])).collect()} == {("interface", 2.0), ("planar", 0.0)}
    assert spatial.bounds_and_resolution(near).first().resolution == 1.5
