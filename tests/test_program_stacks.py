"""Quadratic programs of one shape are solved as a stack, each as it is alone."""

from __future__ import annotations

import numpy as np
import pytest

from orogen.errors import FieldError
from orogen.operators import fitting, layout, quadratic
from orogen.parameters import SINGLE_SURFACE, Parameters


def _programs(m: int):
    rng = np.random.default_rng(5)
    half = rng.standard_normal((m, 6, 6))
    return half @ half.transpose(0, 2, 1) + np.eye(6), rng.standard_normal((m, 2, 6)), rng.standard_normal((m, 2)), rng.standard_normal((m, 3, 6)), rng.standard_normal((m, 3))


def test_a_stack_gives_what_each_program_gives_alone():
    k, a, b, c, d = _programs(40)
    k[3, 0, 0] = np.nan
    # no point meets both; rows alike, so the system has no inverse
    c[7, 1], d[7, :2] = -c[7, 0], 5.0
    a[9, 1], b[9, 1] = a[9, 0], b[9, 0]
    found = quadratic.constrained_all(k, a, b, c, d)
    kinds = set()
    for i, one in enumerate(found):
        try:
            want = quadratic.constrained(k[i], a[i], b[i], c[i], d[i])
        except FieldError as e:
            assert isinstance(one, FieldError) and one.category == e.category
            kinds.add(e.category)
            continue
        assert one.x == pytest.approx(want.x, rel=1e-6, abs=1e-6) and one.dual == pytest.approx(want.dual, rel=1e-4, abs=1e-4)
        assert one.slack == pytest.approx(want.slack, rel=1e-4, abs=1e-4)
    assert len(kinds) >= 2


def _rows(k: int, flat: bool = False) -> fitting.Rows:
    """Four interfaces and an inequality beside them; flat: the four lie in a plane."""
    base = np.array([[0, 0, 0], [(10 + k % 7) / 10, 0.1, 0.0 if flat else k % 3 / 10], [0.3, (4 + k % 5) / 10, 0.0 if flat else 0.2], [0.5, -0.2, 0.0 if flat else 0.15]])
    point = np.concatenate([[[(2 + k % 11) / 10, 0.05, 0.4]], base, base])
    section = np.array([layout.INEQUALITY] + [layout.INTERFACE] * 4 + [layout.BASIS] * 4)
    level, sign = 1.0 + k % 5, -1.0 if k % 2 == 0 else 1.0
    bounds = np.array([[sign, 0.0, np.nan, np.nan]] + [[np.nan, np.nan, np.nan, level]] * 8)
    nan = np.full((9, 4), np.nan)
    return fitting.Rows(section, np.concatenate([point, np.zeros((9, 1))], axis=1), nan, nan[:, :3], bounds, np.array([None] * 9, object))


def test_models_with_inequalities_are_fitted_together(monkeypatch):
    p = Parameters(SINGLE_SURFACE).checked()
    models = [(k, _rows(k)) for k in range(30)]
    alone = {k: fitting.fit_many([(k, rows)], p)[0] for k, rows in models}

    def refused(*_):
        raise AssertionError("a program was solved alone")

    monkeypatch.setattr(quadratic, "constrained", refused)
    for row in fitting.fit_many(models, p):
        want = alone[row["model_id"]]
        assert row["error"] is None and want["error"] is None
        for c in ("weight", "basis_points", "point", "dual", "slack"):
            assert row[c] == pytest.approx(want[c], rel=1e-4, abs=1e-5)


def test_a_model_that_cannot_be_set_up_fails_alone():
    p = Parameters(SINGLE_SURFACE).checked()
    got = {r["model_id"]: r["error"] for r in fitting.fit_many([(1, _rows(1)), (2, _rows(2, flat=True)), (3, _rows(3))], p)}
    alone = {k: fitting.fit_many([(k, rows)], p)[0]["error"] for k, rows in ((1, _rows(1)), (2, _rows(2, flat=True)), (3, _rows(3)))}
    assert got == alone and got[1] is None and got[3] is None
