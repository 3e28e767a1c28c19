"""Names and codes of models, kernels and errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orogen.errors import CATEGORIES, PUBLIC_CATEGORIES, FieldError, public_category
from orogen.functions.kernels import KERNELS
from orogen.parameters import LAJAUNIE, MODEL_CODES, Parameters


def test_names_and_codes():
    assert [Parameters.parsed(code).model for code in range(1, 6)] == list(MODEL_CODES.values()) == [Parameters.parsed(name).model for name in MODEL_CODES.values()]
    assert [Parameters.parsed(1, kernel).kernel for kernel in KERNELS] == list(KERNELS)
    for bad in (0, 6, "single_surface", ""):
        with pytest.raises(FieldError, match="UnknownModel"):
            Parameters.parsed(bad)
    for bad in ("R3", "gaussian", "r3 ", ""):
        with pytest.raises(FieldError, match="UnknownRbf"):
            Parameters.parsed(1, bad)


def test_public_categories(spark):
    assert len(set(PUBLIC_CATEGORIES)) == 23
    own = spark.createDataFrame([(e, q) for e in (*CATEGORIES, None) for q in (False, True)], "error string, quadratic boolean")
    found = {(r.error, r.quadratic): r for r in own.select("error", "quadratic", *(public_category(F.col("error"), F.col("quadratic"), b, m).alias(n) for n, b, m in (("plain", False, ""), ("bounded", True, ""), ("lajaunie", True, LAJAUNIE)))).collect()}
    assert found["SingularSystem", False].plain == "LinearSolverFailure" and found["IterationLimit", True].plain == "PredictorCorrectorSolverFailure"
    assert found["IterationLimit", True].bounded == "LoqoSolverFailure" and found["IterationLimit", True].lajaunie == "PredictorCorrectorSolverFailure"
    assert found["NoInterfaceData", False].plain == "NoInterfaceData" and found["UnsupportedKernel", False].plain == "BasisFunctionSetupFailure"
    assert all(found[e, q].plain is None for e in ("NonFiniteInput", "ModelTooLarge", "KernelLayoutMismatch", "EqualityVectorOutOfBounds", None) for q in (False, True))
    assert {r.plain for r in found.values()} | {r.bounded for r in found.values()} <= {*PUBLIC_CATEGORIES, None}
