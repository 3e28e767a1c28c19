"""What follows a fit: iso-values of the levels, evidence for inequalities and bounds, and the ordinary linear field that takes the
values of a quadratic one.

A quadratic fit has a modified kernel, which annihilates planes. Reconstruction predicts every unknown's functional with that field
(predictions) and solves the ordinary system, kernel and polynomial, for these values. Predictions are evaluations of the field at the
functionals' points, summed by unknown; only the dense solve of each model lies in one task.

Models with an error keep it and give no rows elsewhere; a model without a modified kernel has nothing to reconstruct and gets
InvalidInputData.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FieldError
from ..parameters import LAJAUNIE, SINGLE_SURFACE, STRATIGRAPHIC, Parameters
from . import dense, fitting, grouping, layout
from .evaluation import evaluate


def references(constraints: DataFrame) -> DataFrame:
    """model_id, level, reference (constraint_id), x, y, z, members: the reference point of each level of the interfaces."""
    found = layout.placed(constraints.filter(F.col("category") == "interface"))
    known = grouping.with_references(found, F.struct("constraint_id"), "place").filter("is_reference")
    return known.select("model_id", F.col("at").alias("level"), F.col("constraint_id").alias("reference"), "x", "y", "z", "members")


def iso_values(models: DataFrame, constraints: DataFrame) -> DataFrame:
    """references with iso_value, the field there: what a horizon is drawn at."""
    known = references(constraints)
    at = evaluate(models, known.withColumnRenamed("reference", "query_id")).select("model_id", F.col("query_id").alias("reference"), F.col("value").alias("iso_value"))
    return known.join(at, ["model_id", "reference"])


def predictions(models: DataFrame) -> DataFrame:
    """model_id, dof, prediction: each unknown's functional of the model's own field."""
    one = F.explode(F.arrays_zip("owner", "coefficient", F.sequence(F.lit(0), F.size("owner") - 1).alias("term")))
    terms = models.filter("error is null and size(owner) > 0").select("model_id", "point", "direction", one.alias("t"))
    part = lambda c, width, k: F.element_at(c, F.col("t.term") * width + k + 1)
    terms = terms.select(
        "model_id", F.col("t.term").cast("long").alias("query_id"), F.col("t.owner").cast("long").alias("dof"), F.col("t.coefficient").alias("coefficient"),
        *(part("point", 4, k).alias(c) for k, c in enumerate("xyz")), *(part("direction", 3, k).alias(f"d{c}") for k, c in enumerate("xyz")),
    )
    directed = (F.col("dx") != 0) | (F.col("dy") != 0) | (F.col("dz") != 0)
    values = evaluate(models, terms.filter(~directed)).withColumnRenamed("value", "v")
    slopes = evaluate(models, terms.filter(directed), gradient=True)
    told = terms.join(values.unionByName(slopes, allowMissingColumns=True), ["model_id", "query_id"])
    along = F.coalesce(F.col("v"), F.col("gx") * F.col("dx") + F.col("gy") * F.col("dy") + F.col("gz") * F.col("dz"))
    return told.groupBy("model_id", "dof").agg(F.sum(F.col("coefficient") * along).alias("prediction"))


def evidence(models: DataFrame, constraints: DataFrame, parameters: Parameters, tolerance: float = 1e-6) -> DataFrame:
    """The layout's rows with prediction, slack (to the nearer bound, or from the value) and accepted within the tolerance: relations of
    layers, inequalities and bounds. dual and solver_slack are the solver's multiplier and slack of an inequality or of a lower bound,
    active means within the tolerance or the solver's;
    dual_upper and solver_slack_upper those of an upper bound, solver_tolerance what the solver lets an inequality miss; null where a row
    has none."""
    found = layout.dofs(constraints, parameters).join(predictions(models), ["model_id", "dof"])
    told = F.coalesce(F.col("sign"), F.lit(1.0)) * F.col("prediction")
    lower, upper = told - F.col("lower"), F.when(F.col("role") == "bounded", F.col("upper") - F.col("prediction"))
    above = F.when(F.col("role") == "bounded", F.col("prediction") - F.col("lower")).otherwise(lower)
    slack = F.when(F.col("role") == "equality", -F.abs(F.col("prediction") - F.col("value"))).otherwise(F.least(above, upper))
    solved = models.select("model_id", F.col("dual").alias("duals"), F.col("slack").alias("slacks"), F.col("tolerance").alias("solver_tolerance"))
    # inequalities are a model's first rows; bounds come twice, all lower ones before all upper ones
    upper_at = F.when(F.col("role") == "bounded", (F.size("duals") / 2).cast("int") + F.col("dof"))
    found = found.join(solved, "model_id", "left").withColumns({
        "dual": F.get("duals", F.col("dof")), "solver_slack": F.get("slacks", F.col("dof")), "dual_upper": F.get("duals", upper_at), "solver_slack_upper": F.get("slacks", upper_at),
    }).drop("duals", "slacks")
    return found.withColumn("slack", slack).withColumn("accepted", F.col("slack") >= -tolerance).withColumn("active", F.abs("slack") <= F.greatest(F.lit(tolerance), "solver_tolerance"))


def reconstructed(models: DataFrame, parameters: Parameters) -> DataFrame:
    """Models of the same schema whose ordinary field takes the values of the quadratic one at every unknown. Single surfaces keep
    their polynomial order, Lajaunie too but without the constant, horizons have first order without it."""
    parameters = parameters.checked()
    if parameters.model not in (SINGLE_SURFACE, LAJAUNIE, STRATIGRAPHIC):
        raise FieldError("InvalidInputData", f"{parameters.model} has no quadratic form")
    order = 1 if parameters.model == STRATIGRAPHIC else parameters.polynomial_order
    truncated = parameters.model != SINGLE_SURFACE
    smoothing = None if parameters.model == STRATIGRAPHIC else parameters.smoothing
    targets = predictions(models).groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dof", "prediction"))), lambda s: s["prediction"]).alias("target"))
    names = [f.name for f in models.schema.fields]

    def one(row: dict) -> dict:
        error = row["error"] or ("InvalidInputData" if row["basis_points"] is None else None)
        if error:
            return fitting._row(row["model_id"], parameters, error)
        terms = dense.Terms(np.array(row["owner"], np.int64), np.array(row["coefficient"], float), np.array(row["point"], float).reshape(-1, 4), np.array(row["direction"], float).reshape(-1, 3))
        transform = None if row["transform"] is None else np.array(row["transform"], np.float32).reshape(3, 3)
        values = np.bincount(terms.owner, (terms.direction != 0).any(axis=1)) == 0
        # single surfaces and increments come first; what has a direction is never smoothed
        matrix = fitting.system_matrix(terms, int(values.sum()), row["kernel"], row["shape"], transform, order, truncated, smoothing)
        right = np.zeros(len(matrix))
        right[: terms.size] = row["target"]
        weight = dense.solve_all(matrix[None], right[None])[0]
        if isinstance(weight, FieldError):
            return fitting._row(row["model_id"], parameters, weight.category)
        return {c: row[c] for c in names} | {"weight": weight[: terms.size], "polynomial": weight[terms.size :], "n_dofs": len(weight), "polynomial_order": order, "truncated": truncated, "basis_points": None}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame([one(r) for r in part.astype(object).where(part.notna(), None).to_dict("records")], columns=names)

    return models.join(targets, "model_id", "left").mapInPandas(run, fitting.MODELS)


def witnesses(models: DataFrame, after: DataFrame, points: DataFrame) -> DataFrame:
    """The scalars and gradients of the quadratic and of the reconstructed fields at points(model_id, query_id, x, y, z)."""
    out = points.select("model_id", "query_id")
    for name, some in (("source", models), ("reconstructed", after)):
        scalar = evaluate(some, points).withColumnRenamed("value", name)
        slope = evaluate(some, points, gradient=True).select("model_id", "query_id", *(F.col(f"g{k}").alias(f"{name}_g{k}") for k in "xyz"))
        out = out.join(scalar, ["model_id", "query_id"]).join(slope, ["model_id", "query_id"])
    return out
