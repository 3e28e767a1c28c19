"""Linear models of more unknowns than a task takes, solved by Spark over all of their rows: no task and no driver holds a model's matrix.

The system [K P; P' 0] [w; c] = [f; 0] is solved on the subspace P'w = 0, on which a kernel is definite, by conjugate gradients. Products
with K are sums over the squares of assembly.squares, so an iteration costs n * n kernel values and no memory for them. Steps are
the model's alone; P is orthonormalised by Cholesky factors of sums (twice). It starts at w = 0: values that the polynomial reproduces
take no product at all. A model whose residual does not fall below TOLERANCE of its values within ITERATIONS, or whose polynomial is singular, gets
the error; it is never given back half solved.

Vectors are tables (model_id, row, ...), written at each iteration; what the driver gets is some numbers for each of these models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..parameters import Parameters
from . import anisotropy, assembly, fitting
from .shared import written

TOLERANCE, ITERATIONS = 1e-10, 500


def _sums(found: DataFrame, vectors: list[Column]) -> dict[int, np.ndarray]:
    """The sums of some columns for each model."""
    rows = found.groupBy("model_id").agg(*(F.sum(v).alias(f"s{k}") for k, v in enumerate(vectors)), F.lit(0).alias("end")).collect()
    return {r["model_id"]: np.array(r[1:-1], float) for r in rows}


def _with(found: DataFrame, known: dict[int, np.ndarray | list], name: str) -> DataFrame:
    """found with an array of numbers of its model."""
    rows = [(int(i), [float(x) for x in np.ravel(v)]) for i, v in known.items()]
    own = found.sparkSession.createDataFrame(rows, f"model_id long, {name} array<double>")
    return found.join(F.broadcast(own), "model_id")


def _dot(a: str, b: str, m: int, start: int = 0) -> Column:
    return sum((F.col(a)[k] * F.col(b)[start + k] for k in range(m)), F.lit(0.0))


def _orthonormal(found: DataFrame, m: int) -> tuple[DataFrame, dict[int, np.ndarray], set[int]]:
    """found with orthonormal columns q in place of its polynomial's, the triangle that leads back, and the models without one."""
    triangle: dict[int, np.ndarray] = {}
    singular: set[int] = set()
    found = found.withColumn("q", F.col("poly"))
    at = [(i, j) for i in range(m) for j in range(i + 1)]
    for _ in range(2):
        turn = {}
        for model, s in _sums(found, [F.col("q")[i] * F.col("q")[j] for i, j in at]).items():
            gram = np.zeros((m, m))
            for (i, j), v in zip(at, s, strict=True):
                gram[i, j] = gram[j, i] = v
            try:
                scale = np.sqrt(np.diag(gram))
                low = np.linalg.cholesky(gram / scale[:, None] / scale) * scale[:, None]
                turn[model] = np.linalg.inv(low).T
                triangle[model] = low.T @ triangle.get(model, np.eye(m))
            except np.linalg.LinAlgError:
                singular.add(model)
            if model in turn and not np.isfinite(turn[model]).all():
                singular.add(model)
                del turn[model]
        found = _with(found, turn, "turn").withColumn("q", F.array(*(sum((F.col("q")[i] * F.col("turn")[i * m + j] for i in range(m)), F.lit(0.0)) for j in range(m)))).drop("turn")
    return found, triangle, singular


def _projected(found: DataFrame, name: str, m: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """found with a column less its part in the polynomial's span, and the parts' coefficients by q. Twice, for rounding."""
    total: dict[int, np.ndarray] = {}
    if not m:
        return found, total
    for _ in range(2):
        part = _sums(found, [F.col("q")[k] * F.col(name) for k in range(m)])
        total = {model: total.get(model, 0) + s for model, s in part.items()}
        found = written(_with(found, part, "part").withColumn(name, F.col(name) - _dot("q", "part", m)).drop("part"), "projected")
    return found, total


def _product(found: DataFrame, name: str, p: Parameters) -> DataFrame:
    """model_id, row, product: the kernel block times a column."""
    each = assembly.kernel_entries(found, p, name)
    return each.groupBy("model_id", "row").agg(F.sum(F.col("value") * F.col(name)).alias("product"))


def models(functionals: DataFrame, parameters: Parameters) -> DataFrame:
    """The fitted models (fitting.MODELS) of assembly.functionals."""
    p, spark = parameters, functionals.sparkSession
    order, truncated = fitting.polynomial_of(p)
    columns = assembly.polynomial_columns(p)
    m = len(columns)
    own = functionals.withColumn("poly", F.array(*columns) if m else F.array().cast("array<double>")).withColumn("f", F.coalesce("value", F.lit(0.0)))
    found = written(own, "large")
    limit = {i: TOLERANCE * v[0] for i, v in {r["model_id"]: [r["top"]] for r in found.groupBy("model_id").agg(F.max(F.abs("f")).alias("top")).collect()}.items()}
    found, triangle, bad = _orthonormal(found, m) if m else (found.withColumn("q", F.col("poly")), {}, set())
    failed = dict.fromkeys(bad, "SingularSystem")
    found = found.withColumn("w", F.lit(0.0)).withColumn("r", F.col("f"))
    found, _ = _projected(found, "r", m)
    found = found.withColumn("p", F.col("r"))
    used = dict.fromkeys(limit, 0)
    for iteration in range(ITERATIONS + 1):
        now = {r["model_id"]: (r["rr"], r["top"]) for r in found.groupBy("model_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max(F.abs("r")).alias("top")).collect()}
        open_ = [i for i, (_, top) in now.items() if i not in failed and not top <= limit[i]]
        if not open_:
            break
        if iteration == ITERATIONS:
            failed |= dict.fromkeys(open_, "IterationLimit")
            break
        moving = found.filter(F.col("model_id").isin(open_))
        turned = moving.join(_product(moving, "p", p), ["model_id", "row"])
        turned, _ = _projected(turned, "product", m) if m else (written(turned, "product"), None)
        along = _sums(turned, [F.col("p") * F.col("product")])
        step = {}
        for i in open_:
            a = now[i][0] / along[i][0] if along[i][0] else np.nan
            if np.isfinite(a):
                step[i], used[i] = [a], iteration + 1
            else:
                failed[i] = "SingularSystem"
        if not step:
            break
        turned = _with(turned, step, "a").withColumn("w", F.col("w") + F.col("a")[0] * F.col("p")).withColumn("r", F.col("r") - F.col("a")[0] * F.col("product")).drop("a", "product")
        turned, _ = _projected(turned, "r", m) if m else (written(turned, "residual"), None)
        after = _sums(turned, [F.col("r") * F.col("r")])
        turned = _with(turned, {i: [after[i][0] / now[i][0]] for i in step}, "b").withColumn("p", F.col("r") + F.col("b")[0] * F.col("p")).drop("b")
        found = written(turned.unionByName(found.filter(~F.col("model_id").isin(list(step)))), "iteration")
    # the polynomial takes what the kernel leaves: of a model without weights all that it has of f
    bent = [i for i, k in used.items() if k]
    rest = found.withColumn("rest", F.col("f"))
    if bent and m:
        some = rest.filter(F.col("model_id").isin(bent))
        some = some.join(_product(some, "w", p), ["model_id", "row"]).withColumn("rest", F.col("f") - F.col("product")).drop("product")
        rest = some.unionByName(rest.filter(~F.col("model_id").isin(bent)))
    _, parts = _projected(rest, "rest", m)
    coefficient = {i: np.linalg.solve(triangle[i], c) if i not in failed else np.zeros(m) for i, c in parts.items()} if m else dict.fromkeys(limit, [])
    return _told(found, coefficient, failed, used, p, order, truncated, spark)


def _told(found: DataFrame, coefficient: dict, failed: dict[int, str], used: dict[int, int], p: Parameters, order: int, truncated: bool, spark) -> DataFrame:
    point = lambda side: F.array(*(F.col(f"{side}.{k}") for k in "xyzc"))
    two = F.col("second").isNotNull()
    direction = F.array(*(F.coalesce(F.col(f"direction.{k}"), F.lit(0.0)) for k in "xyz"))
    none = F.array(*[F.lit(0.0)] * 3)
    row = F.struct(
        "row", "w", F.when(two, F.array(F.lit(1.0), F.lit(-1.0))).otherwise(F.array(F.lit(1.0))).alias("k"), F.when(two, F.concat(point("first"), point("second"))).otherwise(point("first")).alias("at"), F.when(two, F.concat(none, none)).otherwise(direction).alias("to")
    )
    some = found.filter(~F.col("model_id").isin(list(failed))) if failed else found
    rows = some.groupBy("model_id").agg(F.array_sort(F.collect_list(row)).alias("t"), F.first("transform").alias("transform"))
    whole = _with(_with(rows, coefficient, "polynomial"), {i: [k] for i, k in used.items()}, "used")
    flat = lambda c: F.flatten(F.transform("t", lambda s: s[c]))
    owner = F.flatten(F.transform("t", lambda s: F.array_repeat(s["row"].cast("int"), F.size(s["k"]))))
    null = lambda kind: F.lit(None).cast(kind)
    good = whole.select(
        "model_id", null("string").alias("error"), F.lit(p.kernel).alias("kernel"), F.lit(float(p.shape)).alias("shape"), F.lit(order).alias("polynomial_order"), F.lit(truncated).alias("truncated"), "transform",
        owner.alias("owner"), flat("k").alias("coefficient"), flat("at").alias("point"), flat("to").alias("direction"), F.transform("t", lambda s: s["w"]).alias("weight"), "polynomial",
        (F.size("t") + F.size("polynomial")).alias("n_dofs"), null("array<double>").alias("basis_points"), F.col("used")[0].cast("int").alias("iterations"), null("array<double>").alias("dual"), null("array<double>").alias("slack"), null("double").alias("tolerance"),
    )
    refused = spark.createDataFrame([tuple(fitting._row(i, p, why).values()) for i, why in failed.items()], fitting.MODELS)
    return good.unionByName(refused)


def large_of(constraints: DataFrame, parameters: Parameters, most: int) -> tuple[DataFrame, list[int]] | None:
    """The functionals of the linear models of more than `most` unknowns, and their ids; null if there are none. A constraint has three unknowns
    at most, so a count tells first whether the layout has to be looked at."""
    if parameters.anisotropy and parameters.kernel not in anisotropy.KERNELS:
        return None
    candidates = [r["model_id"] for r in constraints.groupBy("model_id").count().filter(F.col("count") * 3 + 10 > most).collect() if r["model_id"] is not None]
    if not candidates:
        return None
    found = assembly.functionals(constraints.filter(F.col("model_id").isin(candidates)), parameters).filter(F.col("n") + 10 > most)
    found = written(found, "functionals")
    ids = [r["model_id"] for r in found.select("model_id").distinct().collect()]
    return (found, ids) if ids else None
