"""Global anisotropy of each model from its planars, as columns.

The covariance is the sum of the normals' outer products: six sums, combined before the shuffle. Its eigenvalues come from Jacobi
rotations, folded with `aggregate` over a fixed sequence, so nothing leaves the JVM. The transform has the covariance's eigenvectors;
its factors are the roots of the eigenvalues over the least one, where the two least count as 1e-4 at least.

A model with fewer than two planars has the error InvalidInputData, one with a null or non-finite normal NonFiniteInput; both have no
transform. No rows give no rows; repeated planars count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.orientation import finite

#: The kernels that have an anisotropic form.
KERNELS = (K.CUBIC, K.GAUSSIAN, K.MULTIQUADRIC, K.THIN_PLATE, K.INVERSE_MULTIQUADRIC, K.LINEAR)
FLOOR, ROTATIONS = 1e-4, 30


def _product(x: str, y: str) -> str:
    """The product of two arrays of nine that are names."""
    return f"transform(sequence(0, 8), i -> {x}[i - i % 3] * {y}[i % 3] + {x}[i - i % 3 + 1] * {y}[3 + i % 3] + {x}[i - i % 3 + 2] * {y}[6 + i % 3])"


def _let(name: str, value: str, inner: str) -> str:
    """inner with value under a name, computed once."""
    return f"transform(array({value}), {name} -> {inner})[0]"


def _jacobi() -> str:
    """The fold: a goes to diagonal form, v gathers the rotations. Step k turns axes p and q by the lesser angle that makes a[p, q] zero."""
    angle = "case when s.a[3 * p + q] = 0 then 0D when s.a[4 * p] = s.a[4 * q] then pi() / 4 else atan(2 * s.a[3 * p + q] / (s.a[4 * q] - s.a[4 * p])) / 2 end"
    turn = "transform(sequence(0, 8), i -> case when i = 4 * p or i = 4 * q then cos(t) when i = 3 * p + q then sin(t) when i = 3 * q + p then -sin(t) when i % 4 = 0 then 1D else 0D end)"
    back = "transform(sequence(0, 8), i -> r[3 * (i % 3) + cast(i div 3 as int)])"
    whole = _let("r", turn, _let("b", back, _let("ar", _product("s.a", "r"), f"named_struct('a', {_product('b', 'ar')}, 'v', {_product('s.v', 'r')})")))
    step = _let("p", "if(k % 3 = 2, 1, 0)", _let("q", "if(k % 3 = 0, 1, 2)", _let("t", angle, whole)))
    identity = f"array({', '.join(f'{v}D' for v in K.IDENTITY)})"
    return f"aggregate(sequence(0, {ROTATIONS - 1}), named_struct('a', covariance, 'v', {identity}), (s, k) -> {step})"


def covariances(planars: DataFrame) -> DataFrame:
    """model_id, n, covariance (nine numbers, by rows), error."""
    sums = [F.sum(F.col(f"v{a}") * F.col(f"v{b}")).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    bad = F.count_if(~finite(*(F.col(f"v{a}") for a in "xyz"))).alias("bad")
    found = planars.groupBy("model_id").agg(F.count("*").alias("n"), bad, *sums)
    error = F.when(F.col("bad") > 0, "NonFiniteInput").when(F.col("n") < 2, "InvalidInputData")
    return found.select("model_id", "n", F.array("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz").alias("covariance"), error.alias("error"))


def transforms(planars: DataFrame) -> DataFrame:
    """model_id, error, eigenvalues (three, least first), plunge (the first one's vector), transform (nine, by rows) from vx, vy, vz."""
    found = covariances(planars).withColumn("s", F.expr(f"case when error is null then {_jacobi()} end"))
    axes = "array_sort(transform(sequence(0, 2), k -> named_struct('e', s.a[4 * k], 'k', k, 'v', array(s.v[k], s.v[3 + k], s.v[6 + k]))))"
    found = found.withColumn("axes", F.expr(axes)).withColumn("clamped", F.expr(f"array(greatest(axes[0].e, {FLOOR}D), greatest(axes[1].e, {FLOOR}D), axes[2].e)"))
    entry = " + ".join(f"sqrt(clamped[{k}] / clamped[0]) * axes[{k}].v[cast(i div 3 as int)] * axes[{k}].v[i % 3]" for k in range(3))
    whole = f"case when s is not null then transform(sequence(0, 8), i -> {entry}) end"
    return found.select("model_id", "error", F.expr("transform(axes, a -> a.e)").alias("eigenvalues"), F.expr("axes[0].v").alias("plunge"), F.expr(whole).alias("transform"))
