"""The layout of each model as a table: a row for each unknown, with its points, direction, role and right-hand side or bounds.

Everything is windows over rows that are dealt by model_id once, so a layout takes one shuffle however many sections it has. Points of a
category are numbered by place (x, y, z, then constraint_id); the first of a level is its reference.

Sections, in order: differences of neighbouring levels' references (sequenced), values of inequalities, differences of inequalities and
the references above and below them (lithology), values of interfaces, differences within a level (increment), three derivatives
for each planar, one for each tangent. Roles: equality (value is met), inequality (sign times the functional is at least lower),
bounded (lower to upper).

No rows give no rows. Null or non-finite places and other input that a model kind refuses are an error of the model (errors), not of
the run. Rows collocated with another are left out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orientation as O
from ..parameters import CONTINUOUS, LAJAUNIE, SINGLE_SURFACE, STRATIGRAPHIC, VECTOR, Parameters
from . import grouping, spatial

MODEL, SEQUENCED, INEQUALITY, LITHOLOGY, INTERFACE, INCREMENT, PLANAR, TANGENT, BASIS = range(-1, 8)
SECTIONS = ("sequenced", "inequality", "lithology", "interface", "increment", "planar", "tangent")
def dealt(constraints: DataFrame) -> DataFrame:
    """Dealt by model_id to a fixed number of parts: few small rows of costly models are not put together again."""
    return constraints.repartition(int(constraints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model_id")


def placed(constraints: DataFrame) -> DataFrame:
    """The cleaned constraints with place, their number in their category from 0."""
    order = Window.partitionBy("model_id", "category").orderBy(*(F.col(k) + 0.0 for k in "xyz"), "constraint_id")
    return grouping.remove_collocated(dealt(constraints)).withColumn("place", (F.row_number().over(order) - 1).cast("long"))


#: What a row may have beside its section, as SQL, and the type of each.
_FIELDS = {
    "k1": "double", "k2": "long", "first": "struct<category:string,constraint_id:bigint,x:double,y:double,z:double,c:double>", "second": "struct<category:string,constraint_id:bigint,x:double,y:double,z:double,c:double>", "axis": "int",
    "dx": "double", "dy": "double", "dz": "double", "sign": "double", "lower": "double", "upper": "double", "value": "double", "error": "string",
}


def _row(section: int, **values: str | float) -> str:
    """A layout row as SQL; what is not given is null."""
    return f"named_struct('section', {section}, " + ", ".join(f"'{k}', cast({values.get(k, 'null')} as {kind})" for k, kind in _FIELDS.items()) + ")"


def _error(p: Parameters) -> Column:
    """The category of a model's refusal from the counts of its rows, or null."""
    c = F.col
    bad = F.when(c("unplaced") > 0, "NonFiniteInput")
    if p.model == CONTINUOUS:
        return bad.when(c("planars") + c("tangents") > 0, "EqualityVectorOutOfBounds").when(c("interfaces") == 0, "NoInterfaceData")
    if p.model == VECTOR:
        return bad
    bad = bad.when(c("interfaces") == 0, "NoInterfaceData")
    if p.model == LAJAUNIE and not p.restricted:
        bad = bad.when(c("interfaces") == c("levels"), "InvalidInputData")
    if p.model == STRATIGRAPHIC:
        same = c("interfaces") - c("levels") + c("planars") + c("tangents")
        bad = bad.when(c("conflicts") > 0, "InvalidInputData").when((c("relations") == 0) | (same == 0), "InvalidInputData")
    return bad


def rows(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """The rows of every model in order of dof: one MODEL row with its error, the unknowns, and the BASIS rows, the points of the
    largest level, from which a modified kernel takes its four."""
    p, is_a = parameters, lambda *names: F.col("category").isin(*names)
    found = placed(constraints)
    if p.restricted and p.model in (SINGLE_SURFACE, STRATIGRAPHIC):
        # inequalities have no other end than the size of the model
        points = found.select("model_id", F.struct("category", "place").alias("idx"), "x", "y", "z", "c")
        found = found.join(spatial.largest_distance(points).withColumnRenamed("distance", "wide"), "model_id")
    else:
        found = found.withColumn("wide", F.lit(None).cast("double"))
    me = F.struct("category", "constraint_id", "x", "y", "z", "c")
    found = grouping.with_references(found.withColumn("me", me), F.col("me"), "place")
    counts = {
        "clashes": "count_if(is_reference) over (partition by model_id, at) > 0 and category = 'inequality'",
        "interfaces": "count_if(category = 'interface') over m", "planars": "count_if(category = 'planar') over m", "tangents": "count_if(category = 'tangent') over m", "levels": "count_if(is_reference) over m",
        "unplaced": "count_if(not finite) over m", "relations": "sum(if(is_reference and below is not null, 1, 0) + if(category = 'inequality', int(nearest_above is not null) + int(nearest_below is not null), 0)) over m",
        "largest": "max(if(is_reference and members > 1, struct(members, at), null)) over m", "nth": "row_number() over (partition by model_id order by category, place)",
    }
    found = found.withColumn("finite", O.finite(*(F.col(k) for k in "xyzc")))
    found = found.selectExpr("*", *(f"{v.replace('over m', 'over (partition by model_id)')} as {k}" for k, v in counts.items())).selectExpr("*", "count_if(clashes) over (partition by model_id) as conflicts")
    found = found.withColumn("refusal", _error(p))
    u, angle, thick = p.interface_uncertainty, p.angular_uncertainty, p.least_thickness
    bounds = lambda lower, upper: {"lower": lower, "upper": upper} if p.restricted else {}
    #: Condition and rows of it.
    own: list[tuple[str, list[str]]] = [("nth = 1", [_row(MODEL, error="refusal")]), ("category = 'interface' and members = largest.members and at = largest.at", [_row(BASIS, first="me", k2="place")])]
    if p.model in (SINGLE_SURFACE, CONTINUOUS):
        own.append(("category = 'interface'", [_row(INTERFACE, first="me", k2="place", value="level", **bounds(-u, u))]))
    if p.model in (LAJAUNIE, STRATIGRAPHIC):
        own.append(("category = 'interface' and not is_reference", [_row(INCREMENT, first="reference", second="me", k1="-at", k2="place", value=0.0, **bounds(-u, u))]))
    if p.model == STRATIGRAPHIC:
        own.append(("is_reference and below is not null", [_row(SEQUENCED, first="me", second="below", k1="-at", sign=1.0, lower=thick, **({"upper": "wide"} if p.restricted else {}))]))
        ends = {"sign": 1.0, "lower": 0.0} | ({"upper": thick} if p.restricted else {})
        own.append(("category = 'inequality' and nearest_above is not null", [_row(LITHOLOGY, first="nearest_above", second="me", k2="2 * place", **ends)]))
        own.append(("category = 'inequality' and nearest_below is not null", [_row(LITHOLOGY, first="me", second="nearest_below", k2="2 * place + 1", **ends)]))
    if p.model == SINGLE_SURFACE:
        # a level of at most 0 asks for a field below the surface, whatever its size
        ends = bounds("if(level <= 0, -wide, 0)", "if(level <= 0, 0, wide)") or {"lower": 0.0}
        own.append(("category = 'inequality'", [_row(INEQUALITY, first="me", k2="place", sign="if(level <= 0, -1, 1)", **ends)]))
    if p.restricted and p.model not in (CONTINUOUS, VECTOR):
        found = found.withColumn("around", O.normal_bounds(O.strike_of_normal(F.col("vx"), F.col("vy")), O.dip_of_normal(F.col("vz")), F.lit(angle), F.lit(angle / 2))).withColumn("inner", O.angle_bounds(F.lit(angle)))
    if p.model != CONTINUOUS:
        axes = [_row(PLANAR, first="me", axis=k, k2=f"3 * place + {k}", value=f"v{a}", **{f"d{b}": float(a == b) for b in "xyz"}, **(bounds(f"around.{a}_lo", f"around.{a}_hi") if p.model != VECTOR else {})) for k, a in enumerate("xyz")]
        own.append(("category = 'planar'", axes))
    if p.model not in (CONTINUOUS, VECTOR):
        own.append(("category = 'tangent'", [_row(TANGENT, first="me", k2="place", dx="vx", dy="vy", dz="vz", value=0.0, **bounds("inner.lo", "inner.hi"))]))
    each = ", ".join(f"case when {condition} then array({', '.join(some)}) end" for condition, some in own)
    whole = found.selectExpr("model_id", f"explode(flatten(array_compact(array({each})))) as r").select("model_id", "r.*")
    # the MODEL row comes first and counts as -1
    order = Window.partitionBy("model_id").orderBy("section", "k1", "k2")
    return whole.withColumn("dof", F.row_number().over(order) - 2)


def dofs(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """model_id, dof, section, role, the constraints it is made of, axis, sign, lower, upper, value of every unknown of the models
    that are not refused."""
    found = rows(constraints, parameters.checked())
    refused = F.first("error").over(Window.partitionBy("model_id").orderBy("section", "k1", "k2"))
    role = F.lit("bounded") if parameters.restricted and parameters.model not in (CONTINUOUS, VECTOR) else F.when(F.col("section").isin(SEQUENCED, INEQUALITY, LITHOLOGY), "inequality").otherwise("equality")
    found = found.withColumn("refused", refused).filter(F.col("refused").isNull() & F.col("section").between(SEQUENCED, TANGENT))
    return found.select(
        "model_id", "dof", F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section") + 1).alias("section"), role.alias("role"), F.col("first.category").alias("first_category"), F.col("first.constraint_id").alias("first_id"),
        F.col("second.category").alias("second_category"), F.col("second.constraint_id").alias("second_id"), "axis", "sign", "lower", "upper", F.when(role == "equality", F.col("value")).alias("value"),
    )


def errors(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """model_id, error of the models that the layout refuses."""
    return rows(constraints, parameters.checked()).filter(F.col("section") == MODEL).filter("error is not null").select("model_id", "error")


def sizes(constraints: DataFrame, parameters: Parameters) -> DataFrame:
    """model_id, section, its first dof and the dof after its last: the partitions of the layout."""
    return dofs(constraints, parameters).groupBy("model_id", "section").agg(F.min("dof").alias("start"), (F.max("dof") + 1).alias("stop"))
