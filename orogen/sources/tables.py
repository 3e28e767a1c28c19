"""Constraint and query tables: read from Parquet with their schema checked, or derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FieldError
from ..functions.orientation import finite, normal_of

#: Columns of the matrix form of each category.
MATRIX_COLUMNS = {"interface": ("x", "y", "z", "level"), "inequality": ("x", "y", "z", "level"), "planar": ("x", "y", "z", "vx", "vy", "vz"), "tangent": ("x", "y", "z", "vx", "vy", "vz")}


def constraints_of(df: DataFrame, category: str) -> DataFrame:
    """A tagged constraint table from a table with the matrix columns of its category, model_id and constraint_id."""
    missing = [c for c in ("model_id", "constraint_id", *MATRIX_COLUMNS[category]) if c not in df.columns]
    if missing:
        raise FieldError("InvalidInputData", f"{category}: no column {', '.join(missing)}")
    number = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.select(
        F.col("model_id").cast("long"), F.lit(category).alias("category"), F.col("constraint_id").cast("long"), *(number(c).alias(c) for c in "xyz"),
        (F.coalesce(number("c"), F.lit(0.0)) if "c" in df.columns else F.lit(0.0)).alias("c"), number("level").alias("level"), *(number(c).alias(c) for c in ("vx", "vy", "vz")),
    )


def read_constraints(spark: SparkSession, path: str, category: str) -> DataFrame:
    """The category's table at path; only its columns are read."""
    return constraints_of(spark.read.parquet(path), category)


def with_error(constraints: DataFrame) -> DataFrame:
    """The rows with error: NonFiniteInput for a null, NaN or infinite number where the category needs one, InvalidInputData for a
    tangent without length or an unknown category, else null."""
    vector = F.col("category").isin("planar", "tangent")
    ok = finite(F.col("x"), F.col("y"), F.col("z"), F.col("c")) & F.when(vector, finite(F.col("vx"), F.col("vy"), F.col("vz"))).otherwise(finite(F.col("level")))
    unknown = ~F.coalesce(F.col("category").isin(*MATRIX_COLUMNS), F.lit(False))
    still = (F.col("category") == "tangent") & (F.col("vx") == 0) & (F.col("vy") == 0) & (F.col("vz") == 0)
    return constraints.withColumn("error", F.when(unknown, "InvalidInputData").when(~ok, "NonFiniteInput").when(still, "InvalidInputData"))


def refused(constraints: DataFrame) -> DataFrame:
    """The rows that with_error gives an error."""
    return with_error(constraints).filter("error is not null").select(*constraints.columns)


def write_constraints(constraints: DataFrame, path: str, category: str) -> None:
    """The matrix form of one category."""
    constraints.filter(F.col("category") == category).select("model_id", "constraint_id", *MATRIX_COLUMNS[category]).write.mode("overwrite").parquet(path)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, idx, x, y, z, c, from the first numbers of the embeddings; a model for each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("long").alias("model_id"), F.col("vec_id").alias("idx"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), F.lit(0.0).alias("c"))


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces at the points; the level is one of five, by vec_id."""
    return points(spark, sf_dir).select("model_id", F.lit("interface").alias("category"), F.col("idx").alias("constraint_id"), "x", "y", "z", "c", (F.col("idx") % 5 * 10.0).alias("level"), *(F.lit(None).cast("double").alias(v) for v in ("vx", "vy", "vz")))


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, constraint_id, x, y, z, strike, dip, polarity, from the suppliers' keys."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        (k % 10).alias("model_id"), k.alias("constraint_id"), (k % 17 / 4.0).alias("x"), (k % 23 / 5.0).alias("y"), (k % 29 / 6.0).alias("z"), (k * 37 % 360).cast("double").alias("strike"), (k * 13 % 90).cast("double").alias("dip"), (k % 2).cast("int").alias("polarity")
    )


def planars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar constraints with the normals of the orientations."""
    n = normal_of(F.col("strike"), F.col("dip"), F.col("polarity"))
    return orientations(spark, sf_dir).withColumn("n", n).select("model_id", F.lit("planar").alias("category"), "constraint_id", "x", "y", "z", F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("level"), F.col("n.x").alias("vx"), F.col("n.y").alias("vy"), F.col("n.z").alias("vz"))
