"""Cleaning, ordering and grouping of constraints by level. Rows carry constraint_id, their order of insertion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two points nearer than this on each axis are one.
POSITION_EPSILON = 1e-3


def collocated(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) < POSITION_EPSILON) & (F.abs(a["y"] - b["y"]) < POSITION_EPSILON) & (F.abs(a["z"] - b["z"]) < POSITION_EPSILON)


def remove_collocated(rows: DataFrame, keys: tuple[str, ...] = ("model_id", "category")) -> DataFrame:
    """Per group in order of x, y, z (then constraint_id) a row is dropped if it is collocated with the last one kept.

    A row whose x is not near that of the row before it is kept whatever was kept before; the window that tells so also deals and sorts the
    rows. The fold then passes over them as they come, with the last kept row carried along: no run is gathered, and a group's rows cost
    their sort and one look each, however many lie at one x.
    """
    # + 0.0 makes -0.0 and 0.0 one place in the order
    order = Window.partitionBy(*keys).orderBy(*(F.col(k) + 0.0 for k in "xyz"), "constraint_id")
    near = F.coalesce(F.abs(F.col("x") - F.lag("x").over(order)) < POSITION_EPSILON, F.lit(False))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (math.inf,) * 3
        for batch in batches:
            within, places = batch.column("__near").to_numpy(zero_copy_only=False), [batch.column(k).to_numpy(zero_copy_only=False) for k in "xyz"]
            kept = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(within).tolist():
                if i and not within[i - 1]:
                    last = tuple(p[i - 1] for p in places)
                here = tuple(p[i] for p in places)
                if all(abs(u - v) < POSITION_EPSILON for u, v in zip(here, last, strict=True)):
                    kept[i] = False
                else:
                    last = here
            if batch.num_rows and not within[-1]:
                last = tuple(p[-1] for p in places)
            yield batch.drop_columns(["__near"]).filter(pa.array(kept))

    return rows.withColumn("__near", near).mapInArrow(fold, rows.schema)


def removed(constraints: DataFrame) -> DataFrame:
    """model_id, category and how many of its rows remove_collocated drops."""
    count = lambda df, name: df.groupBy("model_id", "category").agg(F.count("*").alias(name))
    both = count(constraints, "before").join(count(remove_collocated(constraints), "after"), ["model_id", "category"])
    return both.select("model_id", "category", (F.col("before") - F.col("after")).alias("removed"))


def with_references(rows: DataFrame, carry: Column, order: str = "constraint_id") -> DataFrame:
    """rows(model_id, category, level, ...) with: at (the level; -0.0 is 0.0), reference (carry of the first interface of the level),
    is_reference, members (of the level); below (a reference's carry on the next lower level); nearest_above and nearest_below (the
    references strictly above and below a row). All windows are within model_id."""
    rows = rows.withColumn("at", F.col("level") + 0.0)
    level = Window.partitionBy("model_id", "category", "at")
    first = (F.col("category") == "interface") & (F.col("__nth") == 1)
    rows = rows.select("*", F.first(carry).over(level.orderBy(order)).alias("reference"), F.row_number().over(level.orderBy(order)).alias("__nth"), F.count("*").over(level).alias("members"))
    rows = rows.withColumn("is_reference", first).drop("__nth")
    mine = F.when(F.col("is_reference"), carry)
    references = Window.partitionBy("model_id", "is_reference").orderBy(F.desc("at"))
    # of equal levels the others come before the reference, so they do not see it
    before = lambda direction: Window.partitionBy("model_id").orderBy(direction, "is_reference").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*", F.when(F.col("is_reference"), F.lead(carry).over(references)).alias("below"), F.last(mine, ignorenulls=True).over(before(F.desc("at"))).alias("nearest_above"),
        F.last(mine, ignorenulls=True).over(before(F.asc("at"))).alias("nearest_below"),
    )


def levels(interfaces: DataFrame) -> DataFrame:
    """model_id, level, reference (the first constraint_id), members, n. Levels are equal exactly; -0.0 is 0.0."""
    return interfaces.groupBy("model_id", (F.col("level") + 0.0).alias("level")).agg(F.min("constraint_id").alias("reference"), F.sort_array(F.collect_list("constraint_id")).alias("members"), F.count("*").alias("n"))


def pair_counts(interfaces: DataFrame) -> DataFrame:
    """Increment pairs (within levels) and sequenced pairs (between levels) of each model."""
    return levels(interfaces).groupBy("model_id").agg(F.sum(F.col("n") - 1).alias("increments"), F.greatest(F.count("*") - 1, F.lit(0)).alias("sequenced"))


def _known(interfaces: DataFrame) -> DataFrame:
    return with_references(interfaces.select("model_id", F.lit("interface").alias("category"), "constraint_id", "level"), F.struct("constraint_id", "level"))


def increments(interfaces: DataFrame) -> DataFrame:
    """The pairs of each level's reference with each other member."""
    return _known(interfaces).filter("not is_reference").select("model_id", F.col("at").alias("level"), F.col("reference.constraint_id").alias("reference"), F.col("constraint_id").alias("member"))


def sequenced(interfaces: DataFrame) -> DataFrame:
    """The references of neighbouring levels, the higher one above."""
    found = _known(interfaces).filter("below is not null")
    return found.select("model_id", F.col("constraint_id").alias("above"), F.col("below.constraint_id").alias("below"), F.col("at").alias("level"), (F.col("below.level") + 0.0).alias("level_below"))


def lithology(inequalities: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Per inequality the reference of the nearest level strictly above and of the nearest strictly below, if there are such."""
    tagged = [df.select("model_id", F.lit(name).alias("category"), "constraint_id", F.col("level").cast("double").alias("level")) for df, name in ((interfaces, "interface"), (inequalities, "inequality"))]
    found = with_references(tagged[0].unionByName(tagged[1]), F.struct("constraint_id")).filter("category = 'inequality'")
    return found.select("model_id", "constraint_id", F.col("nearest_above.constraint_id").alias("above"), F.col("nearest_below.constraint_id").alias("below"))


def levels_in_both(inequalities: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Inequalities whose level is an interface's: they make the input invalid."""
    return inequalities.join(interfaces.select("model_id", "level").distinct(), ["model_id", "level"], "left_semi")


def inequality_levels(inequalities: DataFrame) -> DataFrame:
    return inequalities.select("model_id", (F.col("level") + 0.0).alias("level")).distinct()
