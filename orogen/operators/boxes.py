"""Point sets cut into small boxes, and pairs of boxes narrowed down by bounds of their points' distances.

A point set of a model becomes its distinct places, sorted along a Z-order curve over ranges of (model_id, curve), and cells of the curve that are
divided until they hold at most LEAF places. Cells are nodes with the least box around their points. Whatever asks for nearest, farthest or
otherwise outstanding pairs of points starts with the two whole sets, replaces nodes by the nodes within, and leaves out pairs of nodes whose
bounds show that they hold no answer; only the points of the cells that are left are compared. So the rows are in proportion to the points
where answers are local, however the points are spread, and no model meets in one task.

Coordinates are finite (orogen.sources.tables.refused names the others). Points at one place are one place with its count and its first
indices, so repeated points cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEAF, CURVE_BITS = 16, 15
AXES = ("x", "y", "z", "c")
#: Bounds of boxes are rounded like distances are: what is within so much of a bound is not left out.
SLACK = 1e-9


def places(points: DataFrame, first: int = 1) -> DataFrame:
    """model_id, x, y, z, c, ids (the first indices there, at most `first`) and n (of points) of each place. -0.0 is 0.0."""
    own = points.select("model_id", "idx", *((F.col(k) + 0.0).alias(k) for k in AXES))
    place = ["model_id", *AXES]
    if first == 1:
        return own.groupBy(*place).agg(F.array(F.min("idx")).alias("ids"), F.count("*").alias("n"))
    ahead = own.withColumn("nth", F.row_number().over(Window.partitionBy(*place).orderBy("idx"))).filter(F.col("nth") <= first)
    return ahead.groupBy(*place).agg(F.array_sort(F.collect_list("idx")).alias("ids"), F.count("*").alias("n"))


def _half(shift: int) -> Column:
    """Fifteen bits of each coordinate's share of the model's range, from bit `shift` on, in turn: a part of the place on the Z-order curve."""
    total = F.lit(0).cast("long")
    for axis, k in enumerate(AXES):
        for bit in range(15):
            total = total.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"cell_{k}"), shift + bit).bitwiseAND(F.lit(1).cast("long")), 4 * bit + 3 - axis))
    return total


def _shared_digits(high: Column, low: Column) -> Column:
    """How many of the thirty leading digits of a code are those of another one, at most 29; -1 if there is no other."""
    shared = lambda one, other: F.floor((60 - F.length(F.bin(one.bitwiseXOR(other)))) / 4)
    digits = F.when(F.col("high") != high, shared(F.col("high"), high)).when(F.col("low") != low, 15 + shared(F.col("low"), low)).otherwise(29)
    return F.when(high.isNull(), -1).otherwise(digits).cast("int")


class Boxes:
    """The places of a point set and the nodes around them. A node is a cell of a 16-fold subdivision of the model's range, named by the
    leading digits of its places' codes; cells with at most LEAF places are not divided. Level 0 is the whole set of a model."""

    def __init__(self, points: DataFrame, first: int = 1):
        own = places(points, first)
        ranges = own.groupBy("model_id").agg(*(f(k).alias(f"{name}_{k}") for k in AXES for name, f in (("lo", F.min), ("hi", F.max))))
        most = (1 << 2 * CURVE_BITS) - 1
        share = lambda k: F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), (F.col(k) - F.col(f"lo_{k}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}"))).otherwise(0.0)
        cells = own.join(ranges, "model_id").select(*own.columns, *(F.least(F.floor(share(k) * (most + 1)).cast("long"), F.lit(most)).alias(f"cell_{k}") for k in AXES))
        coded = cells.select(*own.columns, _half(15).alias("high"), _half(0).alias("low")).repartitionByRange("model_id", "high", "low").withColumn("part", F.spark_partition_id())
        # a cell holds more than LEAF places if a place and the one LEAF places on are in it
        order = Window.partitionBy("part", "model_id").orderBy("high", "low", *AXES)
        ahead = lambda n: _shared_digits(*(F.lead(half, n).over(order) for half in ("high", "low")))
        full = coded.withColumn("full", ahead(LEAF)).withColumn("apart", ahead(1) + 1).withColumn("depth", F.max("full").over(order.rowsBetween(-LEAF, 0)) + 1)
        code = F.concat(*(F.lpad(F.lower(F.hex(half)), 15, "0") for half in ("high", "low")))
        # the ranges of the sort are a matter of one run of the plan, so the cells are written
        self.places = written(full.select(*own.columns, "depth", "apart", code.alias("code")), "boxes")
        # the depths at which some cell is divided; neighbours on the curve tell
        self.levels = [0, *sorted(r["apart"] for r in self.places.filter("apart <= depth AND apart > 0").select("apart").distinct().collect())]

    def _key(self, depth: int) -> Column:
        return F.substring("code", F.lit(1), F.least("depth", F.lit(depth)))

    def nodes(self, step: int) -> DataFrame:
        """model_id, node (key and box, with its points' number) and the key of the node around it: up."""
        around = self._key(self.levels[step - 1] if step else 0)
        found = self.places.groupBy("model_id", self._key(self.levels[step]).alias("key"), around.alias("up")).agg(F.sum("n").alias("n"), *(f(k).alias(f"{name}_{k}") for k in AXES for name, f in (("lo", F.min), ("hi", F.max))))
        return found.select("model_id", "up", F.struct("key", "n", F.lit(None).cast("array<bigint>").alias("ids"), *_box_names()).alias("node"))

    def leaves(self) -> DataFrame:
        """The places as nodes of their own, within the undivided cells; the key of a place is its first index."""
        box = [F.col(k).alias(f"{name}_{k}") for k in AXES for name in ("lo", "hi")]
        return self.places.select("model_id", self._key(self.levels[-1]).alias("up"), F.struct(F.col("ids")[0].cast("string").alias("key"), "n", "ids", *box).alias("node"))


def _box_names() -> list[str]:
    return [f"{name}_{k}" for k in AXES for name in ("lo", "hi")]


def least(a: str = "a", b: str = "b") -> Column:
    """A lower bound of the distances between points of two nodes; exact for places."""
    gaps = [F.greatest(F.col(f"{a}.lo_{k}") - F.col(f"{b}.hi_{k}"), F.col(f"{b}.lo_{k}") - F.col(f"{a}.hi_{k}"), F.lit(0.0)) for k in AXES]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def most(a: str = "a", b: str = "b") -> Column:
    """An upper bound of them."""
    gaps = [F.greatest(F.col(f"{a}.hi_{k}") - F.col(f"{b}.lo_{k}"), F.col(f"{b}.hi_{k}") - F.col(f"{a}.lo_{k}")) for k in AXES]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


Keep = Callable[[DataFrame], DataFrame]


def narrowed(left: Boxes, right: Boxes, keep: Keep) -> DataFrame:
    """model_id, a, b: pairs of places (as nodes) that `keep` never left out. keep gets pairs with lo and hi, the bounds of their distances,
    and returns those that may hold an answer; a is the asking side, for which it may compare all b."""
    whole = lambda boxes, name: boxes.nodes(0).select("model_id", F.col("node").alias(name))
    pairs = whole(left, "a").join(whole(right, "b"), "model_id")

    def within(pairs: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
        return pairs.withColumn("up", F.col(f"{side}.key")).drop(side).join(nodes.withColumnRenamed("node", side), ["model_id", "up"]).drop("up")

    def kept(pairs: DataFrame) -> DataFrame:
        return keep(pairs.withColumn("lo", least()).withColumn("hi", most())).select("model_id", "a", "b")

    for step in range(1, max(len(left.levels), len(right.levels))):
        for boxes, side in ((left, "a"), (right, "b")):
            if step < len(boxes.levels):
                pairs = within(pairs, boxes.nodes(step), side)
        pairs = kept(pairs)
    # one more bound for each asking place, before the places of the other side
    pairs = kept(within(pairs, left.leaves(), "a"))
    return within(pairs, right.leaves(), "b")


_ASKING = ("model_id", "a.key")


def among_nearest(k: int) -> Keep:
    """Pairs that may hold one of the k nearest points at a distance above 0."""

    def keep(pairs: DataFrame) -> DataFrame:
        asking = Window.partitionBy(*_ASKING)
        # points of nodes that are apart from the asking one are at a distance above 0 for sure
        known = F.when(F.col("lo") > 0, F.col("hi"))
        if k > 1:
            enough = F.sum(F.when(F.col("lo") > 0, F.col("b.n")).otherwise(0)).over(asking.orderBy("hi").rangeBetween(Window.unboundedPreceding, Window.currentRow)) >= k
            pairs = pairs.withColumn("enough", enough)
            known = F.when(F.col("enough") & (F.col("lo") > 0), F.col("hi"))
        bounded = pairs.withColumn("bound", F.min(known).over(asking))
        return bounded.filter((F.col("hi") > 0) & (F.col("bound").isNull() | (F.col("lo") <= F.col("bound") * (1 + SLACK))))

    return keep


def among_farthest(pairs: DataFrame) -> DataFrame:
    """Pairs that may hold the farthest point of the asking side."""
    bounded = pairs.withColumn("bound", F.max("lo").over(Window.partitionBy(*_ASKING)))
    return bounded.filter(F.col("hi") >= F.col("bound") * (1 - SLACK))


def among_farthest_of_model(pairs: DataFrame) -> DataFrame:
    """Pairs that may hold the largest distance of the model."""
    bounded = pairs.withColumn("bound", F.max("lo").over(Window.partitionBy("model_id")))
    return bounded.filter(F.col("hi") >= F.col("bound") * (1 - SLACK))


def among_closest_to(target: float) -> Keep:
    """Pairs that may hold the point whose distance is closest to target."""

    def keep(pairs: DataFrame) -> DataFrame:
        off = F.greatest(F.abs(F.col("lo") - target), F.abs(F.col("hi") - target))
        bounded = pairs.withColumn("bound", F.min(off).over(Window.partitionBy(*_ASKING)))
        gap = F.greatest(F.col("lo") - target, target - F.col("hi"), F.lit(0.0))
        return bounded.filter(gap <= F.col("bound") * (1 + SLACK) + SLACK * abs(target))

    return keep
