"""Orientation of planar constraints as column expressions: normals, dips, strikes, bounds.

Angles are degrees. Upright is polarity 0, overturned 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPRIGHT, OVERTURNED = 0, 1


def finite(*values: Column) -> Column:
    """Whether no value is null, NaN or infinite."""
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def polarity_of_normal(nz: Column) -> Column:
    return F.when(nz < 0, OVERTURNED).otherwise(UPRIGHT)


def polarity_error(polarity: Column) -> Column:
    """The category of a polarity code that is neither upright nor overturned, or null."""
    return F.when(~F.coalesce(polarity.isin(UPRIGHT, OVERTURNED), F.lit(False)), "InvalidInputData")


def dip_of_normal(nz: Column) -> Column:
    return F.degrees(F.acos(nz))


def strike_of_normal(nx: Column, ny: Column) -> Column:
    direction = F.degrees(F.atan2(ny, nx))
    return F.lit(360.0) - F.when(direction < 0, direction + 360.0).otherwise(direction)


def normal_error(nx: Column, ny: Column, nz: Column) -> Column:
    """The category of a normal that is refused, or null."""
    return (
        F.when(~finite(nx, ny, nz), "NonFiniteInput")
        .when((nx == 0) & (ny == 0) & (nz == 0), "ZeroNormal")
        .when((nz < -1) | (nz > 1), "NormalZOutOfRange")
    )


def strike_of_azimuth(azimuth: Column) -> Column:
    return F.when(azimuth >= 90, azimuth - 90.0).otherwise(azimuth + 270.0)


def normal_of(strike: Column, dip: Column, polarity: Column) -> Column:
    """The unit normal (x, y, z) as a struct; null components where the orientation has no length."""
    s, d = F.radians(-strike), F.radians(-dip)
    vx, vy, vz = F.cos(s) * F.cos(d), F.sin(s) * F.cos(d), F.sin(d)
    px, py = -vy, vx
    nx, ny, nz = -vz * py, vz * px, vx * py - vy * px
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    turn = F.when((polarity == OVERTURNED) & (nz > 0) | (polarity == UPRIGHT) & (nz < 0), -1.0).otherwise(1.0)
    unit = lambda v: F.when(size > 0, turn * v / size)
    return F.struct(unit(nx).alias("x"), unit(ny).alias("y"), unit(nz).alias("z"))


def dip_vector(strike: Column, dip: Column) -> Column:
    """The unit vector down the dip."""
    s, d = F.radians(-strike), F.radians(-dip)
    return F.struct((F.cos(s) * F.cos(d)).alias("x"), (F.sin(s) * F.cos(d)).alias("y"), F.sin(d).alias("z"))


def strike_vector(strike: Column) -> Column:
    s = F.radians(-strike)
    return F.struct((-F.sin(s)).alias("x"), F.cos(s).alias("y"), F.lit(0.0).alias("z"))


def normal_bounds(strike: Column, dip: Column, d_strike: Column, d_dip: Column) -> Column:
    """Per axis the least and greatest component of the four normals with strike and dip moved both ways."""
    a, b, u, w = F.radians(d_strike + strike), F.radians(d_strike - strike), F.radians(d_dip + dip), F.radians(d_dip - dip)
    corners = [
        (F.cos(a) * F.sin(u), -F.sin(a) * F.sin(u), F.cos(u)),
        (-F.cos(b) * F.sin(w), -F.sin(b) * F.sin(w), F.cos(w)),
        (-F.cos(a) * F.sin(w), F.sin(a) * F.sin(w), F.cos(w)),
        (F.cos(b) * F.sin(u), F.sin(b) * F.sin(u), F.cos(u)),
    ]
    return F.struct(*(f(*(c[k] for c in corners)).alias(f"{axis}_{side}") for k, axis in enumerate("xyz") for side, f in (("lo", F.least), ("hi", F.greatest))))


def level_bounds(uncertainty: Column) -> Column:
    return F.struct((-uncertainty).alias("lo"), uncertainty.alias("hi"))


def angle_bounds(angle: Column) -> Column:
    """Bounds of a tangent's inner product for an angular uncertainty."""
    v = 2.0 * F.cos(F.radians(90.0 - angle))
    return F.struct(F.least(v, F.lit(0.0)).alias("lo"), F.greatest(v, F.lit(0.0)).alias("hi"))
