"""Outlines as ordered vertex rows (ann_id, ord, n, x, y) or as arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edges(vertices: DataFrame, closed: bool = True) -> DataFrame:
    """Each vertex with the next one (nx, ny); the last is followed by the first if the outline is closed, else it has no edge."""
    ordered = W.partitionBy("ann_id").orderBy("ord")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = vertices.withColumns({f"n{c}": F.lead(c).over(ordered) for c in "xy"})
    if not closed:
        return out.filter("nx is not null")
    return out.withColumns({f"n{c}": F.coalesce(f"n{c}", F.first(c).over(whole)) for c in "xy"})


def bounds(vertices: DataFrame, *by: str) -> DataFrame:
    """x0, y0, x1, y1 and n of the vertices of each group."""
    return vertices.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def signed_area(vertices: DataFrame) -> DataFrame:
    """ann_id, n, area: half the sum of the cross products of a closed outline's edges."""
    return edges(vertices).groupBy("ann_id").agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("ny") - F.col("y") * F.col("nx")) / 2).alias("area"))


def rings(vertices: DataFrame) -> DataFrame:
    """ann_id, ring: the points of each outline in order, as array<struct<x, y>>."""
    own = vertices.groupBy("ann_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("r"))
    return own.select("ann_id", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def rotated(ring: Column, start: Column) -> Column:
    """The ring from the point at start (from 0) on, closed by repeating that point."""
    n = F.size(ring)
    return F.concat(F.slice(ring, start + 1, n - start), F.slice(ring, F.lit(1), start + 1))


def without_closing(ring: Column) -> Column:
    """The ring without a last point that equals its first."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def split(ring: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Both rings that a cut between the points at a and b (a < b, from 0) makes; each keeps both points."""
    n = F.size(ring)
    return F.slice(ring, a + 1, b - a + 1), F.concat(F.slice(ring, b + 1, n - b), F.slice(ring, F.lit(1), a + 1))


def replaced(ring: Column, at: Column, point: Column) -> Column:
    """The ring with one point moved."""
    return F.transform(ring, lambda p, i: F.when(i == at, point).otherwise(p))


def without(ring: Column, at: Column) -> Column:
    n = F.size(ring)
    return F.concat(F.slice(ring, F.lit(1), at), F.slice(ring, at + 2, n - at - 1))


def inserted(ring: Column, at: Column, point: Column) -> Column:
    n = F.size(ring)
    return F.concat(F.slice(ring, F.lit(1), at), F.array(point), F.slice(ring, at + 1, n - at))


def ring_area(ring: Column) -> Column:
    """The signed area of an array of points."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i)["y"] * F.element_at(ring, i % n + 1)["x"]) / 2
