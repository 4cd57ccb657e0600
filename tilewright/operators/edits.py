"""Edits of annotations (ann_id, type, name, grp, selected, ring), as new columns of the whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import rings

#: Slots of a feature vector.
SLOTS = 64


def rectangle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The corners of a rectangle from one corner to the opposite one."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((ax, ay), (bx, ay), (bx, by), (ax, by))])


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column, points: int = 48) -> Column:
    """Points of an ellipse, from its right end on."""
    angle = lambda i: 2 * F.pi() * i / points
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((cx + rx * F.cos(angle(i))).alias("x"), (cy + ry * F.sin(angle(i))).alias("y")))


def moved(ring: Column, type_: Column, at: Column, point: Column) -> Column:
    """The ring with the point at a place moved; of a rectangle the two corners beside it follow, and the opposite one stays."""
    fixed = F.try_element_at(ring, ((at + 2) % 4 + 1).cast("int"))
    corner = lambda i: (
        F.when(i == at, point).when(i == (at + 1) % 4, F.struct(fixed["x"].alias("x"), point["y"].alias("y"))).when(i == (at + 3) % 4, F.struct(point["x"].alias("x"), fixed["y"].alias("y"))).otherwise(fixed)
    )
    return F.when((type_ == "rectangle") & (F.size(ring) == 4), F.transform(ring, lambda p, i: corner(i))).otherwise(rings.replaced(ring, at, point))


def as_polygon(ring: Column, type_: Column, closing: float = 0.01) -> tuple[Column, Column]:
    """Type and ring of a line of three points or more as a polygon, without a last point of over three that is nearer than closing to the first (0: all points stay); others stay."""
    first, last, n = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1)), F.size(ring)
    can = (type_ == "line") & (n >= 3)
    closed = can & (n > 3) & (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) < closing)
    return F.when(can, "polygon").otherwise(type_), F.when(closed, F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def as_line(ring: Column, type_: Column, at: Column) -> tuple[Column, Column]:
    """Type and ring of an outline cut open at a point, which begins and ends it; lines, points and outlines of under three points stay."""
    can = ~type_.isin("line", "point") & (F.size(ring) >= 3)
    return F.when(can, "line").otherwise(type_), F.when(can, rings.rotated(ring, at)).otherwise(ring)


def continued(ring: Column, type_: Column, at: Column) -> Column:
    """The ring so that a line goes on from one of its ends: turned round if that is the first; null if the point isn't an end of a line."""
    n = F.size(ring)
    return F.when((type_ == "line") & (n >= 2), F.when(at == 0, F.reverse(ring)).when(at == n - 1, ring))


def feature_vector(values: Column) -> Column:
    """A map of slot and value as an array of all slots, 0 where there is none."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))


def grown(indexes: DataFrame, by: str, index: str, value: str) -> DataFrame:
    """by, values: an array as long as the highest index of each group asks for, with nulls where nothing was set; of values for one index the last set (by seq) counts. Groups are small."""
    last = indexes.groupBy(by, index).agg(F.max_by(value, "seq").alias("v"))
    held = last.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(index, "v"))).alias("m"), F.max(index).alias("most"))
    return held.select(by, F.transform(F.sequence(F.lit(0).cast("long"), F.col("most").cast("long")), lambda i: F.try_element_at("m", i)).alias("values"))


def duplicated(annotations: DataFrame, derived: list[str]) -> DataFrame:
    """The same annotations without what was derived from them, and not selected."""
    return annotations.drop(*derived).withColumn("selected", F.lit(False))
