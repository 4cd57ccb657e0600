"""Geometry over columns: bounds (x0, y0, x1, y1), points, segments, tile ranges, cameras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column, touching: bool = True) -> Column:
    """Whether two bounds overlap; touching edges count unless touching is False."""
    if touching:
        return (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    return (ax0 < bx1) & (ax1 > bx0) & (ay0 < by1) & (ay1 > by0)


def inside(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, tolerance: float = 0.0) -> Column:
    """Whether a point is in half-open bounds, widened by a tolerance."""
    return (x >= x0 - tolerance) & (x < x1 + tolerance) & (y >= y0 - tolerance) & (y < y1 + tolerance)


def in_triangle(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Whether a point is left of or on all three edges, in order."""
    side = lambda ux, uy, vx, vy: (vx - ux) * (py - uy) - (vy - uy) * (px - ux) >= 0
    return side(ax, ay, bx, by) & side(bx, by, cx, cy) & side(cx, cy, ax, ay)


def clip(low: Column, high: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """An interval clamped so that it stays in another."""
    return F.least(F.greatest(low, least), most), F.greatest(F.least(high, most), least)


def segment_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment (0 to 1) the point nearest to p is; 0 on a segment of no length."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))


def canonical_interval(start: Column, extent: Column) -> tuple[Column, Column]:
    """The start and extent of an interval whose extent may be negative."""
    return F.when(extent < 0, start + extent).otherwise(start), F.abs(extent)


def pixel_range(low: Column, high: Column, unit: Column) -> tuple[Column, Column]:
    """World bounds in pixels: the floor of the lower, the ceiling of the upper."""
    return F.floor(low / unit), F.ceil(high / unit)


def tile_range(low: Column, high: Column, side: Column) -> tuple[Column, Column]:
    """Tiles that bounds touch, with an exclusive end."""
    return F.floor(low / side), F.floor(high / side) + 1


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def lowbias32(value: Column) -> Column:
    """A 32-bit integer hash by two rounds of xor-shift and multiplication. The multipliers are fixed values."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))

    def times(c: Column, k: int) -> Column:  # in halves, so that no product leaves 63 bits
        high, small = F.shiftrightunsigned(c, 16), c.bitwiseAND(F.lit(0xFFFF))
        return low(F.shiftleft((high * k).bitwiseAND(F.lit(0xFFFF)), 16) + small * k)

    c = low(value)
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 16))
    c = times(c, 0x7FEB352D)
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 15))
    c = times(c, 0x846CA68B)
    return c.bitwiseXOR(F.shiftrightunsigned(c, 16))


def scale_bar(most: Column) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that isn't above a positive width."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    return F.when(most / power >= 5, 5 * power).when(most / power >= 2, 2 * power).otherwise(power)


def to_world(place: Column, unit: float, origin: float = 0.0) -> Column:
    """A bound in pixels or tiles in world units."""
    return place * unit + origin


def pixel_at(position: Column, unit: float, level: Column) -> Column:
    """The pixel of a level nearest to a world position, halves away from zero."""
    return F.round(position / (unit * F.pow(F.lit(2), level))).cast("long")


def to_screen(x: Column, y: Column, camera_x: float, camera_y: float, angle: float, unit: Column, width: int, height: int) -> tuple[Column, Column]:
    """A world position on a screen whose centre is the camera's, turned by an angle, with points of a width in world units."""
    sx, sy = rotated(x - camera_x, y - camera_y, F.lit(angle))
    return sx / unit + width / 2, sy / unit + height / 2


def from_screen(sx: Column, sy: Column, camera_x: float, camera_y: float, angle: float, unit: Column, width: int, height: int) -> tuple[Column, Column]:
    """The world position of a place on the screen."""
    x, y = rotated((sx - width / 2) * unit, (sy - height / 2) * unit, F.lit(-angle))
    return x + camera_x, y + camera_y


def closest_corner(x: Column, y: Column, centre_x: Column, centre_y: Column) -> Column:
    """The corner of the quarter around a centre that a point lies in; points on the lines count as left and as top."""
    return F.concat(F.when(y <= centre_y, "top").otherwise("bottom"), F.when(x <= centre_x, " left").otherwise(" right"))


def corner_x(corner: Column, x: float, width: float) -> Column:
    return F.when(corner.endswith("left"), F.lit(x)).otherwise(F.lit(x + width))


def corner_y(corner: Column, y: float, height: float) -> Column:
    return F.when(corner.startswith("top"), F.lit(y)).otherwise(F.lit(y + height))


def rational(value: Column, most: int = (2**31 - 1) // 4, terms: int = 24) -> Column:
    """numerator and denominator of a positive number: its continued fraction up to the term behind which the denominator would be over the most, or the rest too small to go on with."""
    start = F.struct(F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("p0"), F.lit(1).cast("long").alias("q0"), value.cast("double").alias("x"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        a = F.floor(s["x"])
        q = s["q"] * a + s["q0"]
        rest = s["x"] - a
        stop = (rest == 0) | (1 / F.when(rest == 0, F.lit(1.0)).otherwise(rest) > float(0x7FFFFFFF))
        new = F.struct((s["p"] * a + s["p0"]).alias("p"), q.alias("q"), s["p"].alias("p0"), s["q"].alias("q0"), F.when(stop, s["x"]).otherwise(1 / F.when(rest == 0, F.lit(1.0)).otherwise(rest)).alias("x"), stop.alias("done"))
        end = F.struct(s["p"].alias("p"), s["q"].alias("q"), s["p0"].alias("p0"), s["q0"].alias("q0"), s["x"].alias("x"), F.lit(True).alias("done"))
        return F.when(s["done"] | (q > most), end).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: F.struct(s["p"].alias("numerator"), s["q"].alias("denominator")))


def shared(a: Column, a_extent: Column, b: Column, b_extent: Column) -> tuple[Column, Column]:
    """Start and extent of what two intervals share; the extent is below zero where they don't meet."""
    start = F.greatest(a, b)
    return start, F.least(a + a_extent, b + b_extent) - start


def bar_unit(micrometres: Column) -> tuple[Column, Column]:
    """The unit of a scale bar, and its width in that unit."""
    large, small = micrometres >= 999.999, micrometres < 1
    return F.when(large, "mm").when(small, "pm").otherwise("μm"), F.when(large, micrometres / 1000).when(small, micrometres * 1000).otherwise(micrometres)


def placed(origin: Column, offset: Column, pixels: Column, mpp: float) -> tuple[Column, Column]:
    """Where an image begins and ends in the world."""
    return origin + offset, origin + offset + pixels * mpp


def placed_turned(origin: Column, offset: Column, pixels: Column, mpp: float) -> tuple[Column, Column]:
    """The same for the axis that a quarter turn puts before the origin."""
    return origin + offset - pixels * mpp, origin + offset
