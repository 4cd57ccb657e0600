"""Spatial joins by grid cells: an equi-join on cells with a residual test, so that no pair of far-away rows is ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import overlaps
from tilewright.operators import points as searches


def cells(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """The cells that bounds touch, as array<struct<cx, cy>>."""
    axis = lambda a, b, side: F.sequence(F.floor(a / side), F.floor(b / side))
    return F.flatten(F.transform(axis(x0, x1, width), lambda cx: F.transform(axis(y0, y1, height), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def overlap_join(a: DataFrame, b: DataFrame, width: float, height: float, touching: bool = True) -> DataFrame:
    """Pairs of rows of a and b (with x0, y0, x1, y1 each; those of b come out as b_x0 ...) whose bounds overlap, each once.

    Both sides are dealt out by cells of the given sides; a pair is made only in the first cell that both touch, so nothing needs to be made distinct. Bounds with a null match nothing.
    """
    b = b.withColumnsRenamed({c: f"b_{c}" for c in ("x0", "y0", "x1", "y1")})
    left = a.withColumn("_cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width, height)))
    right = b.withColumn("_cell", F.explode(cells(F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"), width, height)))
    first_x, first_y = F.floor(F.greatest("x0", "b_x0") / width), F.floor(F.greatest("y0", "b_y0") / height)
    test = overlaps(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "b_x0", "b_y0", "b_x1", "b_y1")], touching=touching)
    return left.join(right, "_cell").filter(test & (F.col("_cell.cx") == first_x) & (F.col("_cell.cy") == first_y)).drop("_cell")


def nearest_segment(points: DataFrame, edges: DataFrame) -> DataFrame:
    """event_id, ann_id, ord, dist: of all edges (ann_id, ord, x, y, nx, ny) the nearest to each of points (event_id, px, py), however far; of equals (to nine places) the first. Points or edges with a null or no finite number
    match nothing."""
    return points.join(searches.nearest(points, edges), ["px", "py"]).select("event_id", "ann_id", F.col("ord").cast("int").alias("ord"), "dist")


def nearest_outline(points: DataFrame, vertices: DataFrame, *order: str) -> DataFrame:
    """nearest_segment(), of the edges of closed outlines of vertices (ann_id, x, y) in this order."""
    return points.join(searches.nearest_outline(points, vertices, *order), ["px", "py"]).select("event_id", "ann_id", F.col("ord").cast("int").alias("ord"), "dist")


def fragment_overlap(cameras: DataFrame, tiles: DataFrame | None, across: int, down: int, width: float, height: float) -> DataFrame:
    """Where the stored fragments of cameras (camera, x0, y0, x1, y1) lie on output tiles (tile_x, tile_y, of the given sides): each camera, fragment and tile with an area in common, once.

    A camera's image is stored as across x down fragments of equal sides. Rows are camera, fragment_x, fragment_y, tile_x, tile_y, the offsets of the common part in the tile (at_x, at_y)
    and in the fragment (from_x, from_y), and its sides (span_x, span_y). What only touches has nothing in common; bounds with a null match nothing. Without tiles all places of the grid are tiles, and no row is moved: sums by tile
    are then best made before they are joined with the tiles, as many cameras may lie on few tiles.
    """
    step_x, step_y = (F.col("x1") - F.col("x0")) / across, (F.col("y1") - F.col("y0")) / down
    part = cameras.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("fragment_x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("fragment_y"))
    low = [F.col("x0") + step_x * F.col("fragment_x"), F.col("y0") + step_y * F.col("fragment_y")]
    high = [F.col("x0") + step_x * (F.col("fragment_x") + 1), F.col("y0") + step_y * (F.col("fragment_y") + 1)]
    part = part.select("camera", "fragment_x", "fragment_y", low[0].alias("x0"), low[1].alias("y0"), high[0].alias("x1"), high[1].alias("y1"))
    # an output tile is a cell of the grid, so each side of a pair meets in that cell alone
    seen = part.withColumn("_cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width, height))).select("*", F.col("_cell.cx").alias("tile_x"), F.col("_cell.cy").alias("tile_y"))
    if tiles is not None:
        seen = seen.join(tiles.select("tile_x", "tile_y").distinct(), ["tile_x", "tile_y"])
    left, top = F.greatest(F.col("x0"), F.col("tile_x") * width), F.greatest(F.col("y0"), F.col("tile_y") * height)
    right, bottom = F.least(F.col("x1"), (F.col("tile_x") + 1) * width), F.least(F.col("y1"), (F.col("tile_y") + 1) * height)
    offsets = [(left - F.col("tile_x") * width).alias("at_x"), (top - F.col("tile_y") * height).alias("at_y"), (left - F.col("x0")).alias("from_x"), (top - F.col("y0")).alias("from_y"), (right - left).alias("span_x"), (bottom - top).alias("span_y")]
    return seen.filter((left < right) & (top < bottom)).select("camera", "fragment_x", "fragment_y", "tile_x", "tile_y", *offsets)
