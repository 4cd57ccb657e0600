"""Reads of pixel regions across tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.pyramid import covered


def mosaic(regions: DataFrame, tiles: DataFrame, value: str, side_x: float, side_y: float, levels: int, background: object) -> DataFrame:
    """region_id, level, width, values: for each region (region_id, x0, y0, x1, y1) the tiles' values row by row; tiles that aren't stored have the background's.

    A region is a request of bounded size, so its tiles are gathered into one row.
    """
    seen = covered(regions, side_x, side_y, levels).join(tiles.select("level", "tile_x", "tile_y", value), ["level", "tile_x", "tile_y"], "left")
    cell = F.struct("tile_y", "tile_x", F.coalesce(value, F.lit(background)).alias("v"))
    rows = seen.groupBy("region_id", "level").agg(F.sort_array(F.collect_list(cell)).alias("c"), (F.max("tile_x") - F.min("tile_x") + 1).alias("width"))
    return rows.select("region_id", "level", "width", F.transform("c", lambda c: c["v"]).alias("values"))


def pixels(regions: DataFrame, tiles: DataFrame, side: int, width: int, height: int, background: int) -> DataFrame:
    """region_id, values: the pixels of each region (region_id, x, y, width, height), row by row, from tiles (tile_x, tile_y, px) of side x side values.

    The background stands where no tile is stored and outside of the image of width x height, over whose edge the last tiles may reach. Each tile gives a piece of each row; a region is a request of
    bounded size, so its pieces are gathered into one row.
    """
    r = regions.selectExpr("region_id", "x as rx", "y as ry", "x + width as rx1", "y + height as ry1")
    across = F.sequence(F.floor(F.col("rx") / side), F.floor((F.col("rx1") - 1) / side))
    down = F.sequence(F.floor(F.col("ry") / side), F.floor((F.col("ry1") - 1) / side))
    seen = r.select("*", F.explode(across).alias("tile_x")).select("*", F.explode(down).alias("tile_y")).join(tiles.select("tile_x", "tile_y", "px"), ["tile_x", "tile_y"], "left")
    x0, x1 = F.greatest("rx", F.col("tile_x") * side), F.least(F.col("rx1"), (F.col("tile_x") + 1) * side)
    rows = F.sequence(F.greatest("ry", F.col("tile_y") * side), F.least(F.col("ry1"), (F.col("tile_y") + 1) * side) - 1)
    inside = lambda x: (x >= 0) & (x < width) & (F.col("row") >= 0) & (F.col("row") < height)
    value = lambda x: F.when(inside(x), F.element_at("px", ((F.col("row") - F.col("tile_y") * side) * side + x - F.col("tile_x") * side + 1).cast("int")))
    piece = F.transform(F.sequence(x0, x1 - 1), lambda x: F.coalesce(value(x), F.lit(background)))
    pieces = seen.select("*", F.explode(rows).alias("row")).select("region_id", F.struct("row", x0.alias("x"), piece.alias("v")).alias("piece"))
    whole = pieces.groupBy("region_id").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    return whole.select("region_id", F.flatten(F.transform("p", lambda p: p["v"])).alias("values"))


def write_pyramid(tiles: DataFrame, path: str, side: int, area: tuple[int, int, int, int], levels: int) -> None:
    """Writes the pixels of an area (x0, y0, x1, y1) of tiles (tile_x, tile_y, px) as tiles of the same side for each level, in a folder for each; a pixel of a level is the rounded sum over four of those of the
    level below, by four (missing ones count as 0). px has nulls where a tile has no pixel. Each level is made from the one below it as it was written."""
    x0, y0, x1, y1 = area
    flat = tiles.select("tile_x", "tile_y", F.posexplode("px").alias("i", "v")).select((F.col("tile_x") * side + F.col("i") % side).alias("x"), (F.col("tile_y") * side + F.floor(F.col("i") / side)).alias("y"), F.col("v").cast("long").alias("v"))
    flat = flat.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    for level in range(levels):
        if level:
            flat = flat.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.shiftright(F.sum("v") + 2, 2).alias("v"))
        place = ((F.col("y") % side) * side + F.col("x") % side).cast("int")
        held = flat.groupBy(F.floor(F.col("x") / side).alias("tile_x"), F.floor(F.col("y") / side).alias("tile_y")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), "v"))).alias("m"))
        own = held.select("tile_x", "tile_y", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at("m", i)).alias("px"))
        own.write.parquet(f"{path}/level={level}")
        if level < levels - 1:
            back = tiles.sparkSession.read.schema(own.schema).parquet(f"{path}/level={level}")
            flat = back.select("tile_x", "tile_y", F.posexplode("px").alias("i", "v")).filter("v is not null").select((F.col("tile_x") * side + F.col("i") % side).alias("x"), (F.col("tile_y") * side + F.floor(F.col("i") / side)).alias("y"), "v")
