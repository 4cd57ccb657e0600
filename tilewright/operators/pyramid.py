"""Tile pyramids and tile requests: visibility, neighbours, prerequisites, priorities, and states over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.geometry import tile_range

#: Bits of the eight neighbours (dx, dy) in a mask.
NEIGHBOURS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def covered(areas: DataFrame, side_x: float, side_y: float, levels: int) -> DataFrame:
    """Areas (x0, y0, x1, y1) with each tile (level, tile_x, tile_y) that they touch: an index range for each level, not a scan of tiles."""
    rows = areas.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    scale = F.pow(F.lit(2.0), F.col("level"))
    for axis, side in (("x", side_x), ("y", side_y)):
        low, high = tile_range(F.col(f"{axis}0"), F.col(f"{axis}1"), side * scale)
        rows = rows.withColumn(f"tile_{axis}", F.explode(F.sequence(low, high - 1)))
    return rows


def neighbour_mask(tiles: DataFrame) -> DataFrame:
    """tiles (level, tile_x, tile_y) with a mask of the neighbours that exist. Each tile tells its neighbours of itself; the bits meet in one grouping."""
    told = F.array(*[F.struct((F.col("tile_x") - dx).alias("tile_x"), (F.col("tile_y") - dy).alias("tile_y"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(NEIGHBOURS)])
    own = F.array(F.struct("tile_x", "tile_y", F.lit(256).alias("bit")))
    rows = tiles.select("level", F.explode(F.concat(told, own)).alias("t")).groupBy("level", "t.tile_x", "t.tile_y").agg(F.bit_or("t.bit").alias("mask"))
    return rows.filter("mask >= 256").withColumn("mask", F.col("mask").bitwiseAND(F.lit(255)))


def parents(tiles: DataFrame) -> DataFrame:
    return tiles.select((F.col("level") + 1).alias("level"), F.floor(F.col("tile_x") / 2).alias("tile_x"), F.floor(F.col("tile_y") / 2).alias("tile_y"))


def prerequisites(wanted: DataFrame, top: int) -> DataFrame:
    """The wanted tiles, and all their ancestors up to the top level, each once: every tile names its ancestors, so nothing is iterated."""
    up = F.sequence(F.col("level"), F.lit(top))
    rows = wanted.filter(F.col("level") <= top).withColumn("up", F.explode(up))
    scale = F.pow(F.lit(2.0), F.col("up") - F.col("level"))
    return rows.select(F.col("up").cast("int").alias("level"), F.floor(F.col("tile_x") / scale).alias("tile_x"), F.floor(F.col("tile_y") / scale).alias("tile_y")).distinct()


def priority(level: Column, levels: int, distance: Column, radius: Column) -> Column:
    """Coarse tiles first, then those near the centre of view."""
    return (levels - level) * 100 + (1 - distance / radius) * 300


def generations(requests: DataFrame) -> DataFrame:
    """requests (viewer, ts, event_id, state columns cam_x, cam_y, zoom) with the viewer's generation, which goes up with every change of state."""
    w = W.partitionBy("viewer").orderBy("ts", "event_id")
    state = F.struct("cam_x", "cam_y", "zoom")
    changed = (~F.lag(state).over(w).eqNullSafe(state)).cast("int")
    return requests.withColumn("changed", changed).withColumn("generation", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def sessions(requests: DataFrame, gap_seconds: float) -> DataFrame:
    """viewer, first_ts, last_ts, n: runs of requests with no pause of the gap or more; an action that waits for a pause happens once for each."""
    w = W.partitionBy("viewer").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) >= int(gap_seconds * 1_000_000)), F.lit(True)).cast("int")
    rows = requests.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("viewer", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
