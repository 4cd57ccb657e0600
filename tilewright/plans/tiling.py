"""Queries over tiles and tile requests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators import pyramid as P
from tilewright.operators import grid, regions, rings
from tilewright.plans import views as V
from tilewright.plans.registry import query


@query(V.sql("vtx", "tile", then="select level, count(*) as n_tiles, cast(sum(n_points) as bigint) as n_points, max(tile_x) + 1 as width, max(tile_y) + 1 as height from tile group by level"))
def tiles_by_level(spark, d):
    return V.tiles(spark, d).groupBy("level").agg(F.count("*").alias("n_tiles"), F.sum("n_points").alias("n_points"), (F.max("tile_x") + 1).alias("width"), (F.max("tile_y") + 1).alias("height"))


@query(V.sql("req", then=""", cam as (select event_id, cam_x - 6 as x0, cam_x + 6 as x1, cam_y - 9 as y0, cam_y + 9 as y1 from req), lev as (select * from cam, range(3) t(level))
select event_id, level, cast((floor(x1 / (4 * pow(2.0, level))) - floor(x0 / (4 * pow(2.0, level))) + 1) * (floor(y1 / (8 * pow(2.0, level))) - floor(y0 / (8 * pow(2.0, level))) + 1) as bigint) as n_tiles from lev"""))
def region_cover(spark, d):
    """How many tiles of each level each request's region touches."""
    return _cover(V.requests(spark, d))


def _cover(requests):
    cam = requests.selectExpr("event_id", "cam_x - 6 as x0", "cam_x + 6 as x1", "cam_y - 9 as y0", "cam_y + 9 as y1")
    return P.covered(cam, 4.0, 8.0, 3).groupBy("event_id", "level").agg(F.count("*").alias("n_tiles"))


@query(V.sql("vtx", "tile", "req", then=""", cam as (select event_id, cam_x - 6 as x0, cam_x + 6 as x1, cam_y - 9 as y0, cam_y + 9 as y1 from req where event_id % 50 = 0)
select event_id, level, count(*) as n_tiles, cast(sum(n_points) as bigint) as n_points from cam join tile on tile_x between floor(x0 / (4 * pow(2.0, level))) and floor(x1 / (4 * pow(2.0, level))) and tile_y between floor(y0 / (8 * pow(2.0, level))) and floor(y1 / (8 * pow(2.0, level))) group by all"""))
def viewport_tiles(spark, d):
    """The stored tiles in each camera's view, by an equi-join on tile indexes."""
    cam = V.requests(spark, d).filter("event_id % 50 = 0").selectExpr("event_id", "cam_x - 6 as x0", "cam_x + 6 as x1", "cam_y - 9 as y0", "cam_y + 9 as y1")
    seen = P.covered(cam, 4.0, 8.0, 5).join(V.tiles(spark, d), ["level", "tile_x", "tile_y"])
    return seen.groupBy("event_id", "level").agg(F.count("*").alias("n_tiles"), F.sum("n_points").alias("n_points"))


@query(V.sql("vtx", "tile", then="select a.level, a.tile_x, a.tile_y, cast(coalesce(sum(case b.tile_x - a.tile_x + 10 * (b.tile_y - a.tile_y) when -11 then 1 when -10 then 2 when -9 then 4 when -1 then 8 when 1 then 16 when 9 then 32 when 10 then 64 when 11 then 128 end), 0) as bigint) as mask from tile a left join tile b on a.level = b.level and abs(a.tile_x - b.tile_x) <= 1 and abs(a.tile_y - b.tile_y) <= 1 and (a.tile_x <> b.tile_x or a.tile_y <> b.tile_y) group by all"))
def neighbour_mask(spark, d):
    return P.neighbour_mask(V.tiles(spark, d)).select("level", "tile_x", "tile_y", F.col("mask").cast("long").alias("mask"))


@query(V.sql("vtx", "tile", then="select p.level, p.tile_x, p.tile_y, count(*) as n_children, bool_and(p.n_points >= c.n_points) as holds from tile c join tile p on p.level = c.level + 1 and p.tile_x = c.tile_x // 2 and p.tile_y = c.tile_y // 2 group by all"))
def quadtree_parent(spark, d):
    t = V.tiles(spark, d)
    child = t.select((F.col("level") + 1).alias("level"), F.floor(F.col("tile_x") / 2).alias("tile_x"), F.floor(F.col("tile_y") / 2).alias("tile_y"), F.col("n_points").alias("below"))
    return child.join(t, ["level", "tile_x", "tile_y"]).groupBy("level", "tile_x", "tile_y").agg(F.count("*").alias("n_children"), F.bool_and(F.col("n_points") >= F.col("below")).alias("holds"))


@query(V.sql("vtx", "tile", then="select u.level, cast(floor(tile_x / pow(2.0, u.level - t.level)) as bigint) as tile_x, cast(floor(tile_y / pow(2.0, u.level - t.level)) as bigint) as tile_y from tile t, range(5) u(level) where t.level = 0 and u.level >= t.level group by all"))
def prerequisite_closure(spark, d):
    """All stored tiles of level 0 and all their ancestors."""
    return P.prerequisites(V.tiles(spark, d).filter("level = 0"), 4)


@query(V.sql("vtx", "tile", then="select level, tile_x, tile_y from tile t where n_points > 1 and not exists (select 1 from tile p where p.level = t.level + 1 and p.tile_x = t.tile_x // 2 and p.tile_y = t.tile_y // 2 and p.n_points % 2 = 0)"))
def tiles_to_request(spark, d):
    """Tiles that aren't empty and aren't covered by what is resident."""
    t = V.tiles(spark, d)
    want = t.filter("n_points > 1").withColumns({"pl": F.col("level") + 1, "px": F.floor(F.col("tile_x") / 2), "py": F.floor(F.col("tile_y") / 2)})
    resident = t.filter("n_points % 2 = 0").select(F.col("level").alias("pl"), F.col("tile_x").alias("px"), F.col("tile_y").alias("py"))
    return want.join(resident, ["pl", "px", "py"], "left_anti").select("level", "tile_x", "tile_y")


@query(V.sql("vtx", "tile", then="select l.level, count(tile_x) as n_tiles, count(tile_x) > 0 as present from range(7) l(level) left join tile on tile.level = l.level group by l.level"))
def level_placeholders(spark, d):
    """Every wanted level, stored or not."""
    wanted = V.tiles(spark, d).agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("level"))
    stored = V.tiles(spark, d).groupBy("level").agg(F.count("*").alias("n"))
    return wanted.join(stored, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n_tiles"), F.col("n").isNotNull().alias("present"))


_RANKED = ", p as (select viewer, event_id, zoom, (5 - zoom) * 100 + (1 - sqrt((cam_x - 32) * (cam_x - 32) + (cam_y - 32) * (cam_y - 32)) / 100) * 300 as prio from req)"


@query(V.sql("req", then=_RANKED + " select viewer, event_id, zoom, round(prio, 4) as prio, r from (select *, row_number() over (partition by viewer order by round(prio, 9) desc, event_id) as r from p) where r <= 8").replace(") , p", "), p"))
def tile_priority_topk(spark, d):
    """The eight most urgent requests of each viewer."""
    r = V.requests(spark, d)
    far = F.expr("sqrt((cam_x - 32) * (cam_x - 32) + (cam_y - 32) * (cam_y - 32))")
    r = r.withColumn("prio", P.priority(F.col("zoom"), 5, far, F.lit(100.0)))
    w = W.partitionBy("viewer").orderBy(F.desc(F.round("prio", 9)), "event_id")
    return r.withColumn("r", F.row_number().over(w)).filter("r <= 8").select("viewer", "event_id", "zoom", F.round("prio", 4).alias("prio"), F.col("r").cast("long").alias("r"))


@query(V.sql("req", then="select viewer, event_id from (select *, row_number() over (partition by viewer order by zoom desc, event_id) as n from (select *, row_number() over (partition by viewer order by event_id) as s from req) where s <= 12) where n <= 4"))
def scan_cap_then_topk(spark, d):
    """The first twelve candidates of each viewer in scan order, and of those the four coarsest."""
    r = V.requests(spark, d).withColumn("s", F.row_number().over(W.partitionBy("viewer").orderBy("event_id"))).filter("s <= 12")
    return r.withColumn("n", F.row_number().over(W.partitionBy("viewer").orderBy(F.desc("zoom"), "event_id"))).filter("n <= 4").select("viewer", "event_id")


@query(V.sql("req", then="select kind, arg_max(event_id, struct_pack(ts, event_id)) as last_event, arg_min(event_id, struct_pack(cam_y, event_id)) as lowest, min(cam_x) as x0, max(cam_x) as x1, min(cam_y) as y0, max(cam_y) as y1, count(*) as n from req group by kind"))
def camera_extent(spark, d):
    return V.requests(spark, d).groupBy("kind").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.min_by("event_id", F.struct("cam_y", "event_id")).alias("lowest"),
        F.min("cam_x").alias("x0"), F.max("cam_x").alias("x1"), F.min("cam_y").alias("y0"), F.max("cam_y").alias("y1"), F.count("*").alias("n"),
    )


_GEN = ", g as (select *, sum(changed) over w as generation from (select *, case when lag(cam_x) over v is distinct from cam_x or lag(cam_y) over v is distinct from cam_y or lag(zoom) over v is distinct from zoom then 1 else 0 end as changed from req window v as (partition by viewer order by ts, event_id)) window w as (partition by viewer order by ts, event_id rows unbounded preceding))"


@query(V.sql("req", then=_GEN + " select viewer, event_id, cast(changed as int) as changed, cast(generation as bigint) as generation from g").replace(") , g", "), g"))
def generation_counter(spark, d):
    return P.generations(V.requests(spark, d)).select("viewer", "event_id", "changed", "generation")


@query(V.sql("req", then=_GEN + " select viewer, count(*) as n, cast(sum(cast(generation < last and kind <> 'purchase' as int)) as bigint) as n_stale from (select *, max(generation) over (partition by viewer) as last from g) group by viewer").replace(") , g", "), g"))
def stale_requests(spark, d):
    """Requests that a later change of view made stale, unless they are of a kind that is always served."""
    g = P.generations(V.requests(spark, d))
    g = g.join(g.groupBy("viewer").agg(F.max("generation").alias("last")), "viewer")
    return g.groupBy("viewer").agg(F.count("*").alias("n"), F.count_if((F.col("generation") < F.col("last")) & (F.col("kind") != "purchase")).alias("n_stale"))


@query(V.sql("req", then="select viewer, zoom, arg_max(kind, struct_pack(ts, event_id)) as state, max(ts) as last_access, count(*) as n, cast(sum(case when kind = 'click' then 1 when kind = 'view' then -1 else 0 end) as bigint) as pins from req group by all"))
def request_state_last(spark, d):
    """The last state of each key, when it was last touched, and the balance of pins."""
    pin = F.when(F.col("kind") == "click", 1).when(F.col("kind") == "view", -1).otherwise(0)
    return V.requests(spark, d).groupBy("viewer", "zoom").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("last_access"), F.count("*").alias("n"), F.sum(pin).alias("pins"))


@query(V.sql("req", then="select viewer, event_id, cast(sum(case when kind = 'click' then 1 else -1 end) over (partition by viewer order by ts, event_id rows unbounded preceding) as bigint) as pins, event_id % 5 = 0 as throttled from req"))
def pin_balance(spark, d):
    w = W.partitionBy("viewer").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return V.requests(spark, d).select("viewer", "event_id", F.sum(F.when(F.col("kind") == "click", 1).otherwise(-1)).over(w).alias("pins"), (F.pmod("event_id", F.lit(5)) == 0).alias("throttled"))


@query(V.sql("req", then="select viewer, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from (select *, sum(new) over (partition by viewer order by ts, event_id rows unbounded preceding) as session from (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by viewer order by ts, event_id) < 3600000000 then 0 else 1 end as new from req)) group by viewer, session"))
def debounce_sessions(spark, d):
    return P.sessions(V.requests(spark, d), 3600).select("viewer", "first_ts", "last_ts", "n")


@query(V.sql("req", then="select viewer, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by viewer order by ts, event_id)) / 1e6, 3) as seconds from req"))
def seconds_between(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("viewer").orderBy("ts", "event_id")
    return V.requests(spark, d).select("viewer", "event_id", F.round((micros - F.lag(micros).over(w)) / 1e6, 3).alias("seconds"))


@query(V.sql("req", then="select viewer, event_id from (select *, row_number() over (partition by viewer order by ts desc, event_id desc) as n from req) where n > 6"))
def lru_trim(spark, d):
    """What falls out of a store that keeps the six entries of each viewer that were used last."""
    w = W.partitionBy("viewer").orderBy(F.desc("ts"), F.desc("event_id"))
    return V.requests(spark, d).withColumn("n", F.row_number().over(w)).filter("n > 6").select("viewer", "event_id")


@query(V.sql("req", then="select viewer, arg_min(event_id, struct_pack(ts, event_id)) as victim from req where kind <> 'click' group by viewer"))
def lru_victim(spark, d):
    return V.requests(spark, d).filter("kind <> 'click'").groupBy("viewer").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("victim"))


@query(V.sql("req", then="select zoom, cast(bit_or(1 << (k % 5)) as bigint) as demand, count(distinct k) as n_chunks, cast(sum(cast((k & 28) = 0 as int)) as bigint) as n_soft from req group by zoom"))
def demand_mask(spark, d):
    bit = F.pow(F.lit(2), F.col("k") % 5).cast("long")
    return V.requests(spark, d).groupBy("zoom").agg(F.bit_or(bit).alias("demand"), F.count_distinct("k").alias("n_chunks"), F.count_if(F.col("k").bitwiseAND(F.lit(28)) == 0).alias("n_soft"))


@query(V.sql("vtx", "tile", then="select min(level) as first_complete from (select level, count(*) = (max(tile_x) - min(tile_x) + 1) * (max(tile_y) - min(tile_y) + 1) as complete from tile group by level) where complete"))
def first_complete_level(spark, d):
    """The finest level with no hole in it."""
    full = F.count("*") == (F.max("tile_x") - F.min("tile_x") + 1) * (F.max("tile_y") - F.min("tile_y") + 1)
    return V.tiles(spark, d).groupBy("level").agg(full.alias("complete")).filter("complete").agg(F.min("level").alias("first_complete"))


@query("select l_orderkey, l_partkey, l_linenumber, l_partkey % 4 + 4 * (l_suppkey % 4) as tile_index, (l_partkey % 4 + 4 * (l_suppkey % 4)) % 4 as tile_x, (l_partkey % 4 + 4 * (l_suppkey % 4)) // 4 as tile_y, case l_linenumber % 3 when 0 then 0 when 1 then 1 + (l_suppkey % 2) * 2 + l_partkey % 2 else 5 + (l_suppkey % 4) * 4 + l_partkey % 4 end as block from lineitem")
def tile_index_arithmetic(spark, d):
    """Tiles from flat indexes, and the place of a block in its chunk by relative level."""
    li = V.table(spark, d, "lineitem").withColumn("tile_index", F.expr("l_partkey % 4 + 4 * (l_suppkey % 4)"))
    block = F.expr("case l_linenumber % 3 when 0 then 0L when 1 then 1 + (l_suppkey % 2) * 2 + l_partkey % 2 else 5 + (l_suppkey % 4) * 4 + l_partkey % 4 end")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "tile_index", F.expr("tile_index % 4").alias("tile_x"), F.expr("tile_index div 4").alias("tile_y"), block.alias("block"))


@query("select o_custkey, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) as best from orders where o_totalprice >= 100000 group by o_custkey")
def best_level(spark, d):
    """Of the levels that are large enough, the one with the least excess."""
    o = V.table(spark, d, "orders").filter("o_totalprice >= 100000")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query(V.sql("vtx", "box", then="select ann_id, case when greatest(x1 - x0, y1 - y0) / 5 < 2 then 'point' when n < 3 then 'line' else 'fill' end as detail from box"))
def level_of_detail(spark, d):
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    return b.select("ann_id", F.when(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 5 < 2, "point").when(F.col("n") < 3, "line").otherwise("fill").alias("detail"))


@query(V.sql("vtx", "tile", "req", then=""", cam as (select event_id as region_id, cam_x - 6 as x0, cam_x + 6 as x1, cam_y - 9 as y0, cam_y + 9 as y1 from req where event_id % 50 = 0),
cell as (select region_id, level, cast(floor(x0 / (4 * pow(2.0, level))) as bigint) + i as tile_x, cast(floor(y0 / (8 * pow(2.0, level))) as bigint) + j as tile_y, x1, y1 from cam, range(3) l(level), range(5) a(i), range(5) b(j))
select region_id, level, max(tile_x) - min(tile_x) + 1 as width, list(coalesce(n_points, 0) order by tile_y, tile_x) as values from (select * from cell where tile_x <= floor(x1 / (4 * pow(2.0, level))) and tile_y <= floor(y1 / (8 * pow(2.0, level)))) left join tile using (level, tile_x, tile_y) group by region_id, level"""))
def region_mosaic(spark, d):
    """The point counts of each region's tiles, row by row, with 0 where no tile is stored."""
    cam = V.requests(spark, d).filter("event_id % 50 = 0").selectExpr("event_id as region_id", "cam_x - 6 as x0", "cam_x + 6 as x1", "cam_y - 9 as y0", "cam_y + 9 as y1")
    return regions.mosaic(cam, V.tiles(spark, d), "n_points", 4.0, 8.0, 3, 0)


@query(V.sql("vtx", "tile", "box", then=""", part as (select ann_id, i, j, x0 + (x1 - x0) / 3 * i as x0, y0 + (y1 - y0) / 2 * j as y0, x0 + (x1 - x0) / 3 * (i + 1) as x1, y0 + (y1 - y0) / 2 * (j + 1) as y1 from box, range(3) a(i), range(2) b(j)
), own as (select ann_id, i, j, tile_x, tile_y, greatest(x0, tile_x * 4.0::double) as l, greatest(y0, tile_y * 8.0::double) as t, least(x1, (tile_x + 1) * 4.0::double) as r, least(y1, (tile_y + 1) * 8.0::double) as b, x0, y0
  from part join tile on level = 0 and x0 < (tile_x + 1) * 4 and x1 > tile_x * 4 and y0 < (tile_y + 1) * 8 and y1 > tile_y * 8)
select tile_x, tile_y, count(*) as n_fragments, count(distinct ann_id) as n_cameras, max(ann_id) as uppermost, cast(sum(floor((r - l) * (b - t) * 1000)) as bigint) as area, cast(sum(floor(((l - tile_x * 4.0::double) + (t - tile_y * 8.0::double)) * 1000)) as bigint) as at_sum, cast(sum(floor(((l - x0) + (t - y0)) * 1000)) as bigint) as from_sum
from own where l < r and t < b group by tile_x, tile_y"""))
def fragment_overlap(spark, d):
    """What each stored tile is put together from, with outlines' bounds as the places of camera images of 3 x 2 fragments: how many fragments, of how many cameras, the uppermost (last) one, the area that they cover, and sums of their offsets in the tile and in the fragments (in thousandths, each rounded down)."""
    box = V.vertices(spark, d).groupBy("ann_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    seen = grid.fragment_overlap(box.withColumnRenamed("ann_id", "camera"), None, 3, 2, 4.0, 8.0)
    total = lambda c: F.sum(F.floor(c * 1000))
    # a camera counts with the first of its fragments on a tile: the one before it, if there is one, ends where the tile begins or earlier
    first = lambda axis: (F.col(f"fragment_{axis}") == 0) | (F.col(f"at_{axis}") == 0)
    sums = seen.groupBy("tile_x", "tile_y").agg(
        F.count("*").alias("n_fragments"), F.count_if(first("x") & first("y")).alias("n_cameras"), F.max("camera").alias("uppermost"), total(F.col("span_x") * F.col("span_y")).alias("area"),
        total(F.col("at_x") + F.col("at_y")).alias("at_sum"), total(F.col("from_x") + F.col("from_y")).alias("from_sum"),
    )
    return sums.join(V.tiles(spark, d).filter("level = 0").select("tile_x", "tile_y"), ["tile_x", "tile_y"])
