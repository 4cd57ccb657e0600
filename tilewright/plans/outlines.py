"""Queries over annotations: bounds, areas, rings, spatial joins, selections and edits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import grid, points, rings
from tilewright.operators.ranks import numbered
from tilewright.plans import views as V
from tilewright.plans.registry import query

R6 = lambda c: F.round(c, 6)


@query(V.sql("vtx", "ann", "grp", "edge", then="""
, area as (select ann_id, count(*) as n, abs(sum(x * ny - y * nx)) / 2 as area from edge group by ann_id)
select grp, count(*) as n_annotations, round(sum(area), 6) as total_area from ann join area using (ann_id) join grp using (grp) where not hidden and n >= 3 group by grp""".replace("\n, area", ", area")))  # fmt: skip
def annotation_area_by_group(spark, d):
    area = rings.signed_area(V.vertices(spark, d)).filter("n >= 3").select("ann_id", F.abs("area").alias("area"))
    shown = V.groups(spark, d).filter("not hidden")
    return V.annotations(spark, d).join(area, "ann_id").join(shown, "grp").groupBy("grp").agg(F.count("*").alias("n_annotations"), R6(F.sum("area")).alias("total_area"))


@query(V.sql("vtx", "box", then="select ann_id, x0, y0, x1, y1, n, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy from box"))
def annotation_bounds(spark, d):
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    return b.select("ann_id", "x0", "y0", "x1", "y1", "n", R6((F.col("x0") + F.col("x1")) / 2).alias("cx"), R6((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(V.sql("vtx", "ann", then="select grp, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as n from vtx join ann using (ann_id) group by grp"))
def union_bounds_by_group(spark, d):
    return rings.bounds(V.vertices(spark, d).join(V.annotations(spark, d), "ann_id"), "grp")


@query(V.sql("vtx", "edge", then="select ann_id, count(*) as n, round(sum(x * ny - y * nx) / 2, 6) as area from edge group by ann_id"))
def signed_area(spark, d):
    return rings.signed_area(V.vertices(spark, d)).select("ann_id", "n", R6("area").alias("area"))


@query(V.sql("vtx", "edge", then="select ann_id, ord, nx, ny, round(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 6) as length from edge"))
def ring_edges(spark, d):
    return rings.edges(V.vertices(spark, d)).select("ann_id", "ord", "nx", "ny", R6(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("length"))


@query(V.sql("vtx", then="select ann_id, count(*) as segments, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) as length from (select *, lead(x) over w as nx, lead(y) over w as ny from vtx window w as (partition by ann_id order by ord)) where nx is not null group by ann_id"))
def open_line_length(spark, d):
    e = rings.edges(V.vertices(spark, d), closed=False)
    return e.groupBy("ann_id").agg(F.count("*").alias("segments"), R6(F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))).alias("length"))


@query(V.sql("vtx", then="select ann_id, n - ord + 1 as ord, x, y from vtx"))
def ring_reverse(spark, d):
    r = rings.rings(V.vertices(spark, d)).select("ann_id", F.posexplode(F.reverse("ring")).alias("pos", "p"))
    return r.select("ann_id", (F.col("pos") + 1).cast("long").alias("ord"), "p.x", "p.y")


@query(V.sql("vtx", then="select ann_id, ((ord - 1 - (n // 2) + n) % n) as pos, x, y from vtx union all select ann_id, n, x, y from vtx where ord - 1 = n // 2"))
def ring_rotate(spark, d):
    r = rings.rings(V.vertices(spark, d)).select("ann_id", F.posexplode(rings.rotated(F.col("ring"), (F.size("ring") / 2).cast("int"))).alias("pos", "p"))
    return r.select("ann_id", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")


_SPLIT = """, e as (select ann_id, ord, n, x, y, 0 as part from vtx where n >= 4 and ord <= 3 union all select ann_id, case when ord = 1 then n + 1 else ord end, n, x, y, 1 from vtx where n >= 4 and (ord >= 3 or ord = 1)),
f as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from e window w as (partition by ann_id, part order by ord rows between unbounded preceding and unbounded following))
select ann_id, part, count(*) as n, round(sum(x * ny - y * nx) / 2, 6) as area from f group by ann_id, part"""


@query(V.sql("vtx", then="").rstrip() + _SPLIT)
def ring_split(spark, d):
    r = rings.rings(V.vertices(spark, d)).filter(F.size("ring") >= 4)
    a, b = rings.split(F.col("ring"), F.lit(0), F.lit(2))
    parts = r.select("ann_id", F.posexplode(F.array(a, b)).alias("part", "ring"))
    return parts.select("ann_id", "part", F.size("ring").cast("long").alias("n"), R6(rings.ring_area(F.col("ring"))).alias("area"))


@query(V.sql("vtx", then="select ann_id, n + 1 as n_inserted, greatest(n - 1, 0) as n_deleted, x as new_x, y + 1 as new_y from vtx where ord = 1"))
def vertex_insert_delete(spark, d):
    r = rings.rings(V.vertices(spark, d))
    first = F.element_at("ring", 1)
    new = rings.inserted(F.col("ring"), F.lit(1), F.struct(first["x"].alias("x"), (first["y"] + 1).alias("y")))
    less = rings.without(F.col("ring"), F.lit(0))
    return r.select("ann_id", F.size(new).cast("long").alias("n_inserted"), F.size(less).cast("long").alias("n_deleted"), F.element_at(new, 2)["x"].alias("new_x"), F.element_at(new, 2)["y"].alias("new_y"))


@query(V.sql("vtx", then=", moved as (select ann_id, ord, n, case when ord = 2 then x + 1 else x end as x, case when ord = 2 then y - 1 else y end as y from vtx), e as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from moved window w as (partition by ann_id order by ord rows between unbounded preceding and unbounded following)) select ann_id, round(sum(x * ny - y * nx) / 2, 6) as area from e group by ann_id").replace(") ,", "),"))
def vertex_move(spark, d):
    r = rings.rings(V.vertices(spark, d))
    p = F.element_at("ring", 2)
    moved = F.when(F.size("ring") >= 2, rings.replaced(F.col("ring"), F.lit(1), F.struct((p["x"] + 1).alias("x"), (p["y"] - 1).alias("y")))).otherwise(F.col("ring"))
    return r.select("ann_id", R6(rings.ring_area(moved)).alias("area"))


@query(V.sql("vtx", "box", then="select ann_id, case when n = 1 then 'point' when n = 2 then 'line' when n = 4 then 'rectangle' else 'polygon' end as type, case when n = 4 then round((x1 - x0) * (y1 - y0), 6) end as snapped_area from box"))
def type_coercion(spark, d):
    """The type that a number of vertices allows; a rectangle is snapped to its bounds."""
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    kind = F.when(F.col("n") == 1, "point").when(F.col("n") == 2, "line").when(F.col("n") == 4, "rectangle").otherwise("polygon")
    return b.select("ann_id", kind.alias("type"), F.when(F.col("n") == 4, R6((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("snapped_area"))


@query(V.sql("ann", then="select ann_id, coalesce(lead(ann_id) over w, first_value(ann_id) over w) as next_id, coalesce(lag(ann_id) over w, last_value(ann_id) over w) as previous_id from (select *, f0 from ann) a join (select o_orderkey, o_custkey from orders) o on o_orderkey = ann_id window w as (partition by o_custkey order by ann_id rows between unbounded preceding and unbounded following)"))
def cycle_next_in_group(spark, d):
    """The next and previous annotation of the same set (a customer's orders), cyclically."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("ann_id"), "o_custkey")
    w = W.partitionBy("o_custkey").orderBy("ann_id")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return o.select("ann_id", F.coalesce(F.lead("ann_id").over(w), F.first("ann_id").over(full)).alias("next_id"), F.coalesce(F.lag("ann_id").over(w), F.last("ann_id").over(full)).alias("previous_id"))


@query(V.sql("vtx", "box", then="select ann_id, cast(floor(x0 / 0.25) as bigint) as px0, cast(ceil(x1 / 0.25) as bigint) as px1, cast(floor(y0 / 0.5) as bigint) as py0, cast(ceil(y1 / 0.5) as bigint) as py1, cast(floor(x0 / 4) as bigint) as tx0, cast(floor(x1 / 4) as bigint) + 1 as tx1, cast(floor(y0 / 8) as bigint) as ty0, cast(floor(y1 / 8) as bigint) + 1 as ty1 from box"))
def world_to_pixels_and_tiles(spark, d):
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    out = [F.col("ann_id")]
    for c, unit, side in (("x", 0.25, 4), ("y", 0.5, 8)):
        (p0, p1), (t0, t1) = G.pixel_range(F.col(f"{c}0"), F.col(f"{c}1"), F.lit(unit)), G.tile_range(F.col(f"{c}0"), F.col(f"{c}1"), F.lit(side))
        out += [p0.alias(f"p{c}0"), p1.alias(f"p{c}1"), t0.alias(f"t{c}0"), t1.alias(f"t{c}1")]
    return b.select(*out)


@query(V.sql("vtx", "box", then="select ann_id, greatest(least(x0, 40.0), 10.0) as x0, least(greatest(x1, 10.0), 40.0) as x1, x0 <= 40 and x1 >= 10 and y0 <= 60 and y1 >= 20 as touches, x0 < 40 and x1 > 10 and y0 < 60 and y1 > 20 as overlaps from box"))
def rect_clip(spark, d):
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    low, high = G.clip(F.col("x0"), F.col("x1"), F.lit(10.0), F.lit(40.0))
    area = [F.lit(v) for v in (10.0, 20.0, 40.0, 60.0)]
    own = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return b.select("ann_id", F.greatest(F.least(F.col("x0"), F.lit(40.0)), F.lit(10.0)).alias("x0"), high.alias("x1"), G.overlaps(*own, *area).alias("touches"), G.overlaps(*own, *area, touching=False).alias("overlaps"))


@query(V.sql("vtx", "edge", then="select ann_id, ord, round(t, 6) as t, round(sqrt((x + t * (nx - x) - 25) * (x + t * (nx - x) - 25) + (y + t * (ny - y) - 40) * (y + t * (ny - y) - 40)), 6) as distance from (select *, case when (nx - x) * (nx - x) + (ny - y) * (ny - y) = 0 then 0.0 else greatest(0.0, least(1.0, ((25 - x) * (nx - x) + (40 - y) * (ny - y)) / ((nx - x) * (nx - x) + (ny - y) * (ny - y)))) end as t from edge)"))
def segment_projection(spark, d):
    e = rings.edges(V.vertices(spark, d))
    e = e.withColumn("t", G.segment_share(F.lit(25.0), F.lit(40.0), F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))
    return e.select("ann_id", "ord", R6("t").alias("t"), R6(F.expr("sqrt((x + t * (nx - x) - 25) * (x + t * (nx - x) - 25) + (y + t * (ny - y) - 40) * (y + t * (ny - y) - 40))")).alias("distance"))


@query(V.sql("vtx", "box", then="select ann_id, round(cos(0.3) * (x0 - 25) - sin(0.3) * (y0 - 50), 6) as rx, round(sin(0.3) * (x0 - 25) + cos(0.3) * (y0 - 50), 6) as ry, round(abs(cos(0.3)) * (x1 - x0) + abs(sin(0.3)) * (y1 - y0), 6) as width from box"))
def rotated_bounds(spark, d):
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    rx, ry = G.rotated(F.col("x0") - 25, F.col("y0") - 50, F.lit(0.3))
    return b.select("ann_id", R6(rx).alias("rx"), R6(ry).alias("ry"), R6(F.expr("abs(cos(0.3D)) * (x1 - x0) + abs(sin(0.3D)) * (y1 - y0)")).alias("width"))


@query(V.sql("vtx", "box", "req", then="select event_id, count(ann_id) as n_hit, min(ann_id) as first_hit from (select event_id, cam_x, cam_y from req where event_id % 50 = 0) left join box on cam_x >= x0 - 0.5 and cam_x < x1 + 0.5 and cam_y >= y0 - 0.5 and cam_y < y1 + 0.5 group by event_id"))
def point_in_bounds(spark, d):
    """How many annotations' bounds, widened by half a unit, hold each point of a query set; counted at the nodes of a tree over the points."""
    at = V.requests(spark, d).filter("event_id % 50 = 0").select("event_id", F.col("cam_x").alias("px"), F.col("cam_y").alias("py"))
    b = rings.bounds(V.vertices(spark, d), "ann_id").select(F.col("ann_id").alias("id"), (F.col("x0") - 0.5).alias("x0"), (F.col("y0") - 0.5).alias("y0"), (F.col("x1") + 0.5).alias("x1"), (F.col("y1") + 0.5).alias("y1"))
    return at.join(points.holding(at, b), ["px", "py"], "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n_hit"), F.col("first").alias("first_hit"))


@query(V.sql("vtx", "edge", "req", then=""", pt as (select event_id, cam_x as px, cam_y as py from req where event_id % 50 = 0),
near as (select event_id, ann_id, ord, sqrt(power(x + t * (nx - x) - px, 2) + power(y + t * (ny - y) - py, 2)) as dist from (select *, case when (nx - x) * (nx - x) + (ny - y) * (ny - y) = 0 then 0.0 else greatest(0.0, least(1.0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / ((nx - x) * (nx - x) + (ny - y) * (ny - y)))) end as t from pt, edge))
select event_id, ann_id, ord, round(dist, 6) as distance from (select *, row_number() over (partition by event_id order by round(dist, 9), ann_id, ord) as r from near) where r = 1"""))
def nearest_annotation(spark, d):
    """The nearest segment of all outlines, however far, to each point of a query set; of equals the first."""
    at = V.requests(spark, d).filter("event_id % 50 = 0").select("event_id", F.col("cam_x").alias("px"), F.col("cam_y").alias("py"))
    return grid.nearest_outline(at, V.loose_vertices(spark, d), *V.ORDER).select("event_id", "ann_id", "ord", R6("dist").alias("distance"))


@query(V.sql("vtx", "box", "ann", then="select ann_id, grp, round(least(greatest(x0 - 10, 0.0), 20.0), 6) as x0, round(least(greatest(y0 - 20, 0.0), 30.0), 6) as y0, round(least(greatest(x1 - 10, 0.0), 20.0), 6) as x1, round(least(greatest(y1 - 20, 0.0), 30.0), 6) as y1 from box join ann using (ann_id) where x0 <= 30 and x1 >= 10 and y0 <= 50 and y1 >= 20"))
def crop_annotations(spark, d):
    """Annotations that touch an area, moved to its corner and clamped into it."""
    area = [F.lit(v) for v in (10.0, 20.0, 30.0, 50.0)]
    b = rings.bounds(V.vertices(spark, d), "ann_id").filter(G.overlaps(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *area))
    move = lambda c, low, most: R6(F.least(F.greatest(F.col(c) - low, F.lit(0.0)), F.lit(most))).alias(c)
    return b.join(V.annotations(spark, d), "ann_id").select("ann_id", "grp", move("x0", 10.0, 20.0), move("y0", 20.0, 30.0), move("x1", 10.0, 20.0), move("y1", 20.0, 30.0))


@query(V.sql("ann", then="select status, count(*) as n, case when count(distinct grp) > 1 then '(mixed)' else min(grp) end as value, cast(sum(cast(f0 > 200000 as int)) as bigint) as n_selected, cast(sum(cast(f0 <> 0 as int)) as bigint) as n_nonzero from ann group by status"))
def mixed_value(spark, d):
    a = V.annotations(spark, d)
    value = F.when(F.min("grp") != F.max("grp"), "(mixed)").otherwise(F.min("grp"))
    return a.groupBy("status").agg(F.count("*").alias("n"), value.alias("value"), F.count_if(F.col("f0") > 200000).alias("n_selected"), F.count_if(F.col("f0") != 0).alias("n_nonzero"))


@query(V.sql("ann", then="select grp, count(*) as n from ann where ann_id not in (select ann_id from ann where f0 > 200000) group by grp"))
def delete_selected(spark, d):
    a = V.annotations(spark, d)
    return a.join(a.filter("f0 > 200000").select("ann_id"), "ann_id", "left_anti").groupBy("grp").agg(F.count("*").alias("n"))


@query(V.sql("ann", then="select case when grp = '3-MEDIUM' then 'None' else grp end as grp, count(*) as n, cast(sum(cast(f0 > 150000 as int)) as bigint) as n_moved from ann group by all"))
def delete_group(spark, d):
    """A deleted group's members go to the group None."""
    grp = F.when(F.col("grp") == "3-MEDIUM", "None").otherwise(F.col("grp"))
    return V.annotations(spark, d).groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("f0") > 150000).alias("n_moved"))


@query("with names as (select o_orderpriority as name, min(o_orderkey) as first_seen from orders group by 1) select name, row_number() over (order by first_seen) - 1 as group_id from names")
def upsert_groups(spark, d):
    """Group names get numbers in the order in which they are first seen."""
    names = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min("o_orderkey").alias("first_seen"))
    return numbered(names, F.asc("first_seen"), name="group_id").select("name", "group_id")


@query(V.sql("ann", "grp", then="select grp, hidden, count(*) as n, round(sum(f0), 2) as total from ann join grp using (grp) group by all"))
def annotation_group_join(spark, d):
    return V.annotations(spark, d).join(V.groups(spark, d), "grp").groupBy("grp", "hidden").agg(F.count("*").alias("n"), F.round(F.sum("f0"), 2).alias("total"))


@query("select o_custkey, bool_and(o_orderpriority = '1-URGENT') as allowed, count(*) as n from orders group by o_custkey")
def feature_allowed(spark, d):
    """A feature of a group is allowed only where all selected annotations are of that group."""
    o = V.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderpriority") == "1-URGENT").alias("allowed"), F.count("*").alias("n"))


@query("select o_orderkey as ann_id, 'Annotation ' || o_orderkey as name, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4 as batch, row_number() over (partition by o_custkey order by o_orderkey) * 10000 as sparse from orders")
def batch_assign(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.row_number().over(w)
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("ann_id"), F.format_string("Annotation %d", F.col("o_orderkey")).alias("name"), F.floor((n - 1) / 4).alias("batch"), (n.cast("long") * 10000).alias("sparse"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset from lineitem")
def running_offsets(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").rowsBetween(W.unboundedPreceding, -1)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(0)).alias("byte_offset"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) - 1 as level, coalesce(lag(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey) = o_totalprice, false) as same_as_before from orders")
def rank_levels(spark, d):
    """Instances of a series by width, largest first; equal widths are an error that a caller can see."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return V.table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("level"), F.coalesce(F.lag("o_totalprice").over(w) == F.col("o_totalprice"), F.lit(False)).alias("same_as_before"))


@query("select p_partkey, round(p_retailprice, 2) as width, case when p_retailprice / power(10, floor(log10(p_retailprice))) >= 5 then 5 when p_retailprice / power(10, floor(log10(p_retailprice))) >= 2 then 2 else 1 end * power(10, floor(log10(p_retailprice))) as bar from part where p_retailprice > 0")
def scale_bar(spark, d):
    p = V.table(spark, d, "part").filter("p_retailprice > 0")
    return p.select("p_partkey", F.round("p_retailprice", 2).alias("width"), G.scale_bar(F.col("p_retailprice")).alias("bar"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then -(l_partkey % 32768) else l_partkey % 32768 end as value, case when l_linenumber % 2 = 0 then 32768 else 0 end + (l_partkey % 32768) as magnitude from lineitem")
def sign_magnitude(spark, d):
    """Signed-magnitude 16-bit numbers to two's complement."""
    raw = F.when(F.col("l_linenumber") % 2 == 0, 32768).otherwise(0) + F.col("l_partkey") % 32768
    low = raw.bitwiseAND(F.lit(32767))
    value = F.when(raw.bitwiseAND(F.lit(32768)) != 0, -low).otherwise(low)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"), raw.alias("magnitude"))


@query(V.sql("vtx", then="select ann_id, ord, ((50 - 10) * (y - 20) - (60 - 20) * (x - 10) >= 0) and ((10 - 50) * (y - 60) - (100 - 60) * (x - 50) >= 0) and ((10 - 10) * (y - 100) - (20 - 100) * (x - 10) >= 0) as inside from vtx"))
def point_in_triangle(spark, d):
    corners = [F.lit(float(v)) for v in (10, 20, 50, 60, 10, 100)]
    return V.vertices(spark, d).select("ann_id", "ord", G.in_triangle(F.col("x"), F.col("y"), *corners).alias("inside"))
