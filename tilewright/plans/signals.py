"""Queries over wavelet rows, layers, frames and settings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import pixels as X
from tilewright.operators import rings
from tilewright.plans import views as V
from tilewright.plans.registry import query


@query(V.sql("patch", then=""", s as (select vec_id, i, cast(floor(px[i + 1] * 100) as bigint) as c from patch, range(8) t(i)),
e as (select a.vec_id, a.i * 2 as pos, a.c - cast(floor((coalesce(p.c, q.c) + q.c + 2) / 4) as bigint) as v from s a left join s p on p.vec_id = a.vec_id and p.i = a.i + 3 and a.i > 0 join s q on q.vec_id = a.vec_id and q.i = a.i + 4 where a.i < 4)
select vec_id, pos, v from e union all select d.vec_id, (d.i - 4) * 2 + 1, d.c + cast(floor((l.v + coalesce(r.v, l.v)) / 2) as bigint) from s d join e l on l.vec_id = d.vec_id and l.pos = (d.i - 4) * 2 left join e r on r.vec_id = d.vec_id and r.pos = (d.i - 4) * 2 + 2 where d.i >= 4"""))
def inverse_lifting(spark, d):
    """A row of four low and four high wavelet coefficients back to eight samples, by integer lifting with mirrored edges."""
    p = V.patches(spark, d).select("vec_id", F.transform(F.slice("px", 1, 8), lambda v: F.floor(v * 100)).alias("c"))
    low, high = lambda i: F.element_at("c", i + 1), lambda i: F.element_at("c", i + 5)
    even = [low(i) - F.floor((high(max(i - 1, 0)) + high(i) + 2) / 4) for i in range(4)]
    p = p.select("vec_id", "c", F.array(*even).alias("e"))
    odd = [high(i) + F.floor((F.element_at("e", i + 1) + F.element_at("e", min(i + 2, 4))) / 2) for i in range(4)]
    p = p.select("vec_id", F.array(*[x for i in range(4) for x in (F.element_at("e", i + 1), odd[i])]).alias("v"))
    return p.select("vec_id", F.posexplode("v").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), "v")


@query("select o_orderkey, round(10 * cos(2 * pi() * k / 48) + o_orderkey % 7, 6) as x, round(5 * sin(2 * pi() * k / 48), 6) as y, k from orders, range(48) t(k)")
def ellipse_points(spark, d):
    """All points of ellipses of 48 segments, of all orders."""
    return _ellipses(V.table(spark, d, "orders"))


def _ellipses(o):
    points = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.struct((10 * F.cos(k * (2 * 3.141592653589793 / 48)) + F.col("o_orderkey") % 7).alias("x"), (5 * F.sin(k * (2 * 3.141592653589793 / 48))).alias("y"), k.cast("long").alias("k")))
    return o.select("o_orderkey", F.explode(points).alias("p")).select("o_orderkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "p.k")


@query(V.sql("patch", then="select vec_id, i, round(px[i + 1] * (1 - 0.25 * least(1.0, greatest(0.0, px[64 - i]))) + px[64 - i] * 0.25 * least(1.0, greatest(0.0, px[64 - i])), 6) as v from patch, range(64) t(i)"))
def layer_blend(spark, d):
    """A second layer mixed in by its own opacity."""
    p = V.patches(spark, d).select("vec_id", F.posexplode(F.arrays_zip(F.col("px").alias("a"), F.reverse("px").alias("b"))).alias("i", "z"))
    alpha = 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z.b")))
    return p.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("z.a") * (1 - alpha) + F.col("z.b") * alpha, 6).alias("v"))


@query(V.sql("req", then="select viewer, event_id, round(avg(cam_y) over w, 6) as mean, count(*) over w as n from req window w as (partition by viewer order by ts, event_id rows between 4 preceding and current row)"))
def last_frames(spark, d):
    """Means over the last five requests of each viewer."""
    w = W.partitionBy("viewer").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return V.requests(spark, d).select("viewer", "event_id", F.round(F.avg("cam_y").over(w), 6).alias("mean"), F.count("*").over(w).alias("n"))


@query(V.sql("req", then="select viewer, zoom, k, min(event_id) as first_request, count(*) - 1 as n_repeats from req group by all"))
def requests_in_flight(spark, d):
    """Requests for what was already asked for are dropped; the first stays."""
    return V.requests(spark, d).groupBy("viewer", "zoom", "k").agg(F.min("event_id").alias("first_request"), (F.count("*") - 1).alias("n_repeats"))


@query(V.sql("req", then="select viewer, event_id, seconds < 0.35 as double_click from (select viewer, event_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by viewer order by ts, event_id)) / 1e6 as seconds from req where kind = 'click')"))
def double_clicks(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("viewer").orderBy("ts", "event_id")
    return V.requests(spark, d).filter("kind = 'click'").select("viewer", "event_id", ((micros - F.lag(micros).over(w)) / 1e6 < 0.35).alias("double_click"))


@query("select l_orderkey, list(chunk order by chunk) as chunks from (select distinct l_orderkey, l_partkey % 100 as chunk from lineitem) group by l_orderkey")
def distinct_chunks(spark, d):
    """The chunks that each tile needs, each once and in file order; a tile needs a few."""
    return V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey") % 100)).alias("chunks"))


@query("select o_orderkey, round(o_totalprice * coalesce(nullif(o_orderkey % 3, 0) * 0.25, 1), 4) as width_um, cast(ceil(o_orderkey / 16.0) as bigint) as width_tiles, cast(ceil(log2(o_orderkey + 1)) as int) as levels from orders")
def physical_size(spark, d):
    """Sizes in world units, where an unknown resolution counts as one, and in tiles; and how many levels such a size has."""
    o = V.table(spark, d, "orders")
    mpp = F.coalesce(F.nullif(F.col("o_orderkey") % 3, F.lit(0)) * 0.25, F.lit(1.0))
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * mpp, 4).alias("width_um"), F.ceil(F.col("o_orderkey") / 16.0).alias("width_tiles"), F.ceil(F.log2(F.col("o_orderkey") + 1)).cast("int").alias("levels"))


@query(V.sql("ann", "grp", then="select g.grp, g.hidden, coalesce(n, 0) as n_active from grp g left join (select grp, count(*) as n from ann where status = 'O' group by grp) a using (grp) where not hidden"))
def annotation_template(spark, d):
    """Groups that are shown, with what is active in them, as a template for other sets."""
    active = V.annotations(spark, d).filter("status = 'O'").groupBy("grp").agg(F.count("*").alias("n"))
    return V.groups(spark, d).filter("not hidden").join(active, "grp", "left").select("grp", "hidden", F.coalesce("n", F.lit(0)).alias("n_active"))


@query(V.sql("vtx", then="select ann_id, ord, exists_before from (select ann_id, ord, coalesce(x = lag(x) over w and abs(y - lag(y) over w) < 0.01, false) as exists_before from vtx window w as (partition by ann_id order by ord))"))
def near_duplicate_vertices(spark, d):
    w = W.partitionBy("ann_id").orderBy("ord")
    same = (F.col("x") == F.lag("x").over(w)) & (F.abs(F.col("y") - F.lag("y").over(w)) < 0.01)
    return V.vertices(spark, d).select("ann_id", "ord", F.coalesce(same, F.lit(False)).alias("exists_before"))


@query(V.sql("vtx", "box", then="select cast(floor(x0 / 10) as bigint) as strip, count(*) as n, round(sum((x1 - x0) * (y1 - y0)) * 1e-6, 9) as total from box group by 1"))
def selection_totals(spark, d):
    """Counts and total areas in square millimetres of what lies in each strip."""
    b = rings.bounds(V.vertices(spark, d), "ann_id")
    return b.groupBy(F.floor(F.col("x0") / 10).alias("strip")).agg(F.count("*").alias("n"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) * 1e-6, 9).alias("total"))


@query(V.sql("patch", then="select vec_id, len(px) + 36 as n, round(list_sum(px) + 36 * 0.5, 6) as total, round(list_sum(list_slice(px, 10, 15)) / 6, 6) as crop from patch"))
def pad_and_crop(spark, d):
    """A patch in a border of constant value to ten by ten, and the mean of a crop of one row."""
    p = V.patches(spark, d)
    row = lambda y: F.concat(F.array(F.lit(0.5)), F.slice("px", y * 8 + 1, 8), F.array(F.lit(0.5)))
    edge = F.array_repeat(F.lit(0.5), 10)
    padded = F.concat(edge, *[row(y) for y in range(8)], edge)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    crop = F.array(*[X.at(F.col("px"), F.lit(x), F.lit(1), 8) for x in range(1, 7)])
    return p.select("vec_id", F.size(padded).cast("long").alias("n"), F.round(add(padded), 6).alias("total"), F.round(add(crop) / 6, 6).alias("crop"))
