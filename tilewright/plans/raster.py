"""Queries over pixel patches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import pixels as X
from tilewright.operators import registration, rings
from tilewright.plans import views as V
from tilewright.plans.registry import query

R4 = lambda c: F.round(c, 4)
_RGB = "rgb as (select vec_id, i, least(1.0, greatest(0.0, px[3 * i + 1])) as r, least(1.0, greatest(0.0, px[3 * i + 2])) as g, least(1.0, greatest(0.0, px[3 * i + 3])) as b from patch, range(21) t(i))"


def _rgb(spark, d):
    """Every three values of a patch as one pixel, clamped to 0..1."""
    p = V.patches(spark, d).select("vec_id", "px", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    clamp = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.element_at("px", F.col("i") * 3 + k)))
    return p.select("vec_id", "i", clamp(1).alias("r"), clamp(2).alias("g"), clamp(3).alias("b"))


@query(V.sql("patch", then=", " + _RGB + " select vec_id, i, round(r / 4 + g / 2 + b / 4, 4) as luma, round(1 - r, 4) as inverted, round(least(1.0, greatest(0.0, (g - 0.2) / 0.8) / 0.7), 4) as leveled, round(b * 0.75 + r * 0.25, 4) as mixed from rgb").replace(") , rgb", "), rgb"))
def colour_channels(spark, d):
    p = _rgb(spark, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select("vec_id", "i", R4(X.luminance(r, g, b)).alias("luma"), R4(1 - r).alias("inverted"), R4(X.levels(g, 0.2, 0.7)).alias("leveled"), R4(b * 0.75 + r * 0.25).alias("mixed"))


@query(V.sql("patch", then=", " + _RGB + """, m as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as span from rgb), h as (select *, case when span = 0 then 0 when hi = r then (g - b) / span when hi = g then (b - r) / span + 2 else (r - g) / span + 4 end as s from m)
select vec_id, i, round(case when s < 0 then s + 6 else s end * 60, 4) as h, round(case when hi = 0 then 0 else span / hi * 100 end, 4) as s, round(hi * 100, 4) as v, case when s < 0 then s + 6 else s end * 60 > 90 and case when s < 0 then s + 6 else s end * 60 < 235 as blue from h""").replace(") , rgb", "), rgb"))
def hue_saturation(spark, d):
    h, s, v = X.hsv(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, d).select("vec_id", "i", R4(h).alias("h"), R4(s).alias("s"), R4(v).alias("v"), ((h > 90) & (h < 235)).alias("blue"))


@query(V.sql("patch", then="select vec_id, i, round((px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4, 6) as v from patch, range(16) t(i)"))
def shrink_2x2(spark, d):
    s = V.patches(spark, d).select("vec_id", F.posexplode(X.shrunk(F.col("px"), 8, 8)).alias("i", "v"))
    return s.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(V.sql("patch", then=", p as (select vec_id, i % 8 as x, i // 8 as y, px[i + 1] as v from patch, range(64) t(i)) select vec_id, level, x // (1 << level) as x, y // (1 << level) as y, round(avg(v), 6) as v from p, range(1, 4) l(level) group by all").replace(") , p", "), p"))
def pyramid_means(spark, d):
    """Every level of a patch's pyramid from the level below it."""
    p = V.patches(spark, d).select("vec_id", F.posexplode("px").alias("i", "v")).select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "v")
    out = None
    for level in (1, 2, 3):
        p = p.groupBy("vec_id", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.avg("v").alias("v"))
        rows = p.select("vec_id", F.lit(level).cast("long").alias("level"), "x", "y", F.round("v", 6).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(V.sql("patch", then=", t as (select vec_id, i, greatest(0, least(7, floor(((i % 4) + 0.5) * 2 - 0.5)))::int as x, greatest(0, least(7, floor((i // 4 + 0.5) * 2 - 0.5)))::int as y, px from patch, range(16) t(i)) select vec_id, i, round((px[y * 8 + x + 1] + px[y * 8 + x + 2] + px[y * 8 + x + 9] + px[y * 8 + x + 10]) / 4, 6) as v from t").replace(") , t", "), t"))
def bilinear_resize(spark, d):
    s = V.patches(spark, d).select("vec_id", F.posexplode(X.bilinear(F.col("px"), 8, 8, 4, 4)).alias("i", "v"))
    return s.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(V.sql("patch", then=", v as (select vec_id, i, cast(floor(px[i + 1] * 1000) as bigint) as d from patch, range(64) t(i)) select vec_id, i, ((sum(d) over (partition by vec_id, i // 8 order by i) % 256 + 256) % 256)::bigint as v from v").replace(") , v", "), v"))
def predictor_inverse(spark, d):
    """Each row of differences summed up modulo 256."""
    rows = V.patches(spark, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"), "px")
    one = F.transform(F.slice("px", F.col("row") * 8 + 1, F.lit(8)), lambda v: F.floor(v * 1000))
    s = rows.select("vec_id", "row", F.posexplode(X.running_bytes(one)).alias("k", "v"))
    return s.select("vec_id", (F.col("row") * 8 + F.col("k")).cast("long").alias("i"), "v")


@query(V.sql("patch", then="select vec_id, list_position(px, list_max(px))::int - 1 as peak, round(list_max(px), 6) as height, len(list_filter(px, lambda p: p > 0.5))::bigint as n_bright from patch"))
def argmax_peak(spark, d):
    return V.patches(spark, d).select("vec_id", (F.array_position("px", F.array_max("px")) - 1).cast("int").alias("peak"), F.round(F.array_max("px"), 6).alias("height"), F.size(F.filter("px", lambda p: p > 0.5)).cast("long").alias("n_bright"))


@query("select p_partkey, least(b + co, 255) as r, least(cg + low, 255) as g, least(b, 255) as b from (select *, low - trunc(co / 2)::bigint as b from (select *, y - trunc(cg / 2)::bigint as low from (select p_partkey, p_partkey % 256 as y, p_size - 25 as co, (p_partkey * 3) % 101 - 50 as cg from part)))")
def ycocg_rgb(spark, d):
    p = V.table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 256 as y", "p_size - 25 as co", "(p_partkey * 3) % 101 - 50 as cg")
    r, g, b = X.ycocg_to_rgb(F.col("y"), F.col("co"), F.col("cg"))
    return p.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("select vec_id, -((vec_id % 5)::int) as dy, -((vec_id % 3)::int) as dx from embeddings")
def phase_correlation(spark, d):
    """How far each patch is shifted against a copy of it that was rolled by known rows and columns."""
    p = V.patches(spark, d)
    dy, dx = (F.col("vec_id") % 5).cast("int"), (F.col("vec_id") % 3).cast("int")
    rolled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: X.at(F.col("px"), F.pmod(i % 8 - dx, F.lit(8)), F.pmod(F.floor(i / 8) - dy, F.lit(8)), 8))
    found = registration.register_pairs(p.select(F.col("vec_id").alias("pair_id"), F.col("px").alias("a"), rolled.alias("b")), 8, 8)
    wrap = lambda c: F.when(F.col(c) > 0, F.col(c) - 8).otherwise(F.col(c))  # noqa: E731  a shift of half the size or more comes out on the other side
    return found.select(F.col("pair_id").alias("vec_id"), wrap("dy").alias("dy"), wrap("dx").alias("dx"))


@query(V.sql("patch", then=""", c as (select o, (o + 0.5) * 1.6 as centre from range(5) t(o)), w as (select o, i, case when abs(t) >= 3 then 0 when t = 0 then 1 else sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) end as w from (select o, i, (i + 0.5 - centre) / 1.6 as t from c, range(8) r(i))),
k as (select o, i, w / sum(w) over (partition by o) as k from w), flat as (select vec_id, i % 8 as x, i // 8 as y, px[i + 1] * 100 as v from patch, range(64) t(i)), across as (select vec_id, y, o as x, sum(v * k) as v from flat join k on x = i group by vec_id, y, o)
select vec_id as id, o * 5 + x as i, round(greatest(0, least(255, sum(v * k))), 4) as v from across join k on y = i group by vec_id, x, o"""))
def lanczos_resample(spark, d):
    """Patches at five by five, by weights of both directions."""
    p = V.patches(spark, d).select(F.col("vec_id").alias("id"), F.transform("px", lambda v: v * 100).alias("px"))
    return registration.resample(p, 8, 8, 5, 5).select("id", F.posexplode("px").alias("i", "v")).select("id", F.col("i").cast("long").alias("i"), F.round("v", 4).alias("v"))


_STAR = "m as (select ann_id, ord, x, y, n, x - avg(x) over (partition by ann_id) as dx, y - avg(y) over (partition by ann_id) as dy from vtx), a as (select ann_id, n, x, y, row_number() over (partition by ann_id order by round(atan2(dy, dx), 9), ord) as ord from m where n >= 3), e as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from a window w as (partition by ann_id order by ord rows between unbounded preceding and unbounded following))"


@query(V.sql("vtx", then=", " + _STAR + " select ann_id, any_value(n) - 2 as n, round(sum(x * ny - y * nx) * 100000)::bigint as area from e group by ann_id"))
def star_triangulation(spark, d):
    """Outlines whose vertices are put in order around their middle have two triangles less than vertices, of the outline's area in all (doubled, in hundred-thousandths)."""
    v = V.vertices(spark, d).filter("n >= 3")
    own = W.partitionBy("ann_id")
    v = v.withColumns({"mx": F.avg("x").over(own), "my": F.avg("y").over(own)}).withColumn("angle", F.round(F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")), 9))
    around = v.groupBy("ann_id").agg(F.sort_array(F.collect_list(F.struct("angle", "ord", "x", "y"))).alias("p")).select("ann_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return _triangles(around, 200_000)


def _triangles(outlines, units=None):
    t = registration.triangulate(outlines).select("ann_id", "ring", F.explode("triangles").alias("t"))
    corner = lambda k: F.element_at("ring", F.element_at("t", k) + 1)
    a, b, c = corner(1), corner(2), corner(3)
    area = F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) / 2
    total = F.round(F.sum(area), 4) if units is None else F.round(F.sum(area) * units).cast("long")
    return t.groupBy("ann_id").agg(F.count("*").alias("n"), total.alias("area"))


@query()
def triangulation(spark, d):
    """Triangles of all outlines, and the sum of their areas."""
    r = rings.rings(V.vertices(spark, d))
    return _triangles(r)
