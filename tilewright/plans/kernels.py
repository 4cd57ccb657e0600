"""Queries over pixels in whole numbers, regions across tiles, and the chain of image registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import pixels as X
from tilewright.operators import regions, registration
from tilewright.plans import views as V
from tilewright.plans.registry import query

R4 = lambda c: F.round(c, 4)
#: Patches as bytes.
_BYTES = "byte as (select vec_id, list_transform(px, lambda v: greatest(0, least(255, floor(v * 200)))::bigint) as px from patch)"


def _bytes(spark, d):
    return V.patches(spark, d).select("vec_id", F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 200)))).alias("px"))


@query(V.sql("patch", then=", " + _BYTES + " select vec_id, i, (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10] + 2) >> 2 as v from byte, range(16) t(i)"))
def box_means(spark, d):
    """Means of two by two bytes, halves upwards."""
    return _bytes(spark, d).select("vec_id", F.posexplode(X.shrunk_bytes(F.col("px"), 8, 8)).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), "v")


@query(V.sql("patch", then=", " + _BYTES + " select vec_id, (px[1] << 24) | (px[2] << 16) | (px[3] << 8) | px[4] as packed, (px[3] << 24) | (px[2] << 16) | (px[1] << 8) | px[4] as swizzled, px[3] as first from byte"))
def swizzled_pixels(spark, d):
    """Red and blue of packed pixels changed places."""
    p = _bytes(spark, d).select("vec_id", X.packed(*[F.element_at("px", k) for k in (1, 2, 3, 4)]).alias("packed"))
    s = p.withColumn("swizzled", X.swizzled(F.col("packed")))
    return s.withColumn("first", F.shiftrightunsigned("swizzled", 24))


_SINC = "case when abs(t) >= 3 then 0 when t = 0 then 1 else sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) end"
_LANCZOS = f"""c as (select o, greatest(0, trunc(centre - support + 0.5))::int as low, least(8, trunc(centre + support + 0.5))::int as high, centre, scale from (select o, 1.0 + (o + 0.5) * 1.5 as centre, 1.5 as scale, 4.5 as support from range(4) t(o))),
w as (select o, i, {_SINC} as w from (select o, low + i as i, (low + i - centre + 0.5) / scale as t from c, range(8) r(i) where low + i < high)),
k as (select o, i, trunc(w / sum(w) over (partition by o) * 4194304 + case when w / sum(w) over (partition by o) < 0 then -0.5 else 0.5 end)::bigint as k from w),
flat as (select vec_id, i % 8 as x, i // 8 as y, px[i + 1] as v from byte, range(64) t(i)),
across as (select vec_id, y, o as x, greatest(0, least(255, (sum(v * k)::bigint + 2097152) >> 22)) as v from flat join k on x = i group by vec_id, y, o)"""


@query(V.sql("patch", then=", " + _BYTES + ", " + _LANCZOS + " select vec_id, list(v order by y, x) as px from (select vec_id, x, o as y, greatest(0, least(255, (sum(v * k)::bigint + 2097152) >> 22)) as v from across join k on y = i group by vec_id, x, o) group by vec_id"))
def lanczos_bytes(spark, d):
    """A box of each patch (one to seven in both directions) at four by four, by two passes of weights of 22 bits, rounded and clipped after each."""
    return _bytes(spark, d).select("vec_id", X.lanczos_bytes(F.col("px"), 8, 8, (1.0, 1.0, 7.0, 7.0), 4, 4).alias("px"))


@query(V.sql("patch", then=", rgb as (select vec_id, i, least(1.0, greatest(0.0, px[3 * i + 1])) as r, least(1.0, greatest(0.0, px[3 * i + 2])) as g, least(1.0, greatest(0.0, px[3 * i + 3])) as b from patch, range(21) t(i)), m as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as span from rgb), h as (select *, case when span = 0 then 0 when hi = r then (g - b) / span when hi = g then (b - r) / span + 2 else (r - g) / span + 4 end as s from m), q as (select *, 60 * case when s < 0 then s + 6 else s end as hue, power(0.9 - r, 2) + power(0.8 - g, 2) + power(0.7 - b, 2) as far from h) select vec_id, i, round(case when hue > 90 and hue < 235 then (r / 4 + g / 2 + b / 4) else 0.75 end, 4) as signal, round(o, 4) as opacity, round(o * (r - 0.1) / 0.8 + (1 - o) * 0.5, 4) as shown from (select *, case when far < 0.5 then greatest(0.0, far / 0.5 * 1.2 - 0.2) else 1.0 end as o from q)"))
def display_filters(spark, d):
    """The signal of a stain by hue over a background value, and colours that are transparent near a stated one, with black and white levels, over a background."""
    from tilewright.plans.raster import _rgb

    p = _rgb(spark, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hue, _, _ = X.hsv(r, g, b)
    opacity = X.opacity(r, g, b, (0.9, 0.8, 0.7), 0.5)
    return p.select("vec_id", "i", R4(X.stain_signal(hue, X.luminance(r, g, b), 0.75)).alias("signal"), R4(opacity).alias("opacity"), R4(X.over(X.stretched(r, 0.1, 0.9), opacity, 0.5)).alias("shown"))


@query(V.sql("patch", "req", then=", " + _BYTES + """, reg as (select event_id as region_id, event_id * 7 % 130 - 5 as x0, event_id * 3 % 50 - 4 as y0 from req where event_id % 50 = 0), pix as (select region_id, i, x0 + i % 12 as x, y0 + i // 12 as y from reg, range(120) t(i)),
val as (select region_id, i, case when x >= 0 and y >= 0 and x < 125 and y < 4000000 then px[(y % 8) * 8 + x % 8 + 1] end as v from pix left join byte on vec_id = (y // 8) * 16 + x // 8 and x >= 0 and y >= 0 and x < 128)
select region_id, list(coalesce(v, 255) order by i) as values from val group by region_id"""))
def pixel_regions(spark, d):
    """Regions of twelve by ten pixels of a level of tiles, row by row; white where no tile is stored, and beyond the image's edge, which the last tiles reach over."""
    tiles = _bytes(spark, d).select((F.col("vec_id") % 16).alias("tile_x"), F.floor(F.col("vec_id") / 16).alias("tile_y"), "px")
    r = V.requests(spark, d).filter("event_id % 50 = 0").selectExpr("event_id as region_id", "event_id * 7 % 130 - 5 as x", "event_id * 3 % 50 - 4 as y", "12L as width", "10L as height")
    return regions.pixels(r, tiles, 8, 125, 4_000_000, 255)


@query(V.sql("patch", then=", " + _BYTES + """, flat as (select vec_id, vec_id % 16 * 8 + i % 8 as x, vec_id // 16 * 8 + i // 8 as y, px[i + 1] as v from byte, range(64) t(i)),
l1 as (select x // 2 as x, y // 2 as y, (sum(v)::bigint + 2) >> 2 as v from flat where x >= 4 and x < 120 and y >= 8 group by 1, 2), l2 as (select x // 2 as x, y // 2 as y, (sum(v)::bigint + 2) >> 2 as v from l1 group by 1, 2)
select level, x // 8 as tile_x, y // 8 as tile_y, count(*) as n, sum(v)::bigint as total from (select 0 as level, x, y, v from flat where x >= 4 and x < 120 and y >= 8 union all select 1, x, y, v from l1 union all select 2, x, y, v from l2) group by all"""))
def cropped_pyramid(spark, d):
    """A cropped area as a pyramid of three levels in tiles, each level from the one below it, written by level and read again."""
    import uuid

    from tilewright.session import shared_dir

    path = f"{shared_dir(spark)}/pyramid-{uuid.uuid4().hex}"
    tiles = _bytes(spark, d).select((F.col("vec_id") % 16).alias("tile_x"), F.floor(F.col("vec_id") / 16).alias("tile_y"), "px")
    regions.write_pyramid(tiles, path, 8, (4, 8, 120, 1 << 40), 3)
    t = spark.read.parquet(path)
    known = F.filter("px", lambda v: v.isNotNull())
    return t.select(F.col("level").cast("int"), "tile_x", "tile_y", F.size(known).cast("long").alias("n"), F.aggregate(known, F.lit(0).cast("long"), lambda s, v: s + v).alias("total")).filter("n > 0")


@query(V.sql("patch", then=", " + _BYTES + """, s as (select vec_id, list_reduce([{'h': 0::bigint, 'hx': 0, 'hy': 0, 's': 0::bigint, 'sx': 0, 'sy': 0}] || list_transform(range(64), lambda i: {'h': px[i + 1], 'hx': (i % 8)::int, 'hy': (i // 8)::int, 's': 0::bigint, 'sx': 0, 'sy': 0}),
lambda a, v: case when v.h > a.h then {'h': v.h, 'hx': v.hx, 'hy': v.hy, 's': case when abs(a.hx - v.hx) + abs(a.hy - v.hy) > 4 then a.h else a.s end, 'sx': case when abs(a.hx - v.hx) + abs(a.hy - v.hy) > 4 then a.hx else a.sx end, 'sy': case when abs(a.hx - v.hx) + abs(a.hy - v.hy) > 4 then a.hy else a.sy end}
when v.h > a.s and abs(a.hx - v.hx) + abs(a.hy - v.hy) > 4 then {'h': a.h, 'hx': a.hx, 'hy': a.hy, 's': v.h, 'sx': v.hx, 'sy': v.hy} else a end) as p from byte) select vec_id, p.h as highest, p.hx as x, p.hy as y, p.s as second, p.sx as second_x, p.sy as second_y from s"""))
def two_peaks(spark, d):
    """The highest value, and the second highest that was seen more than four steps away from the highest so far, in the order of the scan."""
    return _bytes(spark, d).select("vec_id", X.two_peaks(F.col("px"), 8).alias("p")).select("vec_id", "p.*")


@query("select vec_id as pair_id, case when vec_id % 7 < 6 then round(-(vec_id % 4)::int * 0.5::double, 6) end as x_um, case when vec_id % 7 < 6 then round(-(vec_id % 3)::int * 0.25::double, 6) end as y_um from embeddings")
def registered_pairs(spark, d):
    """How far the second image of each pair lies from the first, in micrometres; null where a patch isn't there or its shift is over the limit."""
    p = V.patches(spark, d)
    dy, dx = (F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 4).cast("int")
    rolled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: X.at(F.col("px"), F.pmod(i % 8 - dx, F.lit(8)), F.pmod(F.floor(i / 8) - dy, F.lit(8)), 8))
    pairs = p.select(F.col("vec_id").alias("pair_id"), F.col("px").alias("a"), F.when(F.col("vec_id") % 7 < 6, rolled).alias("b"), F.lit(0.5).alias("mpp_x"), F.lit(0.25).alias("mpp_y"))
    found = registration.register_physical(pairs, 8, 8, limit=4)
    return found.select("pair_id", F.round("x_um", 6).alias("x_um"), F.round("y_um", 6).alias("y_um"))


@query("select vec_id as pair_id, 0.0::double as x_um, 0.0::double as y_um from embeddings")
def thumbnail_registration(spark, d):
    """Pairs of images of different resolution, brought to one by bilinear thumbnails, and registered."""
    p = V.patches(spark, d)
    half = X.shrunk(F.col("px"), 8, 8)
    pairs = p.select(F.col("vec_id").alias("pair_id"), X.bilinear(F.col("px"), 8, 8, 4, 4).alias("a"), half.alias("b"), F.lit(0.5).alias("mpp_x"), F.lit(0.5).alias("mpp_y"))
    return registration.register_physical(pairs, 4, 4, limit=2).select("pair_id", "x_um", "y_um")


@query(V.sql("patch", then=", c as (select vec_id, i // 8 as y, i % 8 as x, floor(px[i + 1] * 100)::bigint as c from patch, range(64) t(i)), "
+ ", ".join(f"""{out}e as (select a.vec_id, a.{o}, a.{i} * 2 as {i}, a.c - cast(floor((coalesce(p.c, q.c) + q.c + 2) / 4) as bigint) as c from {src} a left join {src} p on p.vec_id = a.vec_id and p.{o} = a.{o} and p.{i} = a.{i} + 3 and a.{i} > 0 join {src} q on q.vec_id = a.vec_id and q.{o} = a.{o} and q.{i} = a.{i} + 4 where a.{i} < 4),
{out} as (select vec_id, {o}, {i}, c from {out}e union all select s.vec_id, s.{o}, (s.{i} - 4) * 2 + 1, s.c + cast(floor((l.c + coalesce(r.c, l.c)) / 2) as bigint) from {src} s join {out}e l on l.vec_id = s.vec_id and l.{o} = s.{o} and l.{i} = (s.{i} - 4) * 2 left join {out}e r on r.vec_id = s.vec_id and r.{o} = s.{o} and r.{i} = (s.{i} - 4) * 2 + 2 where s.{i} >= 4)""" for out, src, o, i in (("h", "c", "y", "x"), ("v", "h", "x", "y")))
+ " select vec_id, list(c order by y, x) as px from v group by vec_id"))
def inverse_wavelet(spark, d):
    """Whole patches of wavelet coefficients, rows first and then columns, back to samples by integer lifting with mirrored edges."""
    p = V.patches(spark, d).select("vec_id", F.transform("px", lambda v: F.floor(v * 100)).alias("px"))
    return registration.inverse_wavelet(p, 8, 8)
