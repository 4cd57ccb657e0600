"""Queries over small conversions of metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import rings
from tilewright.plans import views as V
from tilewright.plans.registry import query


@query("select c_custkey, coalesce(n_regionkey * 40 + n_nationkey, 0) as colour from customer left join nation on n_nationkey = (c_custkey * 3) % 40")
def palette_lookup(spark, d):
    """Indexes looked up in a small table; one out of range gives 0. The table of nations is small by its nature; Spark checks its size before it broadcasts."""
    lut = V.table(spark, d, "nation").select((F.col("n_nationkey")).cast("long").alias("i"), (F.col("n_regionkey") * 40 + F.col("n_nationkey")).alias("v"))
    return V.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 3 % 40).alias("i")).join(lut, "i", "left").select("c_custkey", F.coalesce("v", F.lit(0)).alias("colour"))


@query("select event_id, hour(ts)::int as hour, case when event_id % 3 > 0 then minute(ts)::int end as minute, case when event_id % 3 = 2 then second(ts)::int end as second from events")
def dicom_times(spark, d):
    """HH, HHMM or HHMMSS.ffffff to parts; what isn't there is null."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "HH")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "HHmm")).otherwise(F.date_format(ts, "HHmmss.SSSSSS"))
    part = lambda a: F.nullif(F.substring("t", a, 2), F.lit("")).cast("int")
    return V.table(spark, d, "events").select("event_id", text.alias("t")).select("event_id", part(1).alias("hour"), part(3).alias("minute"), part(5).alias("second"))


@query("select p_partkey, p_size as tile, round(p_retailprice / 1000, 6) as mpp, 3 as n_levels, 4.0::double as last from part")
def slide_metadata(spark, d):
    """Replies of two shapes (members in camel case under metadata, or in Pascal case at the top) as one row of columns."""
    p = V.table(spark, d, "part")
    camel = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.col("p_size").alias("osdTileSize"), (F.col("p_retailprice") / 1000).alias("mppX"), F.array(*map(F.lit, (1.0, 2.0, 4.0))).alias("downsamples")).alias("metadata")))
    pascal = F.to_json(F.struct(F.col("p_size").alias("OsdTileSize"), (F.col("p_retailprice") / 1000).alias("MppX"), F.array(*map(F.lit, (1.0, 2.0, 4.0))).alias("Downsamples")))
    v = p.select("p_partkey", F.try_parse_json(F.when(F.col("p_partkey") % 2 == 0, camel).otherwise(pascal)).alias("v"))
    get = lambda name, kind: F.coalesce(F.try_variant_get("v", f"$.metadata.{name}", kind), F.try_variant_get("v", f"$.{name[0].upper()}{name[1:]}", kind))
    levels = F.slice(get("downsamples", "array<double>"), 1, 32)
    return v.select("p_partkey", get("osdTileSize", "int").alias("tile"), F.round(get("mppX", "double"), 6).alias("mpp"), F.size(levels).alias("n_levels"), F.element_at(levels, -1).alias("last"))


@query("select l_orderkey, l_linenumber, l_partkey, (3 << (l_linenumber % 8)) - 2 as padding, ((3 << (l_linenumber % 8)) - 3) >> (l_linenumber % 3) as origin, (3 << (l_linenumber % 8)) - 2 + (1 << (l_linenumber % 8)) as low_padding from lineitem")
def level_padding(spark, d):
    """How far each level's pixels are padded, and a region's origin is shifted."""
    three = F.expr("shiftleft(3, l_linenumber % 8)")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (three - 2).alias("padding"), F.expr("shiftright(shiftleft(3, l_linenumber % 8) - 3, l_linenumber % 3)").alias("origin"), (three - 2 + F.expr("shiftleft(1, l_linenumber % 8)")).alias("low_padding"))


@query("select p_partkey, round(10000.0 / (p_retailprice * 1000 / (1 + p_size)), 6) as mpp, round(p_size * 512 * coalesce(nullif(p_size % 4, 0), 1) * 0.25, 4) as tile_um from part")
def resolution_override(spark, d):
    """Resolutions from rational pixels per centimetre, and tile sides under an overriding one."""
    p = V.table(spark, d, "part")
    ratio = F.struct((F.col("p_retailprice") * 1000).alias("num"), (1 + F.col("p_size")).alias("den"))
    unit = F.coalesce(F.nullif(F.col("p_size") % 4, F.lit(0)), F.lit(1)) * 0.25
    return p.select("p_partkey", ratio.alias("r"), (F.col("p_size") * 512 * unit).alias("t")).select("p_partkey", F.round(10000.0 / (F.col("r.num") / F.col("r.den")), 6).alias("mpp"), F.round("t", 4).alias("tile_um"))


@query("select p_partkey, left(p_name, 7) as name, length(p_name) > 7 as cut, case when length(p_name) % 2 = 0 then regexp_replace(p_name, ' $', '') else p_name end as even from part")
def bounded_names(spark, d):
    """Names in a buffer of eight characters with its end mark; and without the space that makes a length even."""
    name = F.col("p_name")
    return V.table(spark, d, "part").select("p_partkey", F.left(name, F.lit(7)).alias("name"), (F.length(name) > 7).alias("cut"), F.when(F.length(name) % 2 == 0, F.regexp_replace(name, " $", "")).otherwise(name).alias("even"))


@query(V.sql("vtx", then="select ann_id, sqrt(power(max(x) filter (ord = 1) - max(x) filter (ord = n), 2) + power(max(y) filter (ord = 1) - max(y) filter (ord = n), 2)) / 0.5 < 20 as closable from vtx group by ann_id"))
def endpoint_proximity(spark, d):
    """Whether the ends of an open line are under twenty screen pixels apart."""
    r = rings.rings(V.vertices(spark, d))
    a, b = F.element_at("ring", 1), F.element_at("ring", -1)
    return r.select("ann_id", (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / 0.5 < 20).alias("closable"))


@query("select c_custkey, coalesce(s_name, 'UN') as keyword from customer left join supplier on s_suppkey = c_custkey % 150")
def dictionary_lookup(spark, d):
    """Tags looked up in a dictionary; an unknown one is UN."""
    known = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tag"), "s_name")
    return V.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 150).alias("tag")).join(known, "tag", "left").select("c_custkey", F.coalesce("s_name", F.lit("UN")).alias("keyword"))


@query(V.sql("req", then="select viewer, event_id, ((cast(floor(cam_x) as bigint) & 255) << 16) | ((zoom & 255) << 8) | 255 as packed, cast(floor(cam_x) as bigint) & 255 as red from req"))
def packed_colours(spark, d):
    """Channels packed into one integer and taken out again."""
    red = F.floor("cam_x").bitwiseAND(F.lit(255))
    packed = F.shiftleft(red, 16).bitwiseOR(F.shiftleft(F.col("zoom").cast("long").bitwiseAND(F.lit(255)), 8)).bitwiseOR(F.lit(255))
    return V.requests(spark, d).select("viewer", "event_id", packed.alias("packed")).select("viewer", "event_id", "packed", F.shiftright("packed", 16).bitwiseAND(F.lit(255)).alias("red"))
