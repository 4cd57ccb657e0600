"""Queries that write annotations in a file format and read them back, and streams that run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.operators import rings
from tilewright.plans import views as V
from tilewright.plans.registry import query
from tilewright.session import shared_dir, spread
from tilewright.sources import annotations as A
from tilewright.sources import dicom, files, ini, tiff
from tilewright.streaming import requests as S


def _folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _documents(spark, d):
    r = rings.rings(V.vertices(spark, d)).join(V.annotations(spark, d), "ann_id")
    kind = F.when(F.size("ring") == 1, "Point").when(F.size("ring") == 2, "LineString").otherwise("Polygon")
    return r.select("ann_id", F.concat(F.lit('A "'), F.col("ann_id").cast("string"), F.lit('"')).alias("name"), "grp", kind.alias("type"), "ring", F.lit("#00ff00").alias("colour"))


_SAME = V.sql("vtx", "ann", "edge", then="select ann_id, 'A \"' || ann_id || '\"' as name, grp, n, round(sum(x * ny - y * nx) / 2, 6) as area from edge join ann using (ann_id) group by all")


@query(_SAME)
def geojson_round_trip(spark, d):
    path = _folder(spark, "geojson")
    A.write_geojson(_documents(spark, d), path, 0.25, 0.5)
    back = A.read_geojson(spark, path, 0.25, 0.5)
    return back.select("ann_id", "name", "grp", F.size("ring").cast("long").alias("n"), F.round(rings.ring_area(F.col("ring")), 6).alias("area"))


@query(_SAME)
def xml_round_trip(spark, d):
    path = _folder(spark, "xml")
    A.write_xml(_documents(spark, d), path, 0.25, 0.5)
    back = A.read_xml(spark, path, 0.25, 0.5)
    return back.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("ann_id"), "name", "grp", F.size("ring").cast("long").alias("n"), F.round(rings.ring_area(F.col("ring")), 6).alias("area"))


_COLLECTIONS = V.sql("vtx", "edge", then=""", a as (select ann_id, any_value(n) as n, sum(x * ny - y * nx) / 2 as area from edge group by ann_id), k as (select *, unnest(range(case ann_id % 8 when 1 then n when 3 then 2 when 5 then 2 when 6 then 3 else 1 end)) as part from a),
t as (select *, case when ann_id % 8 in (0, 1) or ann_id % 8 = 6 and part = 0 then 'Point' when ann_id % 8 in (2, 3) or ann_id % 8 = 6 then case when n >= 2 then 'LineString' end when ann_id % 8 in (4, 5) then case when n >= 3 then 'Polygon' end end as type from k)
select ann_id, type, count(*) as parts, sum(case when type = 'Point' then 1 else n end)::bigint as points, round(sum(case when type = 'Point' then 0 else area end), 6) as area, case when ann_id % 2 = 0 then 'named' else 'text' end as grp, case when ann_id % 2 = 0 then '#ff0a10' end as colour from t where type is not null group by ann_id, type""")


@query(_COLLECTIONS)
def geojson_collections(spark, d):
    """Whole collections of features of all seven kinds of geometry, with members that are none, written and read again."""
    return _summed(A.read_geojson(spark, _collections(spark, d), 0.25, 0.5))


@query(_COLLECTIONS)
def geojson_ranges(spark, d):
    """The same collections by ranges of 64 KB: members that begin in one range and end in another, and ranges that begin inside strings and members."""
    return _summed(A.read_geojson(spark, _collections(spark, d), 0.25, 0.5, range_bytes=1 << 16))


def _collections(spark, d):
    """A folder of collections."""
    path = _folder(spark, "collections")
    r = rings.rings(V.vertices(spark, d))
    xy = F.transform("ring", lambda p: F.array(p["x"] / 0.25, p["y"] / 0.5))
    closed = F.concat(xy, F.slice(xy, 1, 1))
    geometry = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    collection = lambda *g: F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.concat_ws(",", *g), F.lit("]}"))
    point, line = geometry("Point", F.element_at(xy, 1)), geometry("LineString", xy)
    kinds = [point, geometry("MultiPoint", xy), line, geometry("MultiLineString", F.array(xy, F.reverse(F.reverse(xy)))), geometry("Polygon", F.array(closed, closed)), geometry("MultiPolygon", F.array(F.array(closed), F.array(closed))), collection(point, collection(line, line)), F.lit('{"type":"Circle","coordinates":[1,2]}')]
    shape = F.element_at(F.array(*kinds), (F.col("ann_id") % 8 + 1).cast("int"))
    named = F.when(F.col("ann_id") % 2 == 0, '{"name":"named","color":[300,10.7,16,9]}').otherwise('"text"')
    feature = F.concat(F.lit('\n { "type" : "Feature", "id": '), F.col("ann_id").cast("string"), F.lit(', "geometry": '), shape, F.lit(', "properties": {"classification": '), named, F.lit("}}, 17"))
    r.select(feature.alias("value")).mapInArrow(A._collections, "value string").write.text(path)
    return path


def _summed(back):
    flat = back.filter("type = 'Point'").select("ann_id", "type", "grp", "colour", F.lit(1).alias("n"), F.lit(0.0).alias("a")).union(back.filter("type <> 'Point'").select("ann_id", "type", "grp", "colour", F.size("ring"), rings.ring_area(F.col("ring"))))
    return flat.groupBy("ann_id", "type", "grp", "colour").agg(F.count("*").alias("parts"), F.sum("n").alias("points"), F.round(F.sum("a"), 6).alias("area"))


@query("select sum(case when o_orderkey % 4 = 0 then 1 else 0 end)::bigint as imported, sum(case when o_orderkey % 4 = 0 then 0 else 1 end)::bigint as skipped, bool_or(o_orderkey % 4 = 0) as success from orders")
def geojson_import_counts(spark, d):
    """How many members of collections were read, and how many skipped: no feature, no geometry, too few points."""
    path = _folder(spark, "members")
    kinds = ['{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2,3]}}', '{"type":"Point","coordinates":[1,2]}', '{"type":"Feature","geometry":null}', '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],["a",null]]}}']
    V.table(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("value")).mapInArrow(A._collections, "value string").write.text(path)
    counts = A.import_counts(A.read_features(spark, path))
    return counts.agg(F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"), F.bool_or("success").alias("success"))


@query("select o_orderpriority as grp, case when o_orderpriority = '1-URGENT' then '#000000' else '#0000' || lpad(to_hex(ascii(o_orderpriority)), 2, '0') end as colour, count(*) as n, round(sum(o_totalprice), 2) as total, count(*) filter (o_orderkey % 3 = 0) as n_flagged, '1-URGENT' as restricted from orders group by 1, 2")
def xml_groups_and_features(spark, d):
    """A set with groups and features, written and read in full; a group that only annotations name is added."""
    path = _folder(spark, "set")
    a = V.annotations(spark, d)
    flagged = F.when(F.col("ann_id") % 3 == 0, F.lit(1.0)).otherwise(0.0)
    docs = a.select(F.col("ann_id").cast("string").alias("name"), "grp", F.lit("Dot").alias("type"), F.lit("#00ff00").alias("colour"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("ring"), F.create_map(F.lit("total"), F.col("f0").cast("double"), F.lit("flag"), flagged).alias("features"))
    code = F.lower(F.lpad(F.hex(F.ascii("grp")), 2, "0"))
    groups = a.filter("grp <> '1-URGENT'").select(F.col("grp").alias("name"), F.concat(F.lit("#0000"), code).alias("colour")).distinct().withColumn("parent", F.lit("None"))
    features = spark.createDataFrame([("total", None), ("flag", "1-URGENT")], "name string, restrict_to_group string")
    A.write_xml_set(docs, groups, features, path)
    back = A.read_xml(spark, path)
    all_groups = A.known_groups(A.read_xml_groups(spark, path), back)
    restricted = A.read_xml_features(spark, path).filter("restrict_to_group is not null").select(F.col("restrict_to_group").alias("restricted"))
    value = lambda k: F.coalesce(F.try_element_at("features", F.lit(k)), F.lit(0.0))
    totals = back.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum(value("total")), 2).alias("total"), F.count_if(value("flag") != 0).alias("n_flagged"))
    rows = totals.join(all_groups.select(F.col("name").alias("grp"), "colour"), "grp").withColumn("one", F.lit(1))
    return rows.join(restricted.withColumn("one", F.lit(1)), "one").drop("one")


@query("select o_orderpriority as section, o_orderkey || ' key' as key, case when o_orderkey % 7 = 0 then 'new' else o_orderstatus end as value, '; a comment of ' || o_orderkey as comment from orders union all select '9-OTHER', 'unseen', 'x', null")
def option_file_rewrite(spark, d):
    """Files of options written again with changed values: comments, order and unlinked options stay, and registered options that no file has are put at the end."""
    path = _folder(spark, "ini")
    o = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("section"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" key")).alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    lines = o.select("section", F.explode(F.array(*[F.struct((F.col("o_orderkey") * 3 + k).alias("place"), t.alias("line")) for k, t in enumerate((F.concat(F.lit("; a comment of "), F.col("o_orderkey").cast("string")), F.concat("key", F.lit("="), "value")))])).alias("l"))
    lines = lines.select("section", "l.place", "l.line")
    registered = o.filter("o_orderkey % 7 = 0").select("section", "key", F.lit("new").alias("value")).union(spark.createDataFrame([("9-OTHER", "unseen", "x")], "section string, key string, value string"))
    ini.write_options(ini.rewritten(lines, registered), path)
    return ini.read_with_comments(spark, path)


@query("select o_orderpriority as section, o_orderkey || ' key' as key, case when o_orderkey % 7 = 0 then 'new' else o_orderstatus end as value from orders")
def option_file_round_trip(spark, d):
    """Options written to files of sections, read back, and merged with registered ones."""
    path = _folder(spark, "ini")
    o = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("section"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" key")).alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    text = F.concat(F.lit("[") , F.col("section"), F.lit("]\n ; a comment\n"), F.col("key"), F.lit(" = "), F.col("value"), F.lit(" ; more"))
    o.select(text.alias("value")).write.text(path)
    registered = o.filter("o_orderkey % 7 = 0").select("section", "key", F.lit("new").alias("value"))
    return ini.merged(ini.read_options(spark, path), registered)


_GENERATION = ", g as (select viewer, event_id, case when lag(cam_x) over v is distinct from cam_x or lag(cam_y) over v is distinct from cam_y or lag(zoom) over v is distinct from zoom then 1 else 0 end as changed, ts from req window v as (partition by viewer order by ts, event_id))"


@query((V.sql("req", then=_GENERATION + " select viewer, event_id, cast(sum(changed) over (partition by viewer order by ts, event_id rows unbounded preceding) as bigint) as generation from g")).replace(") , g", "), g"))
def generation_stream(spark, d):
    """The generation counter as a stream over the event table, run to its end."""
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_linked(spark, d))
    r = events.selectExpr("user_id as viewer", "ts", "event_id", "cast((event_id * 7) % 64 as double) as cam_x", "value / 4.0 as cam_y", "cast(event_id % 5 as int) as zoom")
    path = _folder(spark, "stream")
    S.generations(r).writeStream.format("parquet").option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


def _linked(spark, d):
    """The events as a folder of files, as a stream source needs."""
    path = _folder(spark, "events")
    spark.read.parquet(f"{d}/events.parquet").write.parquet(path)
    return path


_BYTES = "byte as (select vec_id, list_transform(px, lambda v: greatest(0, least(255, floor(v * 200)))::bigint) as px from patch)"


def _slides(spark, d):
    """A small pyramid file for each patch, in a folder."""
    path = _folder(spark, "slides")
    images = V.patches(spark, d).select(F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit(".tiff")).alias("name"), F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 200)))).alias("px"))
    files.write_all(tiff.bigtiffs(images, 8, 4, 0.5), path)
    return path


def _number():
    return F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long")


@query("select vec_id, directory, case directory when 0 then 8 else 4 end::bigint as width, case directory when 0 then 2 else 1 end::int as width_tiles, 4 as tile_width, 1 as samples, 0.5::double as mpp_x, case directory when 0 then 4 else 1 end::bigint as n_tiles, 16::bigint as bytes from embeddings, range(2) t(directory)")
def tiff_directories(spark, d):
    """Directories of files of two levels, read at their places."""
    rows = tiff.read_directories(spark, _slides(spark, d))
    return rows.select(_number().alias("vec_id"), F.col("directory").cast("long").alias("directory"), "width", "width_tiles", "tile_width", "samples", "mpp_x", F.size("offsets").cast("long").alias("n_tiles"), F.array_max("byte_counts").alias("bytes"))


@query(V.sql("patch", then=", " + _BYTES + " select vec_id, t as tile_index, upper(string_agg(printf('%02x', px[(t // 2 * 4 + i // 4) * 8 + t % 2 * 4 + i % 4 + 1]), '' order by i)) as data from byte, range(4) a(t), range(16) b(i) group by vec_id, t"))
def tiff_tiles(spark, d):
    """The bytes of the first level's tiles, read by their places in the files."""
    path = _slides(spark, d)
    wanted = tiff.read_directories(spark, path).filter("directory = 0").select("path", "directory", F.explode(F.sequence(F.lit(0), F.size("offsets") - 1)).alias("tile_index"))
    tiles = tiff.read_tiles(spark, path, wanted)
    return tiles.select(_number().alias("vec_id"), F.col("tile_index").cast("long").alias("tile_index"), F.hex("data").alias("data"))


_INSTANCE = "select s_suppkey as k, case when s_suppkey % 4 = 0 then 'LABEL' else 'VOLUME' end as flavor, 1000 + s_suppkey as columns, 900 + s_suppkey as rows, 256 as tile, s_suppkey % 50 + 1 as frames, list_transform(range(s_suppkey % 3), lambda i: 'C' || s_suppkey || '-' || i) as codes from supplier"


def _series(spark, d):
    path = _folder(spark, "series")
    k = F.col("s_suppkey")
    codes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < k % 3), lambda i: F.concat(F.lit("C"), k.cast("string"), F.lit("-"), i.cast("string")))
    rows = V.table(spark, d, "supplier").select(F.concat(F.lit("i"), k.cast("string"), F.lit(".dcm")).alias("name"), F.when(k % 4 == 0, "LABEL").otherwise("VOLUME").alias("flavor"), (1000 + k).alias("columns"), (900 + k).alias("rows"), F.lit(256).alias("tile"), (k % 50 + 1).alias("frames"), codes.alias("codes"))
    files.write_all(dicom.series_files(rows), path)
    return path


@query(f"select k, flavor, columns, rows, tile::bigint as tile_width, frames::int as n_frames from ({_INSTANCE})")
def dicom_instances(spark, d):
    """Attributes of a series' files by their elements."""
    found = dicom.instances(dicom.read_elements(spark, _series(spark, d)))
    return found.select(_number().alias("k"), "flavor", "columns", "rows", "tile_width", "n_frames")


@query(f"select k, '00400555[' || i || ']' as parent, '00080100' as tag, 'SH' as vr, codes[i + 1] as value from (select *, unnest(range(len(codes))) as i from ({_INSTANCE}))")
def dicom_nested_elements(spark, d):
    """Elements within the items of a sequence of undefined length."""
    rows = dicom.read_elements(spark, _series(spark, d)).filter("parent <> ''")
    return rows.select(_number().alias("k"), "parent", "tag", "vr", "value")


@query("""with f as (select l_orderkey // 64 as k, repeat((l_partkey % 10)::varchar, l_quantity::int) as text, row_number() over (partition by l_orderkey // 64 order by l_orderkey, l_linenumber, l_partkey % 10, l_quantity) - 1 as frame from lineitem)
select k::bigint as k, frame::bigint as frame, case when k % 3 < 2 and frame % 2 = 1 and len(text) >= 4 then 2 else 1 end::bigint as n_parts, text from f""")
def dicom_frames(spark, d):
    """Frames of files of fragments, found by basic and extended tables of offsets or by their number, read at their places and put together."""
    line = V.table(spark, d, "lineitem").selectExpr("l_orderkey div 64 as k", "l_orderkey", "l_linenumber", "l_partkey % 10 as digit", "l_quantity")
    frame = F.row_number().over(W.partitionBy("k").orderBy("l_orderkey", "l_linenumber", "digit", "l_quantity")) - 1
    text, cut = F.col("text"), (F.floor(F.length("text") / 4) * 2).cast("int")
    two = F.array(F.substring(text, F.lit(1), cut).cast("binary"), F.substring(text, cut + 1, F.length(text)).cast("binary"))
    parts = F.when((F.col("k") % 3 < 2) & (F.col("frame") % 2 == 1) & (F.length(text) >= 4), two).otherwise(F.array(text.cast("binary")))
    tables = F.element_at(F.array(F.lit("basic"), F.lit("extended"), F.lit("none")), (F.col("k") % 3 + 1).cast("int"))
    # the rows of a file follow each other in a task
    rows = line.select("k", frame.alias("frame"), F.repeat(F.col("digit").cast("string"), F.col("l_quantity").cast("int")).alias("text")).select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".dcm")).alias("name"), tables.alias("tables"), parts.alias("parts"))
    made = files.write_made(rows, dicom.framed, _folder(spark, "frames"))
    found = dicom.whole_frames(spread(made.select("path", _number().alias("k")), 500), ["k"])
    return found.select("k", "frame", "n_parts", F.rtrim(F.col("data").cast("string"), F.lit("\0")).alias("text"))
