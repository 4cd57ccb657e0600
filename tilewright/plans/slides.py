"""Queries over the metadata of pyramids, series and dictionaries. A slide's images are derived from an order's lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.operators import slides as S
from tilewright.plans import views as V
from tilewright.plans.registry import query
from tilewright.session import shared_dir, spread

_IFD = """ifd as (select ann_id as slide, (ord - 1)::int as ifd, n, case when ann_id % 2 = 0 then (ceil(w0 / pow(2, ord - 1) / 512) * 512)::bigint else ceil(w0 / pow(2, ord - 1))::bigint end as width,
case when ann_id % 2 = 0 then (ceil(h0 / pow(2, ord - 1) / 512) * 512)::bigint else ceil(h0 / pow(2, ord - 1))::bigint end as height, case when n >= 3 and ord = n then 0 else 512 end as tile,
case ann_id % 3 when 0 then 10000 / (0.25 + 0.01 * (ann_id % 10)) when 2 then 0.5 * (n - ord + 1) end as resolution, case when n >= 3 and ord = n then case when ann_id % 5 = 0 then 'Macro 1x' else 'Label' end else 'level' end as description
from (select *, 2048 + ann_id % 30000 as w0, 1536 + ann_id % 17000 as h0 from vtx))"""


def _ifds(spark, d):
    v = V.vertices(spark, d).select(F.col("ann_id").alias("slide"), (F.col("ord") - 1).cast("int").alias("ifd"), "n")
    side = lambda base: F.col("slide") % base[1] + base[0]
    down = lambda base: side(base) / F.pow(F.lit(2), F.col("ifd"))
    size = lambda base: F.when(F.col("slide") % 2 == 0, F.ceil(down(base) / 512) * 512).otherwise(F.ceil(down(base))).cast("long")
    last = (F.col("n") >= 3) & (F.col("ifd") == F.col("n") - 1)
    tile = F.when(last, 0).otherwise(512)
    resolution = F.when(F.col("slide") % 3 == 0, 10000 / (0.25 + 0.01 * (F.col("slide") % 10))).when(F.col("slide") % 3 == 2, 0.5 * (F.col("n") - F.col("ifd")))
    text = F.when(last, F.when(F.col("slide") % 5 == 0, "Macro 1x").otherwise("Label")).otherwise("level")
    return v.select("slide", "ifd", "n", size((2048, 30000)).alias("width"), size((1536, 17000)).alias("height"), tile.alias("tile_width"), tile.alias("tile_height"), resolution.alias("resolution"), (F.col("slide") % 3 != 1).alias("in_centimetres"), text.alias("description"))


@query(V.sql("vtx", then=", " + _IFD + """, p as (select *, first_value(width) over w as w0, first_value(height) over w as h0, width // 512 as nx, height // 512 as ny, case when n >= 3 then n - 1 else n end as tiled from ifd window w as (partition by slide order by ifd)),
q as (select *, ceil(log2(greatest(w0 / (512.0 * nx), h0 / (512.0 * ny)))) as low, floor(log2(least(w0 / (512.0 * (nx - 1) + 1), h0 / (512.0 * (ny - 1) + 1)))) as high, ceil(log2(w0 / (512.0 * nx))) as low_x, floor(log2(w0 / (512.0 * (nx - 1) + 1))) as high_x, round(log2(w0 / width::double)) as plain from p where ifd < tiled),
s as (select *, case when width % 512 <> 0 then plain when height % 512 = 0 then low else low_x end::int as guess, width % 512 <> 0 or case when height % 512 = 0 then low = high else low_x = high_x end as fixed from q),
lv as (select slide, ifd, case when fixed then guess else least(guess, 1) end as level from s where ifd = 0 union all select s.slide, s.ifd, case when s.fixed then s.guess else least(s.guess, lv.level + 1) end from lv join s on s.slide = lv.slide and s.ifd = lv.ifd + 1),
m as (select slide, max(case when ifd = 0 then case when slide % 3 <> 1 then 10000 / resolution else 0.25 end end) as mpp, min(resolution) as least, max(resolution) as most from ifd group by slide)
select slide, ifd, level, round(case when mpp > 10 and least < most and least < 100 then least else mpp end, 6) as mpp, round(case when mpp > 10 and least < most and least < 100 then least else mpp end * pow(2, level), 6) as um_per_pixel from ifd left join lv using (slide, ifd) join m using (slide)""").replace("with vtx", "with recursive vtx"))  # fmt: skip
def pyramid_metadata(spark, d):
    """Level and resolution of each image of a file."""
    images = _ifds(spark, d)
    rows = S.downsample_levels(images).join(S.resolutions(images), "slide")
    return rows.select("slide", "ifd", "level", F.round("mpp", 6).alias("mpp"), F.round(F.col("mpp") * F.pow(F.lit(2), F.col("level")), 6).alias("um_per_pixel"))


@query(V.sql("vtx", then=", " + _IFD + " select slide, ifd, case when n >= 3 and ifd = n - 1 then case when slide % 5 = 0 then 'macro' else 'label' end else 'level' end as kind from ifd"))
def sub_images(spark, d):
    """Levels, macro and label images of a file, by their descriptions."""
    return _ifds(spark, d).select("slide", "ifd", S.sub_image(F.col("description"), F.col("tile_width") > 0, F.col("ifd") == 0).alias("kind"))


@query("""with o as (select o_orderkey as image, o_custkey as w, o_orderkey % 4 as k from orders), l as (select *, unnest(range(case k when 0 then 3 when 1 then 2 when 2 then 1 else 4 end)) as level from o)
select image, ['tiff', 'dicom', 'simple', 'slide score'][k + 1] as backend, level::int as level, floor((4000 + w) / pow(2, level))::bigint as width, floor((3000 + w) / pow(2, level))::bigint as height, case when k = 2 then 4000 + w when k = 3 then 256 else 512 end as tile_width, case when k = 2 then 3000 + w when k = 3 then 256 else 512 end as tile_height,
ceil(floor((4000 + w) / pow(2, level))::bigint / (case when k = 2 then 4000 + w when k = 3 then 256 else 512 end)::double)::bigint as width_in_tiles, ceil(floor((3000 + w) / pow(2, level))::bigint / (case when k = 2 then 3000 + w when k = 3 then 256 else 512 end)::double)::bigint as height_in_tiles, (case when k = 2 then 1.0 else 0.25 end) * pow(2, level) as um_per_pixel from l""")
def common_pyramid(spark, d):
    """Levels of four kinds of files in one form: images with their sides, instances of a series, a single image, and a server's answer with numbers of levels."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("w"), (F.col("o_orderkey") % 4).alias("k"))

    def kind(k, name, levels, tile, mpp):
        rows = o.filter(F.col("k") == k).select("image", "w", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
        half = F.pow(F.lit(2.0), F.col("level"))
        rows = rows.select("image", F.lit(name).alias("backend"), "level", "w", F.floor((4000 + F.col("w")) / half).alias("width"), F.floor((3000 + F.col("w")) / half).alias("height"), (mpp * half).alias("um_per_pixel"))
        rows = rows.withColumns({"tile_width": F.lit(tile) if tile else 4000 + F.col("w"), "tile_height": F.lit(tile) if tile else 3000 + F.col("w")})
        return rows.withColumns({f"{s}_in_tiles": F.ceil(F.col(s) / F.col(f"tile_{s}")) for s in ("width", "height")})

    return S.common(kind(0, "tiff", 3, 512, 0.25), kind(1, "dicom", 2, 512, 0.25), kind(2, "simple", 1, 0, 1.0), kind(3, "slide score", 4, 256, 0.25))


@query("select p_partkey, ['TIFF', 'DICOM', 'MIRAX', 'iSyntax', 'OpenSlide', 'Simple image', 'Slide Score', 'Unknown'][p_partkey % 8 + 1] as name, p_partkey % 8 < 5 as can_export from part")
def backend_names(spark, d):
    """Names of kinds of files, and whether a region of one can be exported."""
    kind = F.element_at(F.array(*map(F.lit, S.BACKENDS), F.lit("other")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", S.backend_name(kind).alias("name"), kind.isin(*S.EXPORTABLE).alias("can_export"))


@query(V.sql("vtx", then=", " + _IFD + """ select slide as image, coalesce(arg_min(ifd, (width + height) * 1000 + ifd) filter (width >= 2500 and height >= 1800), arg_min(ifd, greatest(width, height) * 1000 + ifd)) as level from ifd group by slide"""))
def source_levels(spark, d):
    """The level of each slide that a thumbnail of 2,500 by 1,800 is made from."""
    return S.source_level(_ifds(spark, d).select(F.col("slide").alias("image"), F.col("ifd").alias("level"), "width", "height"), F.lit(2500), F.lit(1800))


@query("""with i as (select l_orderkey as series, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as width, l_linenumber from lineitem where l_linenumber % 4 <> 3), b as (select series from i group by series having count(*) > count(distinct width))
select series, width, row_number() over (partition by series order by width desc) - 1 as level, round(log2(max(width) over (partition by series) / width))::int as downsample from i where series not in (select series from b)""")
def dicom_series(spark, d):
    """Instances of a volume by width, the largest first; a series with equal widths is refused. The level below is inferred from widths."""
    i = V.table(spark, d, "lineitem").filter("l_linenumber % 4 <> 3").select(F.col("l_orderkey").alias("series"), F.expr("l_partkey * 100000 + l_suppkey * 10 + l_linenumber").alias("width"))
    w = W.partitionBy("series").orderBy(F.desc("width"))
    rows = i.select("series", "width", (F.row_number().over(w) - 1).cast("long").alias("level"), F.first("width").over(w).alias("most"), (F.lag("width").over(w) == F.col("width")).alias("same"))
    rows = rows.withColumn("refused", F.coalesce(F.bool_or("same").over(W.partitionBy("series")), F.lit(False))).filter("not refused")
    return rows.select("series", "width", "level", F.round(F.log2(F.col("most") / F.col("width"))).cast("int").alias("downsample"))


@query("""with f as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as frame, (l_quantity::bigint + 1) // 2 * 2 as bytes from lineitem)
select l_orderkey, frame, 132 + 1000 + coalesce(sum(bytes + 8) over (partition by l_orderkey order by frame rows between unbounded preceding and 1 preceding), 0)::bigint as place, bytes from f""")
def frame_offsets(spark, d):
    """Places of an instance's frames: a table of offsets, joined to the frames by number, behind the file's mark and what stands before the pixels."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    f = V.table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.floor((F.col("l_quantity").cast("long") + 1) / 2) * 2).alias("bytes"))
    before = F.sum(F.col("bytes") + 8).over(W.partitionBy("l_orderkey").orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    offsets = f.select("l_orderkey", "frame", F.coalesce(before, F.lit(0)).alias("offset"))
    return f.join(offsets, ["l_orderkey", "frame"]).select("l_orderkey", "frame", (F.lit(132 + 1000) + F.col("offset")).alias("place"), "bytes")


@query("select zoom, x, y, arg_max(value, event_id) as last_value, arg_min(value, event_id) as first_value, count(*) as n from (select event_id, value, (event_id % 5)::int as zoom, (event_id * 7 % 4096 % 64) >> (event_id % 5) as x, (event_id * 7 % 4096 // 64) >> (event_id % 5) as y from events) group by all")
def index_pages(spark, d):
    """Entries of an index: an image's number is its place in a grid of 64 columns, coarser with each level; of entries for one place the last counts, or the first."""
    e = V.table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 5).cast("int").alias("zoom"), (F.col("event_id") * 7 % 4096).alias("image"))
    place = e.select("event_id", "value", "zoom", F.expr("shiftright(image % 64, zoom)").alias("x"), F.expr("shiftright(image div 64, zoom)").alias("y"))
    return place.groupBy("zoom", "x", "y").agg(F.max_by("value", "event_id").alias("last_value"), F.min_by("value", "event_id").alias("first_value"), F.count("*").alias("n"))


# Unique identifiers of transfer syntaxes.
_UIDS = {"1.2.840.10008.1.2": "ImplicitVRLittleEndian", "1.2.840.10008.1.2.1": "ExplicitVRLittleEndian", "1.2.840.10008.1.2.4.50": "JPEGBaseline8Bit", "1.2.840.10008.1.2.4.90": "JPEG2000Lossless"}


@query("select p_partkey, [" + ", ".join(f"'{v}'" for v in _UIDS.values()) + ", null][p_partkey % 5 + 1] as keyword from part")
def uid_names(spark, d):
    """Keywords of identifiers, which may end in a null character; null for others."""
    uid = F.element_at(F.array(*[F.lit(u + "\0" * (len(u) % 2)) for u in _UIDS], F.lit("1.2.3")), (F.col("p_partkey") % 5 + 1).cast("int"))
    known = spark.createDataFrame(list(_UIDS.items()), "uid string, keyword string")
    return V.table(spark, d, "part").select("p_partkey", F.rtrim(uid, F.lit("\0 ")).alias("uid")).join(F.broadcast(known), "uid", "left").select("p_partkey", "keyword")


@query(r"select p_partkey, [p_size * 0.5::double, null, -2500.0::double] as decimals, ['ORIGINAL', 'P' || p_size] as codes, 'short ' || p_partkey as name from part")
def dicom_values(spark, d):
    """Decimal strings, code strings and short strings with backslashes between values."""
    s = F.col("p_size")
    decimals = F.concat(F.lit(" "), (s * 0.5).cast("string"), F.lit(r" \ x\-2.5e3 "))
    codes = F.concat(F.lit(r"ORIGINAL \P"), s.cast("string"), F.lit(" "))
    return V.table(spark, d, "part").select("p_partkey", T.dicom_decimals(decimals).alias("decimals"), T.dicom_codes(codes).alias("codes"), T.trimmed(F.concat(F.lit(" short "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("name"))


@query("select o_orderkey, (o_orderkey % 24)::int as hour, case when o_orderkey % 4 > 0 then (o_orderkey % 60)::int end as minute, case when o_orderkey % 4 > 1 then (o_orderkey % 59)::int end as second, case when o_orderkey % 4 > 2 then (o_orderkey % 1000 * 100)::int end as microsecond from orders")
def dicom_time_parts(spark, d):
    """Times of two to thirteen characters; parts that aren't there are null, and a fraction is in microseconds."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 4
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(k % 24), F.when(n > 0, two(k % 60)).otherwise(""), F.when(n > 1, two(k % 59)).otherwise(""), F.when(n > 2, F.concat(F.lit("."), F.lpad((k % 1000).cast("string"), 4, "0"))).otherwise(""))
    return V.table(spark, d, "orders").select("o_orderkey", T.dicom_time(text).alias("t")).select("o_orderkey", "t.*")


@query("select p_partkey, (0.0001 * (1 + p_size % 5) * 1000)::double as mpp, 'part \"' || p_partkey || '\" & <b>' as title, (p_size % 7)::int as levels from part")
def xml_headers(spark, d):
    """Attributes of a scanner's XML header, among them a list of quoted numbers (pixel spacing in millimetres)."""
    spacing = (0.0001 * (1 + F.col("p_size") % 5)).cast("string")
    title = F.concat(F.lit("part &quot;"), F.col("p_partkey").cast("string"), F.lit("&quot; &amp; &lt;b&gt;"))
    attribute = lambda name, value: F.concat(F.lit(f'<Attribute Name="{name}" Group="0x0028">'), value, F.lit("</Attribute>"))
    array = F.concat(*[F.concat(F.lit("<Array>"), F.repeat(F.lit("<DataObject/>"), (F.col("p_size") % 7).cast("int")), F.lit("</Array>"))])
    xml = F.concat(F.lit('<DataObject ObjectType="Import">'), attribute("PIXEL_SPACING", F.concat(F.lit("&quot;"), spacing, F.lit("&quot; &quot;"), spacing, F.lit("&quot;"))), attribute("TITLE", title), attribute("LEVELS", array), F.lit("</DataObject>"))
    # the document is parsed once for all three; the character between them can't stand in XML
    attribute_at = lambda name: f'/DataObject/Attribute[@Name="{name}"]'
    found = F.xpath_string("xml", F.lit(f"concat({attribute_at('PIXEL_SPACING')}, '\x01', {attribute_at('TITLE')}, '\x01', count({attribute_at('LEVELS')}/Array/DataObject))"))
    x = spread(V.table(spark, d, "part")).select("p_partkey", xml.alias("xml")).select("p_partkey", F.split(found, "\x01").alias("a"))
    mpp = F.regexp_extract(F.col("a")[0], '"([^"]+)"', 1).cast("double") * 1000
    return x.select("p_partkey", mpp.alias("mpp"), F.col("a")[1].alias("title"), F.col("a")[2].cast("int").alias("levels"))


@query("select (p_partkey // 65536) % 65536 as grp, p_partkey % 65536 as element, p_name as name, replace(p_name, ' ', '') as keyword, ['US', 'LO', 'SQ'][p_size % 3 + 1] as vr from part")
def dictionary_table(spark, d):
    """A dictionary's rows of an XML table, (gggg,eeee) with name, keyword and type, as a table."""
    from tilewright.plans.formats import _folder

    path = _folder(spark, "dictionary")
    tag = F.format_string("(%04X,%04X)", F.floor(F.col("p_partkey") / 65536) % 65536, F.col("p_partkey") % 65536)
    vr = F.element_at(F.array(F.lit("US"), F.lit("LO"), F.lit("SQ")), (F.col("p_size") % 3 + 1).cast("int"))
    cells = F.array(tag, F.col("p_name"), F.regexp_replace("p_name", " ", ""), vr)
    spread(V.table(spark, d, "part")).select(F.transform(cells, lambda c: F.struct(c.alias("para"))).alias("td")).write.format("xml").option("rootTag", "tbody").option("rowTag", "tr").save(path)
    rows = spark.read.format("xml").option("rowTag", "tr").schema("td array<struct<para: string>>").load(path)
    cell = lambda k: F.col("td")[k]["para"]
    part = lambda k: F.conv(F.regexp_extract(cell(0), r"^\(([0-9A-Fa-f]{4}),([0-9A-Fa-f]{4})\)$", k), 16, 10).cast("long")
    return rows.select(part(1).alias("grp"), part(2).alias("element"), cell(1).alias("name"), cell(2).alias("keyword"), cell(3).alias("vr"))


@query("with o as (select o_orderkey as k, 'https://host/api/' as b from orders) select k, b || case k % 3 when 0 then 'image?imageid=' || k when 1 then 'tiles?imageid=' || k || '&token=a%2fb%20' || k else 'study' end as url from o")
def api_calls(spark, d):
    """Addresses of a server's calls: the named endpoint and its parameters, of which those without a value are left out."""
    k = F.col("o_orderkey").cast("string")
    name = F.element_at(F.array(F.lit("image"), F.lit("tiles"), F.lit("study")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    params = {"imageid": F.when(F.col("o_orderkey") % 3 < 2, k), "token": F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("a/b "), k))}
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.api_call("https://host/api/", name, params).alias("url"))


@query("select event_id, event_id::varchar as id, coalesce(json_extract_string(props, '$.k'), '') as k, null::varchar as missing from events")
def bound_fields(spark, d):
    """Members of an object bound to the fields that a table names; of members of one name the first counts, others are left out."""
    text = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"other":[1],"k":"'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit('","id":0}'))
    names = spark.createDataFrame([("id", "id"), ("k", "k"), ("missing", "missing")], "member string, field string")
    pairs = F.regexp_extract_all(text, F.lit(r'"([A-Za-z]+)":("[^"]*"|[0-9.]+)'), 0)
    seen = V.table(spark, d, "events").select("event_id", F.posexplode(pairs).alias("seq", "pair"))
    seen = seen.select("event_id", "seq", F.regexp_extract("pair", '^"([A-Za-z]+)"', 1).alias("member"), F.replace(F.regexp_extract("pair", ":(.*)$", 1), F.lit('"'), F.lit("")).alias("value"))
    bound = seen.join(F.broadcast(names), "member").groupBy("event_id").pivot("field", ["id", "k", "missing"]).agg(F.min_by("value", "seq"))
    return bound.select("event_id", "id", "k", "missing")


@query("select p_partkey, p_partkey % 3 = 0 as exists, case when p_partkey % 3 = 0 then p_size end as bytes from part")
def existing_files(spark, d):
    """Which of the names that are asked for a listing holds."""
    p = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/data/"), F.col("p_partkey").cast("string")).alias("path"), "p_size")
    listed = p.filter("p_partkey % 3 = 0").select("path", F.col("p_size").alias("bytes"))
    return p.select("p_partkey", "path").join(listed, "path", "left").select("p_partkey", F.col("bytes").isNotNull().alias("exists"), "bytes")


@query(V.sql("vtx", then=", " + _IFD + " select slide, ifd, width, height, tile::int as tile_width, description from ifd"))
def metadata_round_trip(spark, d):
    """Metadata of all images, written as compressed columns and as lines of text, and read again."""
    path = f"{shared_dir(spark)}/metadata-{uuid.uuid4().hex}"
    rows = _ifds(spark, d).select("slide", "ifd", "width", "height", "tile_width", "description")
    rows.write.option("compression", "lz4_raw").parquet(path)
    spark.read.parquet(path).write.option("header", True).csv(f"{path}-text")
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}-text")


@query("select event_type as section, count(*) as n, round(sum(ms), 6) as total_ms, round(1000 * count(*) / sum(ms), 6) as per_second from (select event_type, (value + 1) * 2.0 as ms from events where value >= 0) group by event_type")
def section_times(spark, d):
    """Time and rate of each section of frames that begin and end at stated clocks."""
    e = V.table(spark, d, "events").filter("value >= 0").select(F.col("event_type").alias("section"), F.col("event_id").cast("double").alias("start"), (F.col("value") + 1).alias("took"))
    ms = F.col("took") * 2.0
    return e.groupBy("section").agg(F.count("*").alias("n"), F.round(F.sum(ms), 6).alias("total_ms"), F.round(1000 * F.count("*") / F.sum(ms), 6).alias("per_second"))
