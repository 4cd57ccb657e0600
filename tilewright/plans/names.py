"""Queries over names, addresses, command lines, encoded buffers and file kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.plans import views as V
from tilewright.plans.registry import query
from tilewright.sources import files


@query("select page_id, case when strpos(url, '/') > 0 then substr(url, strpos(url, '/') + 1) end as rest, replace(url, '/', '') as stripped, replace(url, '.', '_') as underscored from pages")
def next_tokens(spark, d):
    """What follows the first separator (null without one), the text without a character, and dots as underscores."""
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", T.after(u, "/").alias("rest"), F.replace(u, F.lit("/"), F.lit("")).alias("stripped"), F.translate(u, ".", "_").alias("underscored"))


_ADDRESS = "select page_id, case when page_id % 3 = 0 then 'https' else 'http' end as protocol, 'host' || page_id % 10 || '.example.org' as host, case when page_id % 2 = 0 then 8000 + page_id % 100 when page_id % 3 = 0 then 443 else 80 end::int as port, case when page_id % 5 = 0 then '/' else '/a/' || page_id || '?q=1' end as path from pages"


@query(_ADDRESS)
def url_ports(spark, d):
    """Addresses in their four parts; the port is that of the protocol and the path the root where they are left out."""
    host = F.concat(F.lit("host"), (F.col("page_id") % 10).cast("string"), F.lit(".example.org"))
    port = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(":"), (8000 + F.col("page_id") % 100).cast("string"))).otherwise("")
    path = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("/a/"), F.col("page_id").cast("string"), F.lit("?q=1")))
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "https").otherwise("http"), F.lit("://"), host, port, path)
    parts = V.table(spark, d, "pages").select("page_id", T.address(url).alias("a"))
    return parts.select("page_id", "a.*")


@query("select page_id, case when page_id % 5 = 4 then null else page_id::int end as image_id from pages")
def image_ids(spark, d):
    """The image's number in the four forms of a path that name one, and in none."""
    n = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("/Image/Details?imageId="), n, F.lit("&x=1")), F.concat(F.lit("/image/"), n, F.lit("/metadata")), F.concat(F.lit("/Image/"), n), F.concat(F.lit("/i/"), n, F.lit("/tok")), F.concat(F.lit("/study/"), n)]
    path = F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "pages").select("page_id", T.image_id(path).alias("image_id"))


@query("select page_id, case when page_id % 3 = 0 then 'C:/slides ' || page_id || '/ü%' when page_id % 3 = 1 then '/data/' || page_id end as path from pages")
def file_uris(spark, d):
    """Local paths of file URIs: percent escapes are decoded, and a drive has no slash before it."""
    n = F.col("page_id").cast("string")
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file:///C:/slides%20"), n, F.lit("/%C3%BC%"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("file:///data/"), n)).otherwise(F.concat(F.lit("http://data/"), n))
    return V.table(spark, d, "pages").select("page_id", T.local_path(uri).alias("path"))


@query("select doc_id, md5(base64(encode(text))) as packed, md5(text) as unpacked from documents where text is not null")
def base64_round_trip(spark, d):
    """Texts as base64, and back."""
    packed = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    return V.table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(packed).alias("packed"), F.md5(F.unbase64(packed)).alias("unpacked"))


@query("""with t as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
h as (select page_id, hex(encode(url)) as whole, hex(encode(url || chr(10))) as less from pages),
b as (select page_id, [4294967295] || list_transform(range(len(whole) // 2), lambda i: ('0x' || substr(whole, i * 2 + 1, 2))::bigint) as whole, [4294967295] || list_transform(range(len(less) // 2), lambda i: ('0x' || substr(less, i * 2 + 1, 2))::bigint) as less from h)
select page_id, xor(list_reduce(whole, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) as crc, xor(list_reduce(less, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) as crc_of_lines from b, t""")
def buffer_checksums(spark, d):
    """CRC-32 of a buffer, and of one with line ends of either kind, which count alike."""
    ended = F.concat("url", F.lit("\r\n"))
    return V.table(spark, d, "pages").select("page_id", F.crc32("url").alias("crc"), T.crc32_of_lines(ended).alias("crc_of_lines"))


@query("select page_id, ['set', url, page_id::varchar] as tokens, 'set' as command from pages where url not like '%\"%'")
def command_tokens(spark, d):
    """Words of a command; quotes keep white space together."""
    line = F.concat(F.lit("  set \""), F.col("url"), F.lit("\"  "), F.col("page_id").cast("string"), F.lit(" "))
    tokens = T.command_words(line)
    return V.table(spark, d, "pages").filter(~F.col("url").contains('"')).select("page_id", tokens.alias("tokens"), F.get(tokens, 0).alias("command"))


@query("""select event_id, event_id % 2 = 0 as export, case when event_id % 3 = 0 then 'ROI ' || event_id end as roi, event_id % 5 = 0 as first_roi, case when event_id % 4 = 0 then (event_id % 101)::int else 80 end as quality,
case when event_id % 7 = 0 then 0.25::double * (event_id % 8 + 1) end as mpp, case when event_id % 7 = 1 then 256 else 512 end::int as tile_size, event_id % 11 <> 0 as with_annotations, 'slide' || event_id || '.tiff' as file from events""")
def command_lines(spark, d):
    """Export options of a command line, with what holds where they are left out."""
    n = F.col("event_id").cast("string")
    say = lambda k, r, *parts: F.when(F.col("event_id") % k == r, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise("")
    line = F.concat(F.lit("slide"), n, F.lit(".tiff"), say(2, 0, " --export"), say(3, 0, " --roi \"ROI ", n, '"'), say(5, 0, " --first-roi"), say(4, 0, " --quality ", (F.col("event_id") % 101).cast("string")),
                    say(7, 0, " --mpp ", (0.25 * (F.col("event_id") % 8 + 1)).cast("string")), say(7, 1, " --tile-size 256"), say(11, 0, " --no-annotations"))
    return V.table(spark, d, "events").select("event_id", T.export_options(line).alias("o")).select("event_id", "o.*")


_KINDS = {"a.TIFF": "tiff", "b.ptif": "tiff", "c.ndpi": "ndpi", "d.Jpeg": "simple image", "e.xml": "xml", "f.geojson": "json", "g.dcm": "dicom", "h.i2syntax": "isyntax", "i.mrxs": "mrxs", "Slidedat.ini": "mrxs", "noext": "unknown", "j.svs": "openslide compatible"}


@query("select doc_id, case " + " ".join(f"when doc_id % 13 = {k} then '{v if k < 10 else 'x'}'" for k, v in enumerate(_KINDS.values()) if k < 10) + """ when doc_id % 13 = 10 then case when doc_id % 2 = 0 then 'dicom' else 'unknown' end when doc_id % 13 = 11 then case when doc_id % 2 = 0 then 'dicom' else 'openslide compatible' end else null end as kind,
doc_id % 13 in (0, 1, 2, 3, 6, 7, 8, 9) or (doc_id % 13 = 11) or (doc_id % 13 = 10 and doc_id % 2 = 0) as is_image from documents""")
def file_kinds(spark, d):
    """Kinds of files by name, then by extension, then by the mark at byte 128; directories have none."""
    name = F.element_at(F.array(*map(F.lit, _KINDS), F.lit("folder")), (F.col("doc_id") % 13 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.repeat(F.lit("."), 128), F.lit("DICM"))).otherwise(F.lit("DICM"))
    kind = F.when(F.col("doc_id") % 13 < 12, files.kind(F.concat(F.lit("/x/"), name), F.encode(head, "UTF-8")))
    return V.table(spark, d, "documents").select("doc_id", kind.alias("kind"), files.is_image(kind).alias("is_image"))


@query("select lang as folder, cast(sum(strlen(text) + 1) as bigint) as bytes, false as contains_dicom, true as contains_other, cast(min(strlen(text) + 1) > 0 as boolean) as all_read from documents where lang is not null and text is not null group by lang")
def directory_flags(spark, d):
    """Texts written to a folder for each language, listed again: what kinds each folder holds, how many bytes, and whether the first of each file can be read."""
    from tilewright.plans.formats import _folder

    path = _folder(spark, "files")
    V.table(spark, d, "documents").filter("lang is not null and text is not null").select("lang", "text").write.partitionBy("lang").text(path)
    found = files.listing(spark, path).filter(F.col("name").startswith("part-"))
    headed = files.read_at(found, F.lit(0), F.lit(files.HEADER))
    by = F.regexp_extract("folder", "lang=(.*)$", 1)
    flags = headed.groupBy(by.alias("folder")).agg(
        F.sum("length").alias("bytes"), F.bool_or(files.kind(F.col("path"), F.col("bytes")) == "dicom").alias("contains_dicom"), F.bool_or(files.kind(F.col("path"), F.col("bytes")) != "dicom").alias("contains_other"),
        F.bool_and(F.octet_length("bytes") == F.least(F.col("length"), F.lit(files.HEADER))).alias("all_read"),
    )
    return flags
