"""Queries over names, URLs, lines, colours, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.functions.geometry import lowbias32
from tilewright.plans import views as V
from tilewright.plans.registry import query


@query(r"select page_id, regexp_extract(url, '\.([^./\\]*)$', 1) as ext, regexp_extract(url, '[^/\\]*$') as base, regexp_replace(url, '\.[^./\\]*$', '') || '.xml' as sidecar from pages")
def file_names(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", T.extension(u).alias("ext"), T.base_name(u).alias("base"), T.with_extension(u, "xml").alias("sidecar"))


@query(r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '') as path, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.\.(example|com)$') as allowed from pages")
def url_parts(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    path = F.nullif(F.regexp_extract("url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1), F.lit(""))
    return V.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), path.alias("path"), T.host_allowed(host, [".example", ".com"]).alias("allowed"))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: x <> '')) as n_lines, len(regexp_replace(text, '^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$', '', 'g')) as trimmed from documents where text is not null")
def line_counts(spark, d):
    docs = V.table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), F.length(T.trimmed(F.col("text"))).cast("long").alias("trimmed"))


@query("select p_partkey, '#' || lower(printf('%02x%02x%02x', p_partkey % 256, p_size % 256, (p_partkey * 7) % 256)) as colour, cast((p_partkey * 7) % 256 as int) as blue from part")
def hex_colours(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", T.hex_colour(F.col("p_partkey") % 256, F.col("p_size") % 256, (F.col("p_partkey") * 7) % 256).alias("colour"))
    return p.select("p_partkey", "colour", T.hex_channel(F.col("colour"), 2).alias("blue"))


@query("select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day from orders")
def dicom_dates(spark, d):
    parts = T.dicom_date(F.date_format("o_orderdate", "yyyyMMdd"))
    return V.table(spark, d, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.year", "p.month", "p.day")


@query(r"select p_partkey, [try_cast(p_partkey as int), p_size, null] as numbers from part")
def dicom_integer_lists(spark, d):
    value = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("\\+"), F.col("p_size").cast("string"), F.lit("\\x"))
    return V.table(spark, d, "part").select("p_partkey", T.dicom_integers(value).alias("numbers"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as json from events")
def json_members(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("json"))


@query("with t as (select viewer, x, y, z from (select user_id as viewer, event_id % 16 as x, event_id % 9 as y, event_id % 5 as z from events)) select distinct '/i/' || viewer || '/raw/' || z || '/' || (x * 512) || '_' || (y * 512) || '/' || least(512, 7000 - x * 512) || '_' || least(512, 4200 - y * 512) as path from t where x * 512 < 7000 and y * 512 < 4200")
def tile_paths(spark, d):
    """Raw tile paths whose request size is clamped at the edge of a level of 7000 by 4200 pixels."""
    e = V.table(spark, d, "events").selectExpr("user_id as viewer", "event_id % 16 * 512 as x", "event_id % 9 * 512 as y", "event_id % 5 as z").filter("x < 7000 and y < 4200")
    return e.select(F.format_string("/i/%d/raw/%d/%d_%d/%d_%d", "viewer", "z", "x", "y", F.least(F.lit(512), 7000 - F.col("x")), F.least(F.lit(512), 4200 - F.col("y"))).alias("path")).distinct()


@query("select page_id, url as decoded, cast(strlen(url) as bigint) as n, url_decode(replace(url, '+', '%2B')) as plain from pages")
def percent_round_trip(spark, d):
    """URLs, encoded byte by byte and decoded again; and decoded as they are."""
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", T.percent_decoded(T.percent_encoded(u)).alias("decoded"), F.octet_length(u).cast("long").alias("n"), T.percent_decoded(u).alias("plain"))


@query("select s.doc_id, s.choice from (select doc_id, case when doc_id % 2 = 0 then 'xml' when doc_id % 3 = 0 then 'geojson' when doc_id % 5 = 0 then 'json' end as choice from documents) s where s.choice is not null")
def sidecar_choice(spark, d):
    """Of the annotation files beside a document, the first by format."""
    kinds = F.array(*[F.when(F.col("doc_id") % k == 0, F.struct(F.lit(r).alias("rank"), F.lit(x).alias("choice"))) for r, (x, k) in enumerate((("xml", 2), ("geojson", 3), ("json", 5)))])
    files = V.table(spark, d, "documents").select("doc_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f"))
    return files.groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", "f.choice")


@query("with h as (select doc_id, source, lang from documents) select coalesce(a.source, b.source) as key, a.n as in_file, b.n as registered from (select source, count(*) as n from h where lang = 'en' group by 1) a full join (select source, count(*) as n from h where lang = 'fr' group by 1) b on a.source = b.source")
def option_merge(spark, d):
    """Options of a file and registered ones, matched by key; either side may lack one."""
    docs = V.table(spark, d, "documents")
    a = docs.filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("in_file"))
    b = docs.filter("lang = 'fr'").groupBy("source").agg(F.count("*").alias("registered"))
    return a.join(b, "source", "full").withColumnRenamed("source", "key")


@query("""with a as (select o_orderkey, o_orderkey % 4294967296 as v from orders), b as (select o_orderkey, xor(v, v >> 16) as v from a), c as (select o_orderkey, (((v >> 16) * 2146121005 % 65536) * 65536 + (v & 65535) * 2146121005) % 4294967296 as v from b),
e as (select o_orderkey, xor(v, v >> 15) as v from c), f as (select o_orderkey, (((v >> 16) * 2221713035 % 65536) * 65536 + (v & 65535) * 2221713035) % 4294967296 as v from e) select o_orderkey, xor(v, v >> 16) as h from f""")
def integer_hash(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", lowbias32(F.col("o_orderkey")).alias("h"))
