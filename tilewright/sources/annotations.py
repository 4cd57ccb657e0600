"""Annotation documents: GeoJSON collections and XML outlines, groups and features as DataFrames, in pixels in the file and in world units outside.

A written data set is a folder of files, each of which is a whole document (a FeatureCollection, or elements under one root), so that writing and reading run on all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import files, ranges

RING = "array<struct<x: double, y: double>>"
#: Levels of collections within collections that are read, and features in one written file.
NESTED, FILE_FEATURES = 4, 20_000


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """A column of another that it uses several times: within lambdas Spark would work that one out each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _points(line: Column, mpp_x: float, mpp_y: float) -> Column:
    """The positions of a line in world units; those without two numbers are skipped."""
    xy = F.transform(_get(line, "$", "array<variant>"), lambda p: F.struct((_get(p, "$[0]", "double") * mpp_x).alias("x"), (_get(p, "$[1]", "double") * mpp_y).alias("y")))
    return F.filter(xy, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _parts(geometry: Column, mpp_x: float, mpp_y: float) -> Column:
    """Parts (type, ring) of a geometry that is no collection; of polygons only the outer ring counts. A last point that is the first is left out of it, and parts with too few points are."""
    many = _get(geometry, "$.coordinates", "array<variant>")
    own = _get(geometry, "$.coordinates", "variant")
    lone = F.to_variant_object(F.array(own))  # a position as a line of one
    line = lambda v: _points(v, mpp_x, mpp_y)
    part = lambda name, ring: F.struct(F.lit(name).alias("type"), ring.alias("ring"))

    def opened(ring: Column) -> Column:
        n = F.size(ring)
        return F.when((n >= 2) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)

    outline = lambda v: part("Polygon", _once(line(_get(v, "$[0]", "variant")), opened))
    found = lambda kind: (
        F.when(kind == "Point", F.array(part("Point", line(lone))))
        .when(kind == "MultiPoint", F.transform(many, lambda p: part("Point", line(F.to_variant_object(F.array(p))))))
        .when(kind == "LineString", F.array(part("LineString", line(own))))
        .when(kind == "MultiLineString", F.transform(many, lambda v: part("LineString", line(v))))
        .when(kind == "Polygon", F.array(outline(own)))
        .when(kind == "MultiPolygon", F.transform(many, outline))
    )
    least = lambda p: F.when(p["type"] == "Polygon", 3).when(p["type"] == "LineString", 2).otherwise(1)
    return F.filter(F.coalesce(_once(_get(geometry, "$.type", "string"), found), F.array().cast(f"array<struct<type: string, ring: {RING}>>")), lambda p: F.size(p["ring"]) >= least(p))


def _colour(value: Column) -> Column:
    """#rrggbb of a list of channels, cut to bytes, or of a packed number; null for anything else."""
    listed = F.transform(_get(value, "$", "array<double>"), lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v.cast("long")))), 2, "0"))
    number = F.lpad(F.hex(_get(value, "$", "double").cast("long").bitwiseAND(F.lit(0xFFFFFF))), 6, "0")
    return F.lower(F.concat(F.lit("#"), F.when(F.size(listed) >= 3, F.array_join(F.slice(listed, 1, 3), "")).otherwise(number)))


def read_features(spark: SparkSession, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0, by_line: bool = False, range_bytes: int | None = None) -> DataFrame:
    """file, place, ann_id, name, grp, colour, parts (array of type and ring) of each member of the collections; a member that is no feature, or of whose geometry nothing can be read, has no parts (such count as skipped).

    A file is one FeatureCollection, in any layout, or has a feature on each line (what else is there is left out), and is read by one task. With by_line a file of any size is read by many tasks: each line is a feature, as write_geojson()
    writes them, and lines that are none are left out. With range_bytes (ranges.RANGE suits large files) a collection of any size and layout is read by many tasks, a range of so many bytes each; place is then the member's place in bytes, and
    files that are no whole collection give no rows. The group is the name of the classification, or the classification itself if it is a text. Collections in collections are read to NESTED levels.
    """
    file = F.input_file_name().alias("file")
    if range_bytes:
        found = ranges.elements(files.listing(spark, path), "features", "FeatureCollection", range_bytes)
        members = found.select(F.col("path").alias("file"), "place", F.try_parse_json("text").alias("f"))
    elif by_line:
        line = F.try_parse_json(F.rtrim(F.col("value"), F.lit(",\r")))
        members = spark.read.text(path).select(file, F.lit(None).cast("int").alias("place"), line.alias("f")).filter(_get(F.col("f"), "$.type", "string") == "Feature")
    else:
        root = spark.read.text(path, wholetext=True).select(file, "value", F.try_parse_json("value").alias("r"))
        whole = _get(F.col("r"), "$.type", "string") == "FeatureCollection"
        lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda t: F.try_parse_json(F.rtrim(t, F.lit(",")))), lambda v: _get(v, "$.type", "string") == "Feature")
        members = root.select("file", F.posexplode(F.when(whole, _get(F.col("r"), "$.features", "array<variant>")).otherwise(lines)).alias("place", "f"))
    f = F.col("f")
    geometries = F.array(F.when(_get(f, "$.type", "string") == "Feature", _get(f, "$.geometry", "variant")))
    for _ in range(NESTED):
        geometries = F.flatten(F.transform(geometries, lambda g: F.when(_get(g, "$.type", "string") == "GeometryCollection", F.coalesce(_get(g, "$.geometries", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array(g))))
    parts = F.flatten(F.transform("geometries", lambda g: _parts(g, mpp_x, mpp_y)))
    named, text = _get(f, "$.properties.classification.name", "string"), _get(f, "$.properties.classification", "string")
    group = F.coalesce(named, F.when(F.schema_of_variant(_get(f, "$.properties.classification", "variant")) == "STRING", text))
    rows = members.select("file", "place", _get(f, "$.id", "long").alias("ann_id"), _get(f, "$.properties.name", "string").alias("name"), group.alias("grp"), _colour(_get(f, "$.properties.classification.color", "variant")).alias("colour"), geometries.alias("geometries"))
    return rows.select("file", "place", "ann_id", "name", "grp", "colour", parts.alias("parts"))


def read_geojson(spark: SparkSession, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0, by_line: bool = False, range_bytes: int | None = None) -> DataFrame:
    """ann_id, name, grp, colour, type, part, ring of each part of each feature's geometry (see read_features)."""
    rows = read_features(spark, path, mpp_x, mpp_y, by_line, range_bytes).select("ann_id", "name", "grp", "colour", F.posexplode("parts").alias("part", "p"))
    return rows.select("ann_id", "name", "grp", "colour", "p.type", "part", "p.ring")


def import_counts(features: DataFrame) -> DataFrame:
    """file, imported, skipped, success of read_features(): a file is read if one of its features was."""
    some = F.size("parts") > 0
    return features.groupBy("file").agg(F.count_if(some).alias("imported"), F.count_if(~some).alias("skipped"), F.bool_or(some).alias("success"))


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one file: a collection's head, a feature to a line, its end."""
    begun = '{"type":"FeatureCollection","features":['
    held = None
    for batch in batches:
        lines = batch.column("value").to_pylist()
        out = ([begun] if held is None and lines else []) + [f"{x}," for x in ([held] if held is not None else []) + lines[:-1]]
        held = lines[-1] if lines else held
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([begun, "]}"] if held is None else [held, "]}"], pa.string())], ["value"])


def write_geojson(annotations: DataFrame, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0) -> None:
    """Files of one FeatureCollection each, of annotations (ann_id, name, grp, type, ring, or geometry instead of type and ring: the text of a geometry in pixels; perhaps colour); the ring of a polygon is closed by its
    first point."""
    if "geometry" not in annotations.columns:
        xy = F.transform("ring", lambda p: F.array(p["x"] / mpp_x, p["y"] / mpp_y))
        closed = F.concat(xy, F.slice(xy, 1, 1))
        text = F.when(F.col("type") == "Polygon", F.to_json(F.array(closed))).when(F.col("type") == "Point", F.to_json(F.element_at(xy, 1))).otherwise(F.to_json(xy))
        annotations = annotations.withColumn("geometry", F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","coordinates":'), text, F.lit("}")))
    colour = F.transform(F.array(*[F.conv(F.substring("colour", k, 2), 16, 10) for k in (2, 4, 6)]), lambda c: c.cast("int")) if "colour" in annotations.columns else F.lit(None).cast("array<int>")
    properties = F.to_json(F.struct(F.lit("annotation").alias("objectType"), "name", F.struct(F.col("grp").alias("name"), colour.alias("color")).alias("classification")))
    feature = F.concat(F.lit('{"type":"Feature","id":'), F.col("ann_id").cast("string"), F.lit(',"geometry":'), F.col("geometry"), F.lit(',"properties":'), properties, F.lit("}"))
    parts = -(-annotations.count() // FILE_FEATURES)
    annotations.select(feature.alias("value")).repartition(max(1, parts)).mapInArrow(_collections, "value string").write.text(path)


_XML = "_Name string, _PartOfGroup string, _Type string, _Color string, Coordinates struct<Coordinate: array<struct<_Order: int, _X: double, _Y: double>>>, Features struct<Feature: array<struct<_Name: string, _Value: double>>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(schema).load(path)


def read_xml(spark: SparkSession, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0) -> DataFrame:
    """name, grp, type, colour, ring, features (a map of name and value) of the Annotation elements, with coordinates in the order that they state. Unknown types are polygons."""
    rows = _xml(spark, path, "Annotation", _XML)
    ordered = F.array_sort(F.filter(F.coalesce("Coordinates.Coordinate", F.array().cast("array<struct<_Order: int, _X: double, _Y: double>>")), lambda c: c["_X"].isNotNull() & c["_Y"].isNotNull()))
    kind = F.when(F.col("_Type").isin("Rectangle", "Polygon", "Spline", "Dot"), F.col("_Type")).otherwise("Polygon")
    ring = F.transform(ordered, lambda c: F.struct((c["_X"] * mpp_x).alias("x"), (c["_Y"] * mpp_y).alias("y")))
    # of values of one feature the last counts
    known = F.filter(F.coalesce("Features.Feature", F.array().cast("array<struct<_Name: string, _Value: double>>")), lambda f: f["_Name"].isNotNull() & f["_Value"].isNotNull())
    features = F.aggregate(known, F.create_map().cast("map<string, double>"), lambda m, f: F.map_concat(F.map_filter(m, lambda k, _: k != f["_Name"]), F.create_map(f["_Name"], f["_Value"])))
    return rows.select(F.col("_Name").alias("name"), F.col("_PartOfGroup").alias("grp"), kind.alias("type"), F.col("_Color").alias("colour"), ring.alias("ring"), features.alias("features"))


def read_xml_groups(spark: SparkSession, path: str) -> DataFrame:
    """name, colour, parent of the Group elements; of those of one name the last by colour counts."""
    rows = _xml(spark, path, "Group", "_Name string, _Color string, _PartOfGroup string").filter("_Name is not null")
    return rows.groupBy(F.col("_Name").alias("name")).agg(F.max(F.struct("_Color", "_PartOfGroup")).alias("g")).select("name", F.col("g._Color").alias("colour"), F.col("g._PartOfGroup").alias("parent"))


def read_xml_features(spark: SparkSession, path: str) -> DataFrame:
    """name, restrict_to_group of the Feature elements that define one (those of annotations have a value)."""
    rows = _xml(spark, path, "Feature", "_Name string, _RestrictToGroup string, _Value double").filter("_Name is not null and _Value is null")
    return rows.groupBy(F.col("_Name").alias("name")).agg(F.max("_RestrictToGroup").alias("restrict_to_group"))


def known_groups(groups: DataFrame, annotations: DataFrame, colour: str = "#000000") -> DataFrame:
    """Groups (name, colour, parent), and those that only annotations name, each once."""
    named = annotations.filter("grp is not null").select(F.col("grp").alias("name")).distinct().join(groups.select("name"), "name", "left_anti")
    return groups.unionByName(named.select("name", F.lit(colour).alias("colour"), F.lit(None).cast("string").alias("parent")))


def write_xml(annotations: DataFrame, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0) -> None:
    """Annotation elements under ASAP_Annotations in each part file, of annotations (name, grp, type, colour, ring; perhaps features, of which those that aren't 0 are written)."""
    points = F.transform("ring", lambda p, i: F.struct(i.alias("_Order"), (p["x"] / mpp_x).alias("_X"), (p["y"] / mpp_y).alias("_Y")))
    columns = [F.col("colour").alias("_Color"), F.col("name").alias("_Name"), F.col("grp").alias("_PartOfGroup"), F.col("type").alias("_Type"), F.struct(points.alias("Coordinate")).alias("Coordinates")]
    if "features" in annotations.columns:
        values = F.transform(F.map_entries(F.map_filter("features", lambda _, v: v != 0)), lambda e: F.struct(e["key"].alias("_Name"), e["value"].alias("_Value")))
        columns.append(F.when(F.size(values) > 0, F.struct(values.alias("Feature"))).alias("Features"))
    annotations.select(*columns).write.format("xml").option("rootTag", "ASAP_Annotations").option("rowTag", "Annotation").save(path)


def write_xml_set(annotations: DataFrame, groups: DataFrame, features: DataFrame, path: str, mpp_x: float = 1.0, mpp_y: float = 1.0) -> None:
    """A whole set below a folder: groups (name, colour, parent) without the group None, features (name, restrict_to_group), and annotations."""
    own = groups.filter("name <> 'None'").select(F.col("name").alias("_Name"), F.col("colour").alias("_Color"), F.coalesce("parent", F.lit("None")).alias("_PartOfGroup"))
    own.write.format("xml").option("rootTag", "AnnotationGroups").option("rowTag", "Group").save(f"{path}/groups")
    features.select(F.col("name").alias("_Name"), F.col("restrict_to_group").alias("_RestrictToGroup")).write.format("xml").option("rootTag", "AnnotationFeatures").option("rowTag", "Feature").save(f"{path}/features")
    write_xml(annotations, f"{path}/annotations", mpp_x, mpp_y)
