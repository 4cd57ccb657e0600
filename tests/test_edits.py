"""Edits, names and metadata on odd rows."""

from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import text as T
from tilewright.operators import edits, slides

SHAPE = "ann_id long, type string, ring array<struct<x: double, y: double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_odd_shapes(spark):
    rows = spark.createDataFrame([(1, "rectangle", [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, "line", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.001)]), (3, "line", [(1.0, 1.0)]), (4, "polygon", [])], SHAPE)
    point = F.struct(F.lit(9.0).alias("x"), F.lit(8.0).alias("y"))
    moved = {r["ann_id"]: [tuple(p) for p in r["v"]] for r in rows.select("ann_id", edits.moved(F.col("ring"), F.col("type"), F.lit(3), point).alias("v")).collect()}
    assert moved[1] == [(4.0, 8.0), (4.0, 0.0), (9.0, 0.0), (9.0, 8.0)] and moved[2][3] == (9.0, 8.0) and moved[3] == [(1.0, 1.0)] and moved[4] == []
    kind, ring = edits.as_polygon(F.col("ring"), F.col("type"))
    assert {r["ann_id"]: (r["k"], len(r["r"])) for r in rows.select("ann_id", kind.alias("k"), ring.alias("r")).collect()} == {1: ("rectangle", 4), 2: ("polygon", 3), 3: ("line", 1), 4: ("polygon", 0)}
    kind, ring = edits.as_line(F.col("ring"), F.col("type"), F.lit(1))
    assert {r["ann_id"]: (r["k"], len(r["r"])) for r in rows.select("ann_id", kind.alias("k"), ring.alias("r")).collect()} == {1: ("line", 5), 2: ("line", 4), 3: ("line", 1), 4: ("polygon", 0)}
    assert {r["ann_id"]: r["v"] is not None for r in rows.select("ann_id", edits.continued(F.col("ring"), F.col("type"), F.lit(1)).alias("v")).collect()} == {1: False, 2: False, 3: False, 4: False}


def test_addresses_and_paths(spark):
    assert tuple(one(spark, T.address(F.lit("https://a.b:8080/c?d=1#e")))) == ("https", "a.b", 8080, "/c?d=1#e")
    assert tuple(one(spark, T.address(F.lit("http://a")))) == ("http", "a", 80, "/") and one(spark, T.address(F.lit("a/b"))) is None
    assert one(spark, T.image_id(F.lit("/Image/Details?x=1&imageId=42"))) == 42 and one(spark, T.image_id(F.lit("/i/7/8"))) == 7 and one(spark, T.image_id(F.lit("/j/7"))) is None
    assert one(spark, T.local_path(F.lit("file:///C:/a%20b"))) == "C:/a b" and one(spark, T.local_path(F.lit("file://localhost/a+b%zz"))) == "/a+b%zz" and one(spark, T.local_path(F.lit("http://a"))) is None
    assert one(spark, T.command_words(F.lit('a  "b c" d"e f"'))) == ["a", "b c", "d", "e f"] and one(spark, T.command_words(F.lit(""))) == []
    options = one(spark, T.export_options(F.lit('"my slide.tiff" --export --mpp x --quality')))
    assert options["file"] == "my slide.tiff" and options["export"] and options["mpp"] is None and options["quality"] == 80 and options["with_annotations"]
    assert one(spark, T.after(F.lit("a/b/c"), "/")) == "b/c" and one(spark, T.after(F.lit("abc"), "/")) is None
    assert one(spark, T.percent_decoded(F.lit("a%2"))) == "a%2" and one(spark, T.percent_decoded(F.lit("%C3%A9+%41%"))) == "é+A%"
    assert tuple(one(spark, T.dicom_time(F.lit("093015.25")))) == (9, 30, 15, 250000) and tuple(one(spark, T.dicom_time(F.lit("9:30")))) == (None, None, None, None)


def test_rationals(spark):
    values = [0.25, 3.0, 1 / 3, 3.141592653589793, 40000.5, 1e-9]
    got = [one(spark, G.rational(F.lit(v))) for v in values]
    assert [tuple(r) for r in got[:3]] == [(1, 4), (3, 1), (1, 3)]
    assert all(r["denominator"] <= (2**31 - 1) // 4 and abs(r["numerator"] / r["denominator"] - v) < 1e-8 for r, v in zip(got, values, strict=True))


def test_levels_of_rounded_images(spark):
    shape = "slide long, ifd int, width long, height long, tile_width int, tile_height int"
    # sides are whole tiles: the last level's real width is anywhere between one pixel and a tile
    rows = [(1, 0, 4096, 4096, 512, 512), (1, 1, 2048, 2048, 512, 512), (1, 2, 512, 512, 512, 512), (1, 3, 512, 512, 0, 0), (1, 4, 512, 512, 512, 512), (2, 0, 1000, 900, 256, 256), (2, 1, 251, 226, 256, 256), (3, 0, 700, 700, 0, 0)]
    got = {(r["slide"], r["ifd"]): r["level"] for r in slides.downsample_levels(spark.createDataFrame(rows, shape)).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): None, (1, 4): None, (2, 0): 0, (2, 1): 2, (3, 0): None}
    images = spark.createDataFrame([(1, 0, None, True), (2, 0, 0.5, True), (2, 1, 0.25, True), (3, 0, 0.5, True), (4, 0, 20000.0, True), (5, 0, 20000.0, False)], "slide long, ifd int, resolution double, in_centimetres boolean")
    assert {r["slide"]: r["mpp"] for r in slides.resolutions(images).collect()} == {1: 0.25, 2: 0.25, 3: 20000.0, 4: 0.5, 5: 0.25}
