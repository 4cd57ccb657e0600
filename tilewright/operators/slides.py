"""Metadata of pyramids: levels and resolution of the images in a file, one common form for all kinds of files, and the level to read from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of kinds of files.
BACKENDS = {"tiff": "TIFF", "dicom": "DICOM", "mrxs": "MIRAX", "isyntax": "iSyntax", "openslide": "OpenSlide", "simple": "Simple image", "slide score": "Slide Score"}
EXPORTABLE = ("tiff", "openslide", "dicom", "isyntax", "mrxs")
COMMON = "image long, backend string, level int, width long, height long, tile_width long, tile_height long, width_in_tiles long, height_in_tiles long, um_per_pixel double"


def sub_image(description: Column, is_tiled: Column, is_first: Column) -> Column:
    """What an image of a file is, by how its description begins; the first, and other tiled ones, are levels."""
    return F.when(description.startswith("Macro"), "macro").when(description.startswith("Label"), "label").when(is_first | is_tiled, "level").otherwise("other")


def downsample_levels(images: DataFrame) -> DataFrame:
    """images (slide, ifd, width, height, tile_width, tile_height) with tile counts and level; the images of a slide after the first without tiles (tile_width 0) have no level.

    The level is the rounded logarithm of the first image's width over the own. Where sides are whole tiles, so that they may have been rounded up, it is the only one that the numbers of tiles
    allow, and if they allow several or none, the least of them but at most one more than that of the image before.
    """
    tiles = lambda side: F.when(F.col(f"tile_{side}") > 0, F.ceil(F.col(side) / F.col(f"tile_{side}"))).otherwise(0)
    rows = images.select("*", tiles("width").alias("width_in_tiles"), tiles("height").alias("height_in_tiles"))
    by = W.partitionBy("slide").orderBy("ifd")
    rows = rows.withColumns({f"main_{s}": F.first(s).over(by) for s in ("width", "height")})
    rows = rows.withColumn("in_pyramid", F.min((F.col("tile_width") > 0).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) == 1)

    def bounds(side: str) -> tuple[Column, Column]:  # of the factor by which the side may be smaller
        n, tile, main = F.col(f"{side}_in_tiles"), F.col(f"tile_{side}"), F.col(f"main_{side}")
        return main / (tile * n), main / (tile * (n - 1) + 1)

    (low_x, high_x), (low_y, high_y) = bounds("width"), bounds("height")
    even_x, even_y = F.col("width") % F.col("tile_width") == 0, F.col("height") % F.col("tile_height") == 0
    low = F.ceil(F.log2(F.when(even_y, F.greatest(low_x, low_y)).otherwise(low_x)))
    high = F.floor(F.log2(F.when(even_y, F.least(high_x, high_y)).otherwise(high_x)))
    plain = F.round(F.log2(F.col("main_width") / F.col("width")))
    # fixed is the level where it is certain; elsewhere it hangs on the one before, so a slide's few images are gone through in order
    rows = rows.withColumn("low", F.when(F.col("in_pyramid"), F.when(even_x, low).otherwise(plain)).cast("int")).withColumn("fixed", F.coalesce(F.col("in_pyramid") & (~even_x | (low == high)), F.lit(False)))
    one = F.struct("ifd", "low", "fixed")
    series = rows.filter("in_pyramid").groupBy("slide").agg(F.sort_array(F.collect_list(one)).alias("series"))
    step = lambda last, s: F.when(s["fixed"], s["low"]).otherwise(F.least(s["low"], last + 1))
    follow = lambda out, s: F.array_append(out, F.struct(s["ifd"].alias("ifd"), step(F.coalesce(F.try_element_at(out, F.lit(-1))["level"], F.lit(0)), s).alias("level")))
    found = series.select("slide", F.explode(F.aggregate("series", F.array().cast("array<struct<ifd: int, level: int>>"), follow)).alias("f")).select("slide", "f.ifd", "f.level")
    return rows.drop("main_width", "main_height", "in_pyramid", "low", "fixed").join(found, ["slide", "ifd"], "left")


def resolutions(images: DataFrame) -> DataFrame:
    """slide, mpp of images (slide, ifd, resolution (pixels a unit, null if none), in_centimetres): that of the first image if its unit is the centimetre, else a quarter.

    Over ten micrometres a pixel the tags hold micrometres themselves: then it is the least of all images, if they differ and it is under a hundred.
    """
    first = F.min_by(F.when(F.col("in_centimetres") & (F.col("resolution") > 0), 10000 / F.col("resolution")).otherwise(0.25), "ifd")
    own = images.groupBy("slide").agg(first.alias("mpp"), F.min("resolution").alias("least"), F.max("resolution").alias("most"))
    wrong = (F.col("mpp") > 10) & (F.col("least") < F.col("most")) & (F.col("least") < 100)
    return own.select("slide", F.when(wrong, F.col("least")).otherwise(F.col("mpp")).alias("mpp"))


def common(*backends: DataFrame) -> DataFrame:
    """Levels of all kinds of files in one form."""
    names = [x.split()[0] for x in COMMON.split(", ")]
    typed = [df.select(*[F.col(n).cast(t.split(" ", 1)[1]) for n, t in zip(names, COMMON.split(", "), strict=True)]) for df in backends]
    return reduce(lambda a, b: a.unionByName(b), typed)


def backend_name(backend: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in BACKENDS.items() for x in pair])[backend], F.lit("Unknown"))


def source_level(levels: DataFrame, width: Column, height: Column) -> DataFrame:
    """image, level: of the levels (image, level, width, height) at least so large that with the fewest extra pixels; without one the smallest."""
    fits = (F.col("width") >= width) & (F.col("height") >= height)
    excess = F.when(fits, F.struct((F.col("width") - width + F.col("height") - height).alias("excess"), "level"))
    small = F.struct(F.greatest("width", "height").alias("size"), "level")
    return levels.groupBy("image").agg(F.coalesce(F.min(excess)["level"], F.min(small)["level"]).alias("level"))
