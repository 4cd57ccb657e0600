"""Option files: sections of key=value lines, comments from a semicolon, one file to a group of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import SPREAD_ROWS, discard, written


def read_options(spark: SparkSession, path: str) -> DataFrame:
    """file, line, section, key, value: each file is one small row, taken apart in place, so that a section reaches the lines that follow it. A later line of a key stands beside an earlier one."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    sections = whole.select("file", F.posexplode(F.split("value", r"(?m)^(?=\s*\[)")).alias("block", "value"))
    rows = sections.select("file", "block", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "text"), F.regexp_extract("value", r"^\s*\[([^\]\r\n]*)\]", 1).alias("section"))
    rows = rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", ";.*$", ""), r"^\s+|\s+$", ""))
    pair = F.regexp_extract("text", r"^([^=\[]+?)\s*=", 1)
    return rows.filter(pair != "").select("file", (F.col("block") * 1_000_000 + F.col("line")).alias("line"), "section", pair.alias("key"), F.regexp_extract("text", r"=\s*(.*)$", 1).alias("value"))


def merged(file_options: DataFrame, registered: DataFrame) -> DataFrame:
    """section, key, value: those of the registered options (section, key, value) where there is one, else those of the file; options of either side stay."""
    both = file_options.select("section", "key", F.col("value").alias("old")).join(registered.select("section", "key", F.col("value").alias("new")), ["section", "key"], "full")
    return both.select("section", "key", F.coalesce("new", "old").alias("value"))


def rewritten(lines: DataFrame, registered: DataFrame) -> DataFrame:
    """Lines of files (section, place, line) with the values of registered options (section, key, value) put in: comments, order and other options stay as they are; registered options that no line has come at the end (place is null)."""
    keyed = lines.withColumn("key", F.regexp_extract("line", r"^\s*([^=;\[]+?)\s*=", 1))
    # comments and other lines without a key, of which a section has many, would meet in one task of a join
    plain, keyed = keyed.filter("coalesce(key, '') = ''").select("section", "place", "line"), keyed.filter("key <> ''")
    new = registered.select("section", "key", F.col("value").alias("new"))
    kept = keyed.join(new, ["section", "key"], "left").select("section", "place", F.coalesce(F.concat("key", F.lit("="), "new"), "line").alias("line"))
    missing = new.join(keyed.select("section", "key"), ["section", "key"], "left_anti")
    return plain.unionByName(kept).unionByName(missing.select("section", F.lit(None).cast("long").alias("place"), F.concat("key", F.lit("="), "new").alias("line")))


def write_options(lines: DataFrame, path: str) -> None:
    """A folder for each section of lines (section, place, line), with its head, then the lines in order, those without a place at the end.

    A section is one file, or, if it has more lines than about SPREAD_ROWS, several: one goes on in the next by the numbers in their names, and the first has the head.
    """
    rows = written(lines.select("section", F.col("place").cast("long").alias("place"), "line", F.lit(False).alias("head")), "lines")
    heads = rows.select("section").distinct().select("section", F.lit(None).cast("long").alias("place"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"), F.lit(True).alias("head"))
    both = rows.unionByName(heads)
    order = [F.col("section"), F.col("head").desc(), F.asc_nulls_last("place"), F.col("line")]
    dealt = both.repartitionByRange(max(1, -(-both.count() // SPREAD_ROWS)), *order).sortWithinPartitions(*order)
    dealt.select("section", F.col("line").alias("value")).write.partitionBy("section").text(path)
    discard(rows)


def read_with_comments(spark: SparkSession, path: str) -> DataFrame:
    """section, key, value, comment (the comment line right before it, or null) of the files that write_options() wrote. The line before a file's first one is the last of the file that it goes on from."""
    file = F.col("_metadata.file_path")
    number = [F.regexp_extract(file, pattern, 1).try_cast("long").alias(name) for pattern, name in ((r"/part-([0-9]+)[^/]*$", "task"), (r"\.c([0-9]+)\.[^/]*$", "more"))]
    lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    whole = spark.read.text(path, wholetext=True).select(file.alias("file"), F.col("section").cast("string").alias("section"), *number, lines.alias("lines"))
    # a row for each file, so a window is as large as the number of a section's files
    ends = whole.select("file", "section", "task", "more", F.element_at("lines", -1).alias("last"))
    ends = ends.filter("task is not null").select("file", F.lag("last").over(W.partitionBy("section").orderBy("task", "more")).alias("earlier"))
    whole = whole.join(F.broadcast(ends), "file", "left")
    rows = whole.select("section", "lines", "earlier", F.posexplode("lines").alias("k", "line"))
    before = F.when(F.col("k") > 0, F.get("lines", F.col("k") - 1)).otherwise(F.col("earlier"))
    pair = F.regexp_extract("line", r"^\s*([^=;\[]+?)\s*=", 1)
    return rows.filter(pair != "").select("section", pair.alias("key"), F.regexp_extract("line", r"=\s*(.*)$", 1).alias("value"), F.when(before.startswith(";"), before).alias("comment"))
