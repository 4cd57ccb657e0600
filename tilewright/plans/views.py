"""Derived views that stand for slides, annotations and requests: each as a DataFrame, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What puts the vertices of an outline in order.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "x", "l_extendedprice")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, ord, n, x, y: an order's lines are the vertices of one outline, which is small."""
    own = W.partitionBy("ann_id")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ann_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), "l_extendedprice")
    ordered = own.orderBy(*ORDER)
    return line.select("ann_id", F.row_number().over(ordered).alias("ord"), F.count("*").over(own).alias("n"), "x", (F.col("l_extendedprice") / 1000.0).alias("y"))


def loose_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, x, y and ORDER: the same vertices, for those who put them in order themselves."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("ann_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), "l_extendedprice", (F.col("l_extendedprice") / 1000.0).alias("y"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ann_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("f0"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(spark, sf_dir).select("grp").distinct().withColumn("hidden", F.col("grp").startswith("5-"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("viewer"), "ts", "event_id", ((F.col("event_id") * 7) % 64).cast("double").alias("cam_x"), (F.col("value") / 4.0).alias("cam_y"),
        (F.col("event_id") % 5).cast("int").alias("zoom"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of five levels that hold vertices: level, tile_x, tile_y, n_points; sides are 4 by 8 at level 0 and double with each level."""
    v = vertices(spark, sf_dir).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    return v.groupBy("level", F.floor(F.col("x") / (4 * side)).alias("tile_x"), F.floor(F.col("y") / (8 * side)).alias("tile_y")).agg(F.count("*").alias("n_points"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, px: 8 x 8 values, row by row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") + 0.5).alias("px"))


# The same views for the oracle.
SQL = {
    "vtx": "vtx as (select l_orderkey as ann_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as ord, count(*) over (partition by l_orderkey) as n, l_quantity as x, l_extendedprice / 1000.0 as y from lineitem)",
    "ann": "ann as (select o_orderkey as ann_id, o_orderpriority as grp, o_orderstatus as status, o_totalprice as f0 from orders)",
    "grp": "grp as (select distinct o_orderpriority as grp, o_orderpriority like '5-%' as hidden from orders)",
    "req": "req as (select user_id as viewer, ts, event_id, cast((event_id * 7) % 64 as double) as cam_x, value / 4.0 as cam_y, cast(event_id % 5 as int) as zoom, event_type as kind, cast(json_extract_string(props, '$.k') as int) as k from events)",
    "tile": "tile as (select level, cast(floor(x / (4 * pow(2.0, level))) as bigint) as tile_x, cast(floor(y / (8 * pow(2.0, level))) as bigint) as tile_y, count(*) as n_points from vtx, range(5) t(level) group by all)",
    "patch": "patch as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double) + 0.5) as px from embeddings)",
    "box": "box as (select ann_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as n from vtx group by ann_id)",
    "edge": "edge as (select ann_id, ord, n, x, y, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from vtx window w as (partition by ann_id order by ord rows between unbounded preceding and unbounded following))",
}


def sql(*views: str, then: str) -> str:
    """The SQL of a query over the named views."""
    return "with " + ", ".join(SQL[v] for v in views) + " " + then
