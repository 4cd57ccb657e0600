"""Edits and triangles of odd outlines, against the SQL of their queries."""

from pyspark.sql import functions as F

from tilewright.operators import edits


def _query(spark, tmp_path, name, lines):
    import duckdb

    import __spark_entry__

    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def test_lines_that_end_where_they_begin(spark, tmp_path):
    """The query keeps all points, as its SQL does; the operator leaves out a last point on the first unless it is told not to."""
    want = _query(spark, tmp_path, "lines_and_polygons", [(2, k, 1, k, x, y) for k, (x, y) in enumerate([(1.0, 1000.0), (9.0, 1000.0), (9.0, 5000.0), (4.0, 7000.0), (1.0, 1004.0)])])
    assert want[0][1:3] == ("polygon", 5)
    ring = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.001)],)], "ring array<struct<x: double, y: double>>")
    sizes = [F.size(edits.as_polygon(F.col("ring"), F.lit("line"), **more)[1]) for more in ({}, {"closing": 0.0})]
    assert tuple(ring.select(*sizes).first()) == (3, 4)


def test_outlines_with_repeated_points_and_on_one_line(spark, tmp_path):
    outlines = {
        1: [(9.0, 26042.9), (6.0, 90792.46), (4.0, 54411.07), (10.0, 3221.7), (19.0, 60947.09), (38.0, 16815.57), (38.0, 16815.57)],
        2: [(36.0, 11017.76), (36.0, 29073.37), (36.0, 59115.86), (36.0, 85445.13)],
        3: [(7.0, 13339.65), (46.0, 1007.81), (46.0, 1007.81), (4.0, 24895.27)],
        4: [(5.0, 5.0)] * 5,
    }
    want = _query(spark, tmp_path, "star_triangulation", [(a, k, 1, k, x, y) for a, ring in outlines.items() for k, (x, y) in enumerate(ring)])
    assert {r[0]: r[1] for r in want} == {1: 5, 2: 2, 3: 2, 4: 3}
