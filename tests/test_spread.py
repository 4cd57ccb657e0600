"""Work that is spread over tasks, files that are opened once, and values that are worked out once."""

from pyspark.sql import functions as F

from tilewright.operators.grid import fragment_overlap
from tilewright.session import spread
from tilewright.sources import annotations, files


def test_fragments_on_all_places_need_no_shuffle(spark):
    cameras = spark.createDataFrame([(i, 0.5 * i, 1.0, 0.5 * i + 9.0, 20.0) for i in range(12)], "camera long, x0 double, y0 double, x1 double, y1 double")
    rows = fragment_overlap(cameras, None, 3, 2, 4.0, 8.0)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    tiles = spark.createDataFrame([(x, y) for x in range(9) for y in range(9)], "tile_x long, tile_y long")
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r[c] for c in rows.columns) for r in fragment_overlap(cameras, tiles, 3, 2, 4.0, 8.0).collect())


def test_rows_of_one_split_go_to_several_tasks(spark):
    assert spread(spark.range(0, 45_000, 1, 1)).rdd.getNumPartitions() == 3 and spread(spark.range(0)).count() == 0


def test_values_are_worked_out_once(spark):
    once = annotations._once(F.uuid(), lambda v: F.struct(v.alias("a"), v.alias("b")))
    assert spark.range(9).select(once.alias("s")).filter("s.a = s.b").count() == 9


def test_several_places_of_one_file(spark, tmp_path):
    for name in ("a", "bb.x", "ccc"):
        (tmp_path / name).write_bytes(name.encode() + b"0123456789")
    at = files.listing(spark, str(tmp_path)).select("path", "name", F.explode(F.sequence(F.lit(-1), F.lit(3))).alias("k"))
    got = files.read_at(at, F.length("name") + F.when(F.col("k") >= 0, F.col("k")), F.lit(2)).collect()
    assert len(got) == 15 and all(r["bytes"] == (None if r["k"] < 0 else b"0123456789"[r["k"] : r["k"] + 2]) for r in got)
    files._SYSTEMS.clear()
    for _ in range(3):
        with files.opened(f"file:{tmp_path}/a") as f:
            assert f.size() == 11
    assert len(files._SYSTEMS) == 1
