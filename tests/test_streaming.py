"""Streams run to the end of their input, against their batch twins."""

import pytest

from tilewright.operators import pyramid
from tilewright.streaming import requests

EVENTS = [(k % 3, f"2024-01-01 00:00:{k:02d}", k, float(k // 4 % 2), 0.0, 0, k % 2, 0) for k in range(0, 60, 3)] + [(1, "2024-01-01 00:10:00", 100, 1.0, 0.0, 0, 0, 0)]
SCHEMA = "viewer long, ts string, event_id long, cam_x double, cam_y double, zoom int, tile_x int, tile_y int"


@pytest.fixture()
def tables(spark, tmp_path):
    batch = spark.createDataFrame(EVENTS, SCHEMA).selectExpr("viewer", "cast(ts as timestamp) as ts", "event_id", "cam_x", "cam_y", "zoom", "tile_x", "tile_y")
    for k, part in enumerate((batch.filter("event_id < 30"), batch.filter("event_id >= 30"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del k
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path)


def run(spark, df, where, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_generations(spark, tables):
    batch, stream, where = tables
    got = {(r["viewer"], r["event_id"]): r["generation"] for r in run(spark, requests.generations(stream), where, "generations").collect()}
    want = {(r["viewer"], r["event_id"]): r["generation"] for r in pyramid.generations(batch).collect()}
    assert got == want


def test_saves(spark, tables):
    batch, stream, where = tables
    got = sorted(map(tuple, run(spark, requests.saves(stream, "5 seconds"), where, "saves", "complete").collect()))
    want = sorted((r["viewer"], r["first_ts"], r["last_ts"], r["n"]) for r in pyramid.sessions(batch, 5).collect())
    assert got == want


def test_distinct_requests(spark, tables):
    batch, stream, where = tables
    got = run(spark, requests.distinct_requests(stream), where, "once").count()
    assert got == batch.select("viewer", "zoom", "tile_x", "tile_y").distinct().count()
