"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os
import random

import duckdb
import pytest

from tilewright.plans import conversions, edits, formats, kernels, names, outlines, raster, registry, signals, slides, texts, tiling  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.REGISTRY))
def test_query(spark, oracle, name):
    function, sql = registry.REGISTRY[name]
    df = function(spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


def test_searches_of_all_outlines(spark):
    """Every finite point has its nearest segment, and outlines of more than three vertices are found; against all pairs."""
    from tilewright.operators.grid import nearest_segment
    from tilewright.plans import views as V

    rng = random.Random(41)
    segments = [(k, 1, *(rng.uniform(0, 60) for _ in range(4))) for k in range(80)] + [(900, 1, 3.0, 3.0, 3.0, 3.0), (901, 1, None, 1.0, 2.0, 2.0)]
    points = [(k, rng.uniform(-20, 80), rng.uniform(-20, 80)) for k in range(60)] + [(100, 5000.0, -9000.0), (101, None, 1.0), (102, float("nan"), 1.0)]

    def far(px, py, x, y, nx, ny):
        d = (nx - x) ** 2 + (ny - y) ** 2
        t = max(0.0, min(1.0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / d)) if d else 0.0
        return math.hypot(x + t * (nx - x) - px, y + t * (ny - y) - py)

    edges = spark.createDataFrame(segments, "ann_id long, ord int, x double, y double, nx double, ny double")
    got = {r["event_id"]: (r["ann_id"], round(r["dist"], 6)) for r in nearest_segment(spark.createDataFrame(points, "event_id long, px double, py double"), edges).collect()}
    assert got == {p: min((round(far(px, py, *s[2:]), 6), s[0]) for s in segments[:-1])[::-1] for p, px, py in points[:-2]}
    n = V.requests(spark, DATA).filter("event_id % 50 = 0").count()
    near = outlines.nearest_annotation(spark, DATA).join(V.vertices(spark, DATA).select("ann_id", "n").distinct(), "ann_id").collect()
    assert len(near) == n and any(r["n"] > 3 for r in near)
    hits = {r["event_id"]: r["n_hit"] for r in outlines.point_in_bounds(spark, DATA).collect()}
    boxes = [tuple(r) for r in outlines.rings.bounds(V.vertices(spark, DATA), "ann_id").select("x0", "y0", "x1", "y1").collect()]
    for r in V.requests(spark, DATA).filter("event_id % 50 = 0").collect():
        x, y = r["cam_x"], r["cam_y"]
        assert hits[r["event_id"]] == sum(a - 0.5 <= x < c + 0.5 and b - 0.5 <= y < d + 0.5 for a, b, c, d in boxes)


def test_every_row_of_plain_arithmetic(spark):
    from tilewright.plans import views as V

    n = {t: V.table(spark, DATA, t).count() for t in ("orders", "events")}
    assert signals.ellipse_points(spark, DATA).count() == 48 * n["orders"]
    assert tiling.region_cover(spark, DATA).select("event_id").distinct().count() == n["events"]
    assert tiling.prerequisite_closure(spark, DATA).filter("level = 0").count() == V.tiles(spark, DATA).filter("level = 0").count()


def test_entry_without_the_pipeline(monkeypatch):
    """The driver takes corpus_pipeline.py and the llm folders away: everything else must stay."""
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    less = importlib.reload(__spark_entry__)
    assert set(less.queries()) == set(registry.REGISTRY) and set(less.oracle_sql()) <= set(less.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
