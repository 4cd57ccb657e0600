"""Functions and operators on stated values, and properties on random ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import text as T
from tilewright.operators import grid, pyramid, registration, rings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(v):
    return F.lit(v)


def test_stated_geometry(spark):
    start, size = G.canonical_interval(lit(10), lit(-3))
    p0, p1 = G.pixel_range(lit(20.0), lit(60.0), lit(2.0))
    t0, t1 = G.tile_range(lit(511.0), lit(512.0), lit(512.0))
    u0, u1 = G.tile_range(lit(0.0), lit(512.0), lit(512.0))
    share = G.segment_share(lit(15.0), lit(4.0), lit(0.0), lit(0.0), lit(10.0), lit(0.0))
    assert tuple(one(spark, start, size, p0, p1, t0, t1, u0, u1, share)) == (7, 3, 10, 30, 0, 2, 0, 2, 1.0)
    assert one(spark, G.segment_share(lit(1.0), lit(1.0), lit(2.0), lit(2.0), lit(2.0), lit(2.0)))[0] == 0.0
    assert tuple(one(spark, *[G.scale_bar(lit(x)) for x in (1.0, 4.9, 7.0, 99.0, 0.03)])) == (1.0, 2.0, 5.0, 50.0, pytest.approx(0.02))


def test_stated_texts(spark):
    names = ["test.tiff", r"C:\slides\case.name\slide.isyntax", "/tmp/archive/file", "/tmp/archive.with.dots/file"]
    assert list(one(spark, *[T.extension(lit(n)) for n in names])) == ["tiff", "isyntax", "", ""]
    assert list(one(spark, T.with_extension(lit("slide.tiff"), "xml"), T.with_extension(lit("slide"), "tiff"), T.with_extension(lit("slide.isyntax"), ""))) == ["slide.xml", "slide.tiff", "slide"]
    assert list(one(spark, T.trimmed(lit(" \t slide.isyntax \r\n")), T.trimmed(lit(" \t")), T.trimmed(lit(None).cast("string")))) == ["slide.isyntax", "", None]
    assert one(spark, T.lines(lit("alpha\r\nbeta\ngamma\rdelta")))[0] == ["alpha", "beta", "gamma", "delta"]
    assert list(one(spark, T.hex_channel(lit("#0a10ff"), 2), T.hex_channel(lit("nope"), 0))) == [255, 0]
    assert one(spark, T.percent_encoded(lit("a b+ü")))[0] == "a%20b%2b%c3%bc"
    got = spark.createDataFrame([("a%20b+%zz%C3%BC",), (None,)], "t string").select(T.percent_decoded("t")).collect()
    assert [r[0] for r in got] == ["a b+%zzü", None]
    assert one(spark, T.dicom_integers(lit(" 12\\-3\\x")))[0] == [12, -3, None]
    assert list(one(spark, T.host_allowed(lit("a.b.org"), [".b.org"]), T.host_allowed(lit(".b.org"), [".b.org"]), T.host_allowed(lit("x.org"), ["x.org"]))) == [True, False, True]


def test_grid_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    box = lambda k: (k, x := rng.uniform(-40, 40), y := rng.uniform(-40, 40), x + rng.choice([0, 1, 30]), y + rng.choice([0, 5, 20]))
    a, b = [box(k) for k in range(120)] + [(999, None, 0.0, 1.0, 1.0)], [box(k) for k in range(120)]
    df = grid.overlap_join(spark.createDataFrame(a, "a long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(b, "b long, x0 double, y0 double, x1 double, y1 double"), 7.0, 9.0)
    want = sorted((p[0], q[0]) for p in a[:-1] for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert sorted((r["a"], r["b"]) for r in df.select("a", "b").collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_rings(spark):
    ring = F.array(*[F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    a, b = rings.split(ring, lit(0), lit(2))
    got = one(spark, rings.ring_area(ring), rings.ring_area(F.reverse(ring)), rings.ring_area(a), rings.ring_area(b), F.size(rings.without_closing(F.concat(ring, F.slice(ring, 1, 1)))), F.size(rings.rotated(ring, lit(2))))
    assert tuple(got) == (12.0, -12.0, 6.0, 6.0, 4, 5)


def test_triangles_fill_the_ring():
    rng = random.Random(2)
    area = lambda r: sum(r[i - 1][0] * r[i][1] - r[i - 1][1] * r[i][0] for i in range(len(r))) / 2
    for _ in range(50):
        n = rng.randint(3, 24)
        far = [5 + 4 * rng.random() for _ in range(n)]
        ring = [(r * np.cos(2 * np.pi * k / n), r * np.sin(2 * np.pi * k / n)) for k, r in enumerate(far)]
        ring = ring if rng.random() < 0.5 else ring[::-1]
        t = registration.triangles(ring)
        assert len(t) == n - 2
        assert sum(abs(area([ring[i] for i in x])) for x in t) == pytest.approx(abs(area(ring)))
    assert registration.triangles([(0, 0), (1, 1)]) is None


def test_registration_finds_a_roll():
    a = np.random.default_rng(3).normal(size=(16, 12))
    assert registration.shift_between(a, np.roll(a, (2, 3), (0, 1)))[:2] == (-2, -3)
    assert registration.lanczos_weights(8, 5).sum(axis=1) == pytest.approx(np.ones(5))


def test_prerequisites_hold_all_ancestors(spark):
    tiles = spark.createDataFrame([(0, 5, 3), (0, 4, 2), (1, 0, 0)], "level int, tile_x long, tile_y long")
    got = {tuple(r) for r in pyramid.prerequisites(tiles, 2).collect()}
    assert got == {(0, 5, 3), (0, 4, 2), (1, 2, 1), (2, 1, 0), (1, 0, 0), (2, 0, 0)}
