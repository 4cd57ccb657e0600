"""Fragments of camera images on output tiles, against every triple tried."""

import random

from tilewright.operators.grid import fragment_overlap


def test_fragments_against_every_triple(spark):
    rng = random.Random(2)
    cameras = [(i, *(round(rng.uniform(-20, 40), 1) for _ in range(2))) for i in range(30)]
    cameras = [(i, x, y, x + rng.choice([0.0, 3.0, 4.5, 8.0]), y + rng.choice([4.0, 9.25])) for i, x, y in cameras] + [(98, 0.0, 0.0, 12.0, 16.0), (99, None, 1.0, 2.0, 3.0)]
    tiles = [(x, y, 7) for x in range(-6, 12) for y in range(-4, 8) if (x + y) % 3]
    want = {}
    for c, x0, y0, x1, y1 in cameras:
        for i in range(3 if x0 is not None else 0):
            for j in range(2):
                a, b, z, w = x0 + (x1 - x0) / 3 * i, y0 + (y1 - y0) / 2 * j, x0 + (x1 - x0) / 3 * (i + 1), y0 + (y1 - y0) / 2 * (j + 1)
                for tx, ty, _ in tiles:
                    l, t, r, m = max(a, tx * 4.0), max(b, ty * 8.0), min(z, (tx + 1) * 4.0), min(w, (ty + 1) * 8.0)  # noqa: E741
                    if l < r and t < m:
                        want[c, i, j, tx, ty] = (l - tx * 4.0, t - ty * 8.0, l - a, t - b, r - l, m - t)
    df = fragment_overlap(spark.createDataFrame(cameras, "camera long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(tiles + tiles[:3], "tile_x long, tile_y long, n int"), 3, 2, 4.0, 8.0)
    rows = df.collect()
    assert {tuple(r)[:5]: tuple(r)[5:] for r in rows} == want and len(rows) == len(want) > 100
    none = df.sparkSession.createDataFrame([], "camera long, x0 double, y0 double, x1 double, y1 double")
    assert fragment_overlap(none, spark.createDataFrame(tiles, "tile_x long, tile_y long, n int"), 3, 2, 4.0, 8.0).count() == 0
