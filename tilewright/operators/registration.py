"""Raster kernels that arrays of columns can't express well: phase correlation, Lanczos resampling, triangulation. They run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(column: pa.Array, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of width x height values as one stack, and which rows have it; others, and those with a null in them, aren't in the stack."""
    lists = column.cast(pa.list_(pa.float64()))
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width * height), False).to_numpy(zero_copy_only=False)
    values = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)
    whole = ~np.isnan(values).any(axis=(1, 2))
    fits[np.flatnonzero(fits)] = whole
    return values[whole], fits


def shifts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By how many rows and columns each image of a stack is shifted against its partner, cyclically, and the height of the peak of the cross-power spectrum."""
    cross = np.fft.rfft2(a) * np.conj(np.fft.rfft2(b))
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape[1:]).reshape(len(a), -1)
    h, w = a.shape[1:]
    best = peak.argmax(axis=1) if len(a) else np.zeros(0, np.int64)
    y, x = best // w, best % w
    return np.where(y > h // 2, y - h, y), np.where(x > w // 2, x - w, x), peak[np.arange(len(a)), best]


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """The shift of one pair."""
    dy, dx, peak = shifts(a[None], b[None])
    return int(dy[0]), int(dx[0]), float(peak[0])


def register_pairs(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """pairs (pair_id, a, b: row-major arrays of width x height values): pair_id, dy, dx, peak. Arrays of another size, or null, give nulls. A batch is transformed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [stacked(batch.column(c), width, height) for c in ("a", "b")]
            fits = both[0][1] & both[1][1]
            a, b = (values[fits[own]] for values, own in both)
            out = [np.zeros(len(batch)) for _ in range(3)]
            for column, found in zip(out, shifts(a, b), strict=True):
                column[fits] = found
            dy, dx, peak = (pa.array(c, t, mask=~fits) for c, t in zip((out[0].astype(np.int32), out[1].astype(np.int32), out[2]), (pa.int32(), pa.int32(), pa.float64()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), dy, dx, peak], ["pair_id", "dy", "dx", "peak"])

    return pairs.select("pair_id", "a", "b").mapInArrow(run, "pair_id long, dy int, dx int, peak double")


def register_physical(pairs: DataFrame, width: int, height: int, limit: int) -> DataFrame:
    """pairs (pair_id, a, b, mpp_x, mpp_y) of one resolution: pair_id, x_um, y_um, peak; the translation in micrometres, null where it couldn't be found or is over the limit of pixels in either direction.

    A shift of half the size comes out on either side, and counts as towards the start.
    """
    found = register_pairs(pairs, width, height)
    turned = lambda c, n: F.when(F.col(c) >= n // 2, F.col(c) - n).otherwise(F.col(c))
    near = (F.abs(turned("dx", width)) <= limit) & (F.abs(turned("dy", height)) <= limit)
    rows = found.join(pairs.select("pair_id", "mpp_x", "mpp_y"), "pair_id")
    return rows.select("pair_id", F.when(near, turned("dx", width) * F.col("mpp_x")).alias("x_um"), F.when(near, turned("dy", height) * F.col("mpp_y")).alias("y_um"), "peak")


def _lifted(c: np.ndarray) -> np.ndarray:
    """Rows of low and then high coefficients (last axis) back to samples."""
    n = c.shape[-1] // 2
    low, high = c[..., :n], c[..., n:]
    even = low - ((np.concatenate((high[..., :1], high[..., :-1]), axis=-1) + high + 2) >> 2)
    odd = high + ((even + np.concatenate((even[..., 1:], even[..., -1:]), axis=-1)) >> 1)
    return np.stack((even, odd), axis=-1).reshape(c.shape)


def inverse_wavelet(patches: DataFrame, width: int, height: int) -> DataFrame:
    """patches (vec_id, px: coefficients in four quadrants) as samples, by integer lifting of rows and then columns with mirrored edges; sides are even. Null for arrays of another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, fits = stacked(batch.column("px"), width, height)
            rows = _lifted(values.astype(np.int64))
            done = _lifted(rows.transpose(0, 2, 1)).transpose(0, 2, 1).reshape(len(rows), -1)
            out: list = [None] * len(batch)
            for k, r in zip(np.flatnonzero(fits).tolist(), done, strict=True):
                out[k] = r
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.list_(pa.int64()))], ["vec_id", "px"])

    return patches.select("vec_id", "px").mapInArrow(run, "vec_id long, px array<long>")


def lanczos_weights(size: int, new_size: int, lobes: int = 3) -> np.ndarray:
    """Weights (new_size x size) of a Lanczos resampling of a row; each row sums to one. Shrinking widens the kernel."""
    scale = max(1.0, size / new_size)
    centre = (np.arange(new_size) + 0.5) * size / new_size
    t = (np.arange(size) + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resample(patches: DataFrame, width: int, height: int, new_width: int, new_height: int, most: float = 255.0) -> DataFrame:
    """patches (id, px) at another size by two passes of Lanczos weights, clipped to 0..most; null for arrays of another size."""
    across, down = lanczos_weights(width, new_width), lanczos_weights(height, new_height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, fits = stacked(batch.column("px"), width, height)
            done = np.clip(down @ values @ across.T, 0, most).reshape(len(values), -1)
            rows: list = [None] * len(batch)
            for k, r in zip(np.flatnonzero(fits).tolist(), done, strict=True):
                rows[k] = r
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "px"])

    return patches.select("id", "px").mapInArrow(run, "id long, px array<double>")


def triangles(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]] | None:
    """Corner numbers of the triangles of a simple ring, cut ear by ear; null for fewer than three points or a ring without ears. Where no ear is free of other points, a point on the line of its neighbours (a repeated
    one, too) goes first, as a triangle without area, then an ear that others only touch; so there are always two triangles less than points, of the ring's area in all."""
    n = len(ring)
    if n < 3:
        return None
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    left = list(range(n)) if sum(ring[i][0] * ring[(i + 1) % n][1] - ring[i][1] * ring[(i + 1) % n][0] for i in range(n)) >= 0 else list(range(n))[::-1]
    # products of coordinates are right to about this much
    flat = 1e-14 * (1 + max(abs(p[0]) for p in ring)) * (1 + max(abs(p[1]) for p in ring))

    def within(i: int, j: int, m: int) -> float:
        """How far inside of a triangle another point is: negative if none is inside or on it, about 0 if one is on it."""
        a, b, c = ring[i], ring[j], ring[m]
        return max(min(cross(a, b, ring[p]), cross(b, c, ring[p]), cross(c, a, ring[p])) for p in left if p not in (i, j, m))

    ear = lambda i, j, m: cross(ring[i], ring[j], ring[m]) > 0 and within(i, j, m) < 0
    on_line = lambda i, j, m: abs(cross(ring[i], ring[j], ring[m])) <= flat
    touched = lambda i, j, m: cross(ring[i], ring[j], ring[m]) > 0 and within(i, j, m) <= flat
    out = []
    while len(left) > 3:
        corners = [(left[k - 1], left[k], left[(k + 1) % len(left)]) for k in range(len(left))]
        k = next((k for test in (ear, on_line, touched) for k, c in enumerate(corners) if test(*c)), None)
        if k is None:
            return None
        out.append(corners[k])
        del left[k]
    return [*out, (left[0], left[1], left[2])]


def triangulate(rings: DataFrame) -> DataFrame:
    """rings (ann_id, ring): ann_id, ring and triangles (array of corner numbers), null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if r is None or (t := triangles([(p["x"], p["y"]) for p in r])) is None else [list(x) for x in t] for r in batch.column("ring").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("ann_id"), batch.column("ring"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["ann_id", "ring", "triangles"])

    return rings.select("ann_id", "ring").mapInArrow(run, "ann_id long, ring array<struct<x: double, y: double>>, triangles array<array<int>>")
