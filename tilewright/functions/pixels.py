"""Pixel values over columns: colours as channels, small patches as row-major arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def luminance(r: Column, g: Column, b: Column) -> Column:
    """A quarter red, half green, a quarter blue."""
    return r / 4 + g / 2 + b / 4


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 360), saturation and value (0 to 100) of channels from 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    safe = F.when(span == 0, F.lit(1.0)).otherwise(span)
    sector = F.when(high == r, (g - b) / safe).when(high == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    hue = F.when(span == 0, F.lit(0.0)).otherwise(F.when(sector < 0, sector + 6).otherwise(sector) * 60)
    return hue, F.when(high == 0, F.lit(0.0)).otherwise(span / F.when(high == 0, F.lit(1.0)).otherwise(high) * 100), high * 100


def levels(value: Column, black: float, white: float) -> Column:
    """Black and white levels of a value from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - black) / (1 - black)) / white)


def ycocg_to_rgb(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    """Integer channels by lifting; halves are cut towards zero, and the upper end is clamped."""
    half = lambda c: F.when(c < 0, -F.floor(-c / 2)).otherwise(F.floor(c / 2))
    low = y - half(cg)
    b = low - half(co)
    top = F.lit(255)
    return F.least(b + co, top), F.least(cg + low, top), F.least(b, top)


def at(px: Column, x: Column, y: Column, width: int) -> Column:
    return F.element_at(px, (y * width + x + 1).cast("int"))


def shrunk(px: Column, width: int, height: int) -> Column:
    """Means of 2 x 2 blocks of a patch with even sides."""
    block = lambda i: [at(px, (i % (width // 2)) * 2 + dx, F.floor(i / (width // 2)) * 2 + dy, width) for dy in (0, 1) for dx in (0, 1)]
    return F.transform(F.sequence(F.lit(0), F.lit(width * height // 4 - 1)), lambda i: sum(block(i)[1:], block(i)[0]) / 4)


def bilinear(px: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """The patch at another size, with half-pixel centres and clamped edges."""

    def value(i: Column) -> Column:
        taps = []
        for k, n, m in ((i % new_width, width, new_width), (F.floor(i / new_width), height, new_height)):
            place = (k + 0.5) * n / m - 0.5
            low = F.floor(place)
            clamp = lambda v, n=n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
            taps.append((clamp(low), clamp(low + 1), place - low))
        (x0, x1, fx), (y0, y1, fy) = taps
        top = at(px, x0, y0, width) * (1 - fx) + at(px, x1, y0, width) * fx
        return top * (1 - fy) + (at(px, x0, y1, width) * (1 - fx) + at(px, x1, y1, width) * fx) * fy

    return F.transform(F.sequence(F.lit(0), F.lit(new_width * new_height - 1)), value)


def running_bytes(px: Column) -> Column:
    """Differences along a row turned back to values modulo 256."""
    sums = F.aggregate(px, F.array().cast("array<long>"), lambda out, v: F.array_append(out, F.pmod(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + v, F.lit(256))))
    return sums


def shrunk_bytes(px: Column, width: int, height: int) -> Column:
    """Means of 2 x 2 blocks of bytes, halves upwards."""
    block = lambda i: [at(px, (i % (width // 2)) * 2 + dx, F.floor(i / (width // 2)) * 2 + dy, width) for dy in (0, 1) for dx in (0, 1)]
    return F.transform(F.sequence(F.lit(0), F.lit(width * height // 4 - 1)), lambda i: F.shiftright(sum(block(i)[1:], block(i)[0]) + 2, 2))


def packed(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four bytes as one number, the first highest."""
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(b.cast("long"), 16)).bitwiseOR(F.shiftleft(c.cast("long"), 8)).bitwiseOR(d.cast("long"))


def swizzled(pixel: Column) -> Column:
    """The first and third byte of a packed pixel changed places."""
    byte = lambda k: F.shiftrightunsigned(pixel, k).bitwiseAND(F.lit(0xFF))
    return packed(byte(8), byte(16), byte(24), byte(0))


#: Bits behind the point of a weight of whole numbers.
WEIGHT_BITS = 22


def lanczos_taps(size: int, low: float, high: float, new_size: int, lobes: int = 3) -> list[tuple[int, list[int]]]:
    """Of each new sample of the box low..high of a row the first sample that counts, and the weights from there on in whole numbers; a row's weights sum to about one. Shrinking widens the kernel."""
    step = (high - low) / new_size
    scale = max(step, 1.0)
    out = []
    for o in range(new_size):
        centre = low + (o + 0.5) * step
        first, last = max(0, int(centre - lobes * scale + 0.5)), min(size, int(centre + lobes * scale + 0.5))
        t = (np.arange(first, last) - centre + 0.5) / scale
        weights = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
        weights = weights / weights.sum() * (1 << WEIGHT_BITS)
        out.append((first, np.trunc(weights + np.where(weights < 0, -0.5, 0.5)).astype(int).tolist()))
    return out


def lanczos_bytes(px: Column, width: int, height: int, box: tuple[float, float, float, float], new_width: int, new_height: int) -> Column:
    """A box (x0, y0, x1, y1) of a patch of bytes at another size: rows, then columns, each rounded and clipped to a byte. The weights are worked out once."""

    def value(source: Column, places: list[int], weights: list[int]) -> Column:
        total = F.lit(1 << WEIGHT_BITS - 1).cast("long")
        for p, w in zip(places, weights, strict=True):
            total = total + F.element_at(source, p + 1) * F.lit(w).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), F.shiftright(total, WEIGHT_BITS)))

    across, down = lanczos_taps(width, box[0], box[2], new_width), lanczos_taps(height, box[1], box[3], new_height)
    rows = F.array(*[value(px, [y * width + first + k for k in range(len(w))], w) for y in range(height) for first, w in across])
    # named once, so that the second pass doesn't repeat the first
    return F.get(F.transform(F.array(rows), lambda r: F.array(*[value(r, [(first + k) * new_width + x for k in range(len(w))], w) for first, w in down for x in range(new_width)])), 0)


def stain_signal(hue: Column, value: Column, background: float) -> Column:
    """The value where the hue is that of the blue stain, else the background."""
    return F.when((hue > 90) & (hue < 235), value).otherwise(background)


def opacity(r: Column, g: Column, b: Column, clear: tuple[float, float, float], tolerance: float) -> Column:
    """How opaque a colour is that is transparent near a stated one (squared distance under the tolerance)."""
    far = (clear[0] - r) ** 2 + (clear[1] - g) ** 2 + (clear[2] - b) ** 2
    return F.when(far < tolerance, F.greatest(F.lit(0.0), far / tolerance * 1.2 - 0.2)).otherwise(1.0)


def stretched(value: Column, black: float, white: float) -> Column:
    return (value - black) / (white - black)


def over(value: Column, opacity_: Column, background: float) -> Column:
    return opacity_ * value + (1 - opacity_) * background


def two_peaks(px: Column, width: int) -> Column:
    """highest, x, y, second, second_x, second_y of a row-major array with values over 0: the second is the highest that was met more than four steps (across and down) from the highest so far."""
    zero = lambda t: F.lit(0).cast(t)
    names = ("highest", "x", "y", "second", "second_x", "second_y")
    start = F.struct(*[zero("long" if k in (0, 3) else "int").alias(n) for k, n in enumerate(names)])

    def step(s: Column, i: Column) -> Column:
        v, x, y = F.element_at(px, i + 1), (i % width).cast("int"), F.floor(i / width).cast("int")
        far = F.abs(s["x"] - x) + F.abs(s["y"] - y) > 4
        after = lambda *c: F.struct(*[a.alias(n) for a, n in zip(c, names, strict=True)])
        own = [s[n] for n in names]
        passed = [F.when(far, own[k]).otherwise(own[k + 3]) for k in range(3)]
        return F.when(v > own[0], after(v, x, y, *passed)).when((v > own[3]) & far, after(*own[:3], v, x, y)).otherwise(after(*own))

    return F.aggregate(F.sequence(F.lit(0), F.size(px) - 1), start, step)
