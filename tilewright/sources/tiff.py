"""TIFF and BigTIFF files: one row for each directory, and tiles read by byte range.

Tasks open the files and read at places, so that files of any size cost what their directories take. Pixel data isn't read with them: each row has the offsets and byte counts of its tiles, so that
tiles can be pruned before any is read with read_tiles().
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import files

# Tag numbers, and the struct codes and sizes of field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 277: "samples", 282: "x_resolution", 283: "y_resolution", 296: "resolution_unit", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "byte_counts"}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}

DIRECTORIES = "path string, directory int, width long, height long, tile_width int, tile_height int, width_tiles int, height_tiles int, samples int, compression int, mpp_x double, mpp_y double, description string, offsets array<long>, byte_counts array<long>"


def directories(read: Callable[[int, int], bytes]) -> Iterator[dict]:
    """The directories of a file (read gives so many bytes at a place) as dictionaries of tag names to values; stops at a loop."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None:
        raise ValueError("not a TIFF file")

    def unpacked(code: str, at: int) -> tuple:
        return struct.unpack(order + code, read(at, struct.calcsize(order + code)))

    magic = unpacked("H", 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    word, size, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    at = unpacked(word, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        count = unpacked("Q" if big else "H", at)[0]
        at += 8 if big else 2
        found = {}
        for k in range(count):
            tag, kind, n = unpacked("HH" + word, at + k * entry)
            if tag not in TAGS or kind not in TYPES:
                continue
            code, width = TYPES[kind]
            place = at + k * entry + (12 if big else 8)
            if n * width > size:
                place = unpacked(word, place)[0]
            if kind == 2:
                found[TAGS[tag]] = read(place, n).split(b"\0")[0].decode("latin-1")
            elif len(code) == 2:
                pairs = unpacked(code * n, place)
                found[TAGS[tag]] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            else:
                found[TAGS[tag]] = list(unpacked(f"{n}{code}", place))
        yield found
        at = unpacked(word, at + count * entry)[0]


def resolution(per_unit: float, unit: int) -> float:
    """Micrometres a pixel; a quarter where the file says nothing usable. Only centimetres are understood."""
    return 10000 / per_unit if unit == 3 and per_unit > 0 else 0.25


def _row(path: str, number: int, found: dict) -> dict:
    one = lambda name, default: (found.get(name) or [default])[0]
    width, height = one("width", 0), one("height", 0)
    tile_width, tile_height = one("tile_width", 0), one("tile_height", 0)
    unit = one("resolution_unit", 2)
    return {
        "path": path, "directory": number, "width": width, "height": height, "tile_width": tile_width, "tile_height": tile_height,
        "width_tiles": -(-width // tile_width) if tile_width else 0, "height_tiles": -(-height // tile_height) if tile_height else 0,
        "samples": one("samples", 1), "compression": one("compression", 1), "mpp_x": resolution(one("x_resolution", 0), unit), "mpp_y": resolution(one("y_resolution", 0), unit),
        "description": found.get("description"), "offsets": found.get("offsets", []), "byte_counts": found.get("byte_counts", []),
    }


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """DIRECTORIES of all files of a path. Files that aren't TIFF have one row with a null directory."""
    from pyspark.sql.types import StructType

    names = [x.split()[0] for x in DIRECTORIES.split(", ")]
    schema = pa.schema([("path", pa.string()), ("directory", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), *[(n, pa.int32()) for n in names[4:10]], ("mpp_x", pa.float64()), ("mpp_y", pa.float64()), ("description", pa.string()), ("offsets", pa.list_(pa.int64())), ("byte_counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    with files.opened(name) as f:
                        rows = [_row(name, k, d) for k, d in enumerate(directories(files.Blocks(f)))]
                except (OSError, ValueError, struct.error):
                    rows = [dict.fromkeys(names) | {"path": name}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.listing(spark, path).select("path").mapInArrow(run, StructType.fromDDL(DIRECTORIES))


def read_tiles(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (path, directory, tile_index): with data, the tile's bytes; null for tiles that are empty (offset or count of 0) or aren't there."""
    known = read_directories(spark, path).select("path", "directory", F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("tile_index", "t"))
    rows = wanted.join(known, ["path", "directory", "tile_index"], "left")
    there = (F.col("t.offsets") > 0) & (F.col("t.byte_counts") > 0)
    rows = rows.select("path", "directory", "tile_index", F.when(there, F.col("t.offsets")).alias("at"), F.when(there, F.col("t.byte_counts")).alias("n"))
    return files.read_at(rows, F.col("at"), F.col("n")).select("path", "directory", "tile_index", F.col("bytes").alias("data"))


def bigtiff(levels: list[tuple[np.ndarray, int]], mpp: float) -> bytes:
    """A small BigTIFF of uncompressed grey 8-bit tiles: one directory for each (pixels, tile side)."""
    body, heads = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0)), []
    for pixels, side in levels:
        h, w = pixels.shape
        down, across = -(-h // side), -(-w // side)
        padded = np.zeros((down * side, across * side), np.uint8)
        padded[:h, :w] = pixels
        offsets = []
        for y in range(down):
            for x in range(across):
                offsets.append(len(body))
                body += padded[y * side : (y + 1) * side, x * side : (x + 1) * side].tobytes()
        heads.append((w, h, side, offsets))
    previous = 8
    for w, h, side, offsets in heads:
        n = len(offsets)
        lists = []
        for values in (offsets, [side * side] * n):
            lists.append(values[0] if n == 1 else len(body))
            if n > 1:
                body += struct.pack(f"<{n}Q", *values)
        ratio = struct.unpack("<Q", struct.pack("<II", round(10000 / mpp * 1000), 1000))[0]
        entries = [(256, 16, 1, w), (257, 16, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (277, 3, 1, 1), (282, 5, 1, ratio), (283, 5, 1, ratio), (296, 3, 1, 3), (322, 16, 1, side), (323, 16, 1, side), (324, 16, n, lists[0]), (325, 16, n, lists[1])]
        struct.pack_into("<Q", body, previous, len(body))
        body += struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries)
        previous = len(body)
        body += struct.pack("<Q", 0)
    return bytes(body)


def bigtiffs(images: DataFrame, width: int, side: int, mpp: float) -> DataFrame:
    """name, content: a small BigTIFF for each row (name, px: bytes of a square image, row by row), with tiles of the side and a second level of half the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for px in batch.column("px").to_pylist():
                whole = np.array(px, np.int64).reshape(width, width)
                half = (whole[::2, ::2] + whole[::2, 1::2] + whole[1::2, ::2] + whole[1::2, 1::2] + 2) >> 2
                out.append(bigtiff([(whole.astype(np.uint8), side), (half.astype(np.uint8), side)], mpp))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    return images.select("name", "px").mapInArrow(run, "name string, content binary")
