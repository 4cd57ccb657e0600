"""Elements of DICOM files as rows: one for each element, with its path of enclosing sequence items; and the places of frames.

Files are read at places: values that no row holds (pixels, other bytes) are stepped over, so files may have any size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import files

# Value representations with a four-byte length, texts, transfer syntaxes, and the tags of items and delimiters.
LONG_VR = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
TEXT_VR = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
NUMBER_VR = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
IMPLICIT, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2"
ITEM, ITEM_END, SEQUENCE_END, PIXELS = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010
UNDEFINED = 0xFFFFFFFF

SCHEMA = "path string, parent string, tag string, vr string, value string, numbers array<double>, offset long, length long"


class Places:
    """An open file with slices and a length, of which small blocks are read where they are asked for."""

    def __init__(self, file) -> None:
        self.blocks = files.Blocks(file)
        self.blocks.SIZE = 1 << 12  # headers of fragments stand far apart

    def __len__(self) -> int:
        return self.blocks.size

    def __getitem__(self, s: slice) -> bytes:
        return self.blocks(s.start, s.stop - s.start)


def _unpack(form: str, data: bytes | Places, at: int) -> tuple:
    if isinstance(data, bytes):
        return struct.unpack_from(form, data, at)
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def elements(data: bytes | Places, at: int, end: int, parent: str, implicit: bool, order: str) -> Iterator[tuple]:
    """(parent, tag, vr, value, numbers, offset, length) of the elements from at to end, those of sequence items after their sequence."""
    items = 0
    while at + 8 <= end:
        group, element = _unpack(order + "HH", data, at)
        tag = group << 16 | element
        if tag in (ITEM, ITEM_END, SEQUENCE_END):
            length = _unpack(order + "I", data, at + 4)[0]
            at += 8
            if tag != ITEM:
                return
            stop = end if length == UNDEFINED else min(end, at + length)
            inner = f"{parent}[{items}]"
            items += 1
            rows = list(elements(data, at, stop, inner, implicit, order))
            yield from rows
            at = stop if length != UNDEFINED else _item_end(data, at, end, implicit, order)
            continue
        if implicit:
            vr, length, head = "UN", _unpack(order + "I", data, at + 4)[0], 8
        else:
            vr = data[at + 4 : at + 6].decode("latin-1")
            long = vr in LONG_VR
            length, head = (_unpack(order + "I", data, at + 8)[0], 12) if long else (_unpack(order + "H", data, at + 6)[0], 8)
        start = at + head
        name = f"{group:04X}{element:04X}"
        nested = vr == "SQ" or length == UNDEFINED and tag != PIXELS
        stop = (_sequence_end(data, start, end, implicit, order) if nested or tag == PIXELS else end) if length == UNDEFINED else min(end, start + length)
        code = NUMBER_VR.get(vr)
        raw = data[start:stop] if code or vr in TEXT_VR else b""
        value = raw.rstrip(b"\0 ").decode("latin-1") if vr in TEXT_VR else None
        numbers = [float(x) for x in struct.unpack(f"{order}{len(raw) // struct.calcsize(code)}{code}", raw[: len(raw) // struct.calcsize(code) * struct.calcsize(code)])] if code else None
        yield parent, name, vr, value, numbers, start, stop - start
        if nested:
            yield from elements(data, start, stop, f"{parent}/{name}" if parent else name, implicit, order)
        at = stop


def _skip(data: bytes | Places, at: int, end: int, implicit: bool, order: str) -> int:
    """The place after the element at a place."""
    vr = "UN" if implicit else data[at + 4 : at + 6].decode("latin-1")
    length, head = (_unpack(order + "I", data, at + (4 if implicit else 8))[0], 8 if implicit else 12) if implicit or vr in LONG_VR else (_unpack(order + "H", data, at + 6)[0], 8)
    return _sequence_end(data, at + head, end, implicit, order) if length == UNDEFINED else at + head + length


def _item_end(data: bytes | Places, at: int, end: int, implicit: bool, order: str) -> int:
    while at + 8 <= end:
        group, element = _unpack(order + "HH", data, at)
        if group << 16 | element == ITEM_END:
            return at + 8
        at = _skip(data, at, end, implicit, order)
    return end


def _heads(data: bytes | Places, order: str):
    """A function of a place that gives the group, element and length of the item there."""
    form = struct.Struct(order + "HHI")
    return partial(form.unpack_from, data) if isinstance(data, bytes) else lambda at: form.unpack(data[at : at + 8])


def _sequence_end(data: bytes | Places, at: int, end: int, implicit: bool, order: str) -> int:
    head = _heads(data, order)
    while at + 8 <= end:
        group, element, length = head(at)
        tag = group << 16 | element
        if tag == SEQUENCE_END:
            return at + 8
        at = _item_end(data, at + 8, end, implicit, order) if length == UNDEFINED else at + 8 + length
    return end


def file_elements(data: bytes | Places) -> list[tuple]:
    """The elements of a file: the meta group in explicit little-endian order, the rest as its transfer syntax says."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at = 132
    while at + 8 <= len(data) and _unpack("<H", data, at)[0] == 2:
        at = _skip(data, at, len(data), False, "<")
    meta = list(elements(data, 132, at, "", False, "<"))
    syntax = next((e[3] for e in meta if e[1] == "00020010"), "")
    return meta + list(elements(data, at, len(data), "", syntax == IMPLICIT, ">" if syntax == BIG else "<"))


def _pieces(data: bytes | Places) -> tuple[np.ndarray | None, np.ndarray]:
    """The frames of a file's fragments (see file_fragments; None where they are null), and the fragments' offsets and lengths."""
    none = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    top = {tag: row for parent, tag, *row in file_elements(data) if parent == ""}
    if f"{PIXELS:08X}" not in top:
        return none
    _, _, _, start, length = top[f"{PIXELS:08X}"]
    frames = top.get("00280008", ("", "1"))[1].strip()
    frames = max(1, int(frames)) if frames.isdigit() else 1
    if _unpack("<I", data, start - 4)[0] != UNDEFINED:
        i, size = np.arange(frames), length // frames
        return i, np.stack([start + i * size, np.full(frames, size)], axis=1)
    items, at, end, whole, head_at = [], start, start + length, len(data), _heads(data, "<")
    while at + 8 <= end and (head := head_at(at))[1] == ITEM & 0xFFFF:
        if at + 8 + head[2] > whole:
            raise ValueError("a fragment breaks off")
        items.append((at + 8, head[2]))
        at += 8 + head[2]
    if not items:
        return none
    (table, size), parts = items[0], np.array(items[1:], np.int64).reshape(-1, 2)
    if "7FE00001" in top:
        offsets = np.frombuffer(data[top["7FE00001"][3] : sum(top["7FE00001"][3:5])], "<u8").astype(np.int64)
    else:
        offsets = np.frombuffer(data[table : table + size // 4 * 4], "<u4").astype(np.int64)
    if len(offsets):
        return np.searchsorted(offsets, parts[:, 0] - 8 - (table + size), side="right") - 1, parts
    return np.arange(len(parts)) if len(parts) == frames else np.zeros(len(parts), np.int64) if frames == 1 else None, parts


def file_fragments(data: bytes | Places) -> Iterator[tuple]:
    """(frame, part, offset, length) of the pieces of a file's pixels, in order; none without pixels.

    Pixels of a stated length are frames of one size. In pixels of fragments a frame begins where the table of offsets says (the extended one before the basic one, which is the first item); without a table each fragment is a frame, if there
    are as many, or all are one frame, if there is one; otherwise frames are null, as only the pixels themselves could tell.
    """
    of, parts = _pieces(data)
    part = 0
    for k, (place, n) in enumerate(parts.tolist()):
        part = part + 1 if k and (of is None or of[k] == of[k - 1]) else 0
        yield (None if of is None else int(of[k])), part, place, n


def _by_file(spark: SparkSession, path: str, schema: pa.Schema, sql: str, rows_of) -> DataFrame:
    """Rows of each file, by a function of its places; a file that can't be read as it says has one row of nulls."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with files.opened(name) as f:
                    try:
                        rows = [dict(zip(names, (name, *e), strict=True)) for e in rows_of(Places(f))]
                    except (ValueError, struct.error):
                        rows = [dict.fromkeys(names) | {"path": name}]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema)

    return files.listing(spark, path).select("path").mapInArrow(run, sql)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of all files below a path; a file that isn't DICOM, or breaks off, has one row with a null tag."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([*[(n, pa.string()) for n in names[:5]], ("numbers", pa.list_(pa.float64())), ("offset", pa.int64()), ("length", pa.int64())])
    return _by_file(spark, path, schema, SCHEMA, file_elements)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, part, offset, length of the pieces of all files' pixels (see file_fragments); a file that isn't DICOM, or of which a fragment breaks off, has one row of nulls; one without pixels has none."""
    schema = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in ("frame", "part", "offset", "length")]])
    return _by_file(spark, path, schema, "path string, frame long, part long, offset long, length long", file_fragments)


def read_frames(fragments: DataFrame) -> DataFrame:
    """path, frame, n_parts, data of fragments (path, frame, part, offset, length), each read at its place and put together; a frame must fit into a task's memory."""
    parts = files.read_at(fragments.filter("frame is not null"), F.col("offset"), F.col("length"))
    whole = parts.groupBy("path", "frame").agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("p"))
    return whole.select("path", "frame", F.size("p").cast("long").alias("n_parts"), F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["bytes"])).alias("data"))


#: Bytes of a file that is read at once; bytes and frames that a task holds before they go on to Spark.
SMALL, HELD_BYTES, HELD_FRAMES = 1 << 20, 1 << 23, 10_000


def whole_frames(found: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of files (path, and others) with frame, n_parts, data of each of their frames: as read_frames() of all their fragments, but put together by the task that reads the file, so nothing is shuffled and one frame must
    fit into its memory."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in found.select(*columns).schema.fields)

    def frames(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """Of runs of a file's frames: their numbers, parts and sizes, and their bytes."""
        with files.opened(path) as f:
            small = f.size() <= SMALL
            data = f.read_at(f.size(), 0) if small else Places(f)
            try:
                of, parts = _pieces(data)
            except (ValueError, struct.error):
                return
            if of is None or not len(of):
                return
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            n, sizes = np.diff(np.append(first, len(of))), np.add.reduceat(parts[:, 1], first)
            if small:
                yield of[first], n, sizes, b"".join([data[at : at + size] for at, size in parts.tolist()])
                return
            ends, k = np.cumsum(sizes), 0
            while k < len(first):  # a few frames, or a large one
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + HELD_BYTES, side="right")))
                own = parts[first[k] : first[k] + n[k:to].sum()].tolist()
                yield of[first[k:to]], n[k:to], sizes[k:to], b"".join([f.read_at(size, at) for at, size in own])
                k = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            rows, of, n, sizes, data = zip(*out, strict=True)
            some = batch.take(pa.array(np.repeat(rows, list(map(len, of)))))
            ends = np.cumsum(np.concatenate([[0], *sizes]))
            kind, width = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
            whole = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(b"".join(data))])
            return pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(np.concatenate(of)), pa.array(np.concatenate(n)), whole.cast(pa.binary())], [*columns, "frame", "n_parts", "data"])

        for batch in batches:
            out: list[tuple] = []
            n_bytes = n_frames = 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                for own in frames(path):
                    n_bytes += len(own[3])
                    n_frames += len(own[0])
                    if out and (n_bytes > HELD_BYTES or n_frames > HELD_FRAMES):
                        yield rows_of(batch, out)
                        out, n_bytes, n_frames = [], len(own[3]), len(own[0])
                    out.append((i, *own))
            if out:
                yield rows_of(batch, out)

    return found.mapInArrow(run, fields + "frame long, n_parts long, data binary")


def instances(rows: DataFrame) -> DataFrame:
    """path, flavor, columns, rows, tile_width, tile_height, n_frames of each file's top-level elements."""
    top = rows.filter("parent = ''")
    text = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    number = lambda tag: F.max(F.when(F.col("tag") == tag, F.element_at("numbers", 1))).cast("long")
    kind = F.split(text("00080008"), r"\\")
    return top.groupBy("path").agg(F.try_element_at(kind, F.lit(3)).alias("flavor"), number("00480006").alias("columns"), number("00480007").alias("rows"), number("00280011").alias("tile_width"), number("00280010").alias("tile_height"), text("00280008").try_cast("int").alias("n_frames"))


def packed(tag: int, vr: str, value: bytes) -> bytes:
    """An element in explicit little-endian order, with an even length."""
    value += (b"\0" if vr in ("UI", "OB") else b" ") * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    return head + (struct.pack("<HI", 0, len(value)) if vr in LONG_VR else struct.pack("<H", len(value))) + value


def series_files(instances_: DataFrame) -> DataFrame:
    """name, content: a small file for each instance (name, flavor, columns, rows, tile, frames, codes), whose codes are items of a sequence of undefined length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                items = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, UNDEFINED) + packed(0x00080100, "SH", c.encode()) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) for c in r["codes"])
                sequence = struct.pack("<HH", 0x0040, 0x0555) + b"SQ" + struct.pack("<HI", 0, UNDEFINED) + items + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
                body = packed(0x00080008, "CS", f"ORIGINAL\\PRIMARY\\{r['flavor']}\\NONE".encode()) + packed(0x00280008, "IS", str(r["frames"]).encode()) + packed(0x00280010, "US", struct.pack("<H", r["tile"])) + packed(0x00280011, "US", struct.pack("<H", r["tile"]))
                body += sequence + packed(0x00480006, "UL", struct.pack("<I", r["columns"])) + packed(0x00480007, "UL", struct.pack("<I", r["rows"]))
                out.append(bytes(128) + b"DICM" + packed(0x00020010, "UI", b"1.2.840.10008.1.2.1") + body)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    return instances_.select("name", "flavor", "columns", "rows", "tile", "frames", "codes").mapInArrow(run, "name string, content binary")


def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """name, content of small files, whose frames are the rows (name, tables, parts: an array of binary) that follow each other: fragments behind a table of offsets that is basic, extended, or (anything else in tables) empty."""
    name, tables, frames = None, None, []
    for batch in batches:
        runs, at = pc.run_end_encode(batch.column("name")), 0
        for own, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if own != name:
                if frames:
                    yield name, _framed(tables, pa.concat_arrays(frames))
                name, tables, frames = own, batch.column("tables")[at].as_py(), []
            frames.append(batch.column("parts").slice(at, stop - at))
            at = stop
    if frames:
        yield name, _framed(tables, pa.concat_arrays(frames))


def _framed(tables: str | None, frames: pa.ListArray) -> bytes:
    of, parts = frames.offsets.to_numpy(), frames.flatten()
    places = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    sizes = np.diff(places)
    ends = np.cumsum(np.concatenate([[0], 8 + sizes + sizes % 2]))
    fragments = np.zeros(ends[-1], np.uint8)
    heads = np.empty(len(sizes), [("group", "<u2"), ("element", "<u2"), ("length", "<u4")])
    heads["group"], heads["element"], heads["length"] = 0xFFFE, 0xE000, sizes + sizes % 2
    fragments[ends[:-1, None] + np.arange(8)] = heads.view(np.uint8).reshape(-1, 8)
    if places[-1] > places[0]:
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        fragments[np.arange(places[0], places[-1]) + np.repeat(ends[:-1] + 8 - places[:-1], sizes)] = data[places[0] : places[-1]]
    starts = ends[of[:-1] - of[0]]
    body = packed(0x00280008, "IS", str(len(frames)).encode())
    if tables == "extended":
        body += packed(0x7FE00001, "OV", starts.astype("<u8").tobytes())
    item = lambda b: struct.pack("<HHI", 0xFFFE, 0xE000, len(b)) + b
    table = item(starts.astype("<u4").tobytes() if tables == "basic" else b"")
    pixels = struct.pack("<HH", 0x7FE0, 0x0010) + b"OB" + struct.pack("<HI", 0, UNDEFINED) + table + fragments.tobytes() + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    return bytes(128) + b"DICM" + packed(0x00020010, "UI", b"1.2.840.10008.1.2.4.50") + body + pixels
