"""Files by name and first bytes: listings, kinds, flags of folders, and reads at a place, without reading whole files."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.session import written

#: Bytes that are read at places before they go on to Spark.
READ_BYTES = 1 << 24
#: Bytes of a file that are read to tell its kind.
HEADER = 256

# Kinds by extension.
_BY_EXTENSION = {"tiff": "tiff tif bif ptif", "ndpi": "ndpi", "simple image": "png jpg jpeg bmp ppm", "xml": "xml", "json": "json geojson", "dicom": "dcm", "isyntax": "isyntax i2syntax", "mrxs": "mrxs"}


def has_dicom_mark(header: Column) -> Column:
    return F.coalesce(F.substring(header, 129, 4) == F.encode(F.lit("DICM"), "UTF-8"), F.lit(False))


def kind(path: Column, header: Column) -> Column:
    """The kind of a regular file: by its name, by its extension in any case, by the mark of DICOM; other files with an extension may be open to the slide library, those without one are unknown."""
    ext = F.lower(T.extension(path))
    out = F.when(F.lower(T.base_name(path)) == "slidedat.ini", "mrxs")
    for name, extensions in _BY_EXTENSION.items():
        out = out.when(ext.isin(extensions.split()), name)
    return out.when(has_dicom_mark(header), "dicom").when(ext == "", "unknown").otherwise("openslide compatible")


def is_image(kind_: Column) -> Column:
    return F.coalesce(~kind_.isin("xml", "json", "unknown"), F.lit(False))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, name, length, modified of all files below a folder that aren't empty; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), T.base_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def directory_flags(files: DataFrame) -> DataFrame:
    """folder, n_files, contains_dicom, contains_other of files (folder, kind)."""
    return files.groupBy("folder").agg(F.count("*").alias("n_files"), F.bool_or(F.col("kind") == "dicom").alias("contains_dicom"), F.bool_or(F.col("kind") != "dicom").alias("contains_other"))


#: A folder's address and the name within it; file systems and places of folders that a task has read from.
_HEAD = re.compile(r"^(.*/)([^/]+)$", re.DOTALL)
_SYSTEMS: dict = {}


def opened(path: str):
    """A file of any file system that the tasks can reach, open for reads at a place."""
    from pyarrow.fs import FileSystem

    local = path.startswith("file:/") and not path.startswith("file://")
    head = _HEAD.match(path.replace("file:/", "file:///", 1) if local else path)
    if head is None or "%" in path or "?" in path or "#" in path:
        system, place = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if local else path)
        return system.open_input_file(place)
    folder, name = head.groups()
    if folder not in _SYSTEMS:
        if len(_SYSTEMS) >= 100:
            _SYSTEMS.clear()
        _SYSTEMS[folder] = FileSystem.from_uri(folder)
    system, place = _SYSTEMS[folder]
    return system.open_input_file(f"{place.rstrip('/')}/{name}")


class Blocks:
    """Small reads of an open file, through a few blocks that are kept."""

    SIZE, KEPT = 1 << 16, 16

    def __init__(self, file) -> None:
        self.file, self.size, self.held = file, file.size(), {}

    def __call__(self, at: int, n: int) -> bytes:
        if n > self.SIZE:
            return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        out = b""
        while len(out) < n and at + len(out) < self.size:
            k, skip = divmod(at + len(out), self.SIZE)
            if k not in self.held:
                if len(self.held) == self.KEPT:
                    self.held.pop(next(iter(self.held)))
                self.held[k] = self.file.read_at(min(self.SIZE, self.size - k * self.SIZE), k * self.SIZE)
            out += self.held[k][skip : skip + n - len(out)]
        return out


def read_at(files: DataFrame, offset: Column, size: Column) -> DataFrame:
    """files (path, and others) with bytes: what stands at an offset of each file, at most so many bytes (fewer at its end; null if it can't be opened, or an offset or size is null). Tasks read at the place, so large files cost
    what is read."""
    columns = [c for c in files.columns if c != "bytes"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*columns).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch, own: list[int], out: list[bytes | None]) -> pa.RecordBatch:
            some = batch.take(pa.array(own, pa.int64()))
            return pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(out, pa.binary())], [*columns, "bytes"])

        for batch in batches:
            paths, ats, sizes = (batch.column(c).to_pylist() for c in ("path", "__at", "__n"))
            own: list[int] = []
            out: list[bytes | None] = []
            held, by_path = 0, {}
            for i, path in enumerate(paths):
                by_path.setdefault(None if None in (path, ats[i], sizes[i]) else path, deque()).append(i)
            for path, rows in by_path.items():  # a file is opened once for all of its places in a batch
                try:
                    if path is not None:
                        with opened(path) as f:
                            while rows:
                                left = max(0, min(sizes[rows[0]], f.size() - ats[rows[0]]))
                                out.append(f.read_at(left, ats[rows[0]]) if left else b"")
                                own.append(rows.popleft())
                                held += left
                                if held >= READ_BYTES:
                                    yield rows_of(batch, own, out)
                                    own, out, held = [], [], 0
                except OSError:
                    pass
                own.extend(rows)
                out.extend([None] * len(rows))
            if own:
                yield rows_of(batch, own, out)

    return files.select(*columns, offset.cast("long").alias("__at"), size.cast("long").alias("__n")).mapInArrow(run, fields + "bytes binary")


def _writer(made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]], folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, place = FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        system.create_dir(place, recursive=True)
        out = []
        for name, content in made(batches):
            with system.open_output_stream(f"{place}/{name}") as f:
                f.write(content)
            out.append((f"{folder}/{name}", len(content)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["path", "length"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["path", "length"])

    return run


def write_all(contents: DataFrame, folder: str) -> int:
    """Writes each row (name, content) as a file of a folder that all tasks share; how many. A task that runs again writes the same files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True)

    return contents.select("name", "content").mapInArrow(_writer(rows, folder), "path string, length long").count()


def write_made(rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]], folder: str) -> DataFrame:
    """path, length of the files of a folder that all tasks share, which tasks write one by one as they make them (name, content) of their rows. Files that are as many as these needn't be listed by the driver."""
    return written(rows.mapInArrow(_writer(made, folder), "path string, length long"), "files")
