"""JSON documents of any size, read by byte ranges: the elements of one array of the root object, each found by the task whose range it begins in.

A first pass counts the quotes of each range and sums its brackets twice, as if it began outside a string and inside one. Sums over the ranges before then tell how each range really begins, so that a second pass can cut at the
commas between elements. No task holds more than a range and one element.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import written
from tilewright.sources.files import Blocks, opened

#: Bytes of a range, and of all ranges of a task unless there would be more than MOST_TASKS of them (a task reads its ranges one after the other); ranges whose sums are carried on together; bytes of texts in one batch.
RANGE, MOST_TASKS, SUMMED, BATCH = 8 << 20, 20_000, 4096, 16 << 20

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_SPACE = b" \t\r\n"


def _slashes(read: Callable[[int, int], bytes], at: int) -> int:
    """How many backslashes stand right before a place."""
    n, window = 0, 64
    while at - n > 0:
        piece = read(max(0, at - n - window), min(window, at - n))
        run = len(piece) - len(piece.rstrip(b"\\"))
        n += run
        if run < len(piece):
            break
        window *= 2
    return n


class Scan:
    """Quotes and brackets of a piece of a document that begins inside a string or not, at a depth, after so many backslashes."""

    def __init__(self, piece: bytes, inside: int, depth: int, slashes: int) -> None:
        self.b, self.inside, self.depth = np.frombuffer(piece, np.uint8), inside, depth
        quotes, slash = np.flatnonzero(self.b == ord('"')), self.b == ord("\\")
        starts = np.flatnonzero(slash & ~np.concatenate([[False], slash[:-1]]))  # of runs of backslashes
        run = np.zeros(len(quotes), np.int64)
        near = (quotes > 0) & slash[quotes - 1]
        first = starts[np.searchsorted(starts, quotes[near]) - 1]
        run[near] = quotes[near] - first + np.where(first == 0, slashes, 0)
        if len(quotes) and quotes[0] == 0:
            run[0] = slashes
        self.quotes = quotes[run % 2 == 0]
        step = _STEP[self.b]
        self.at = np.flatnonzero(step)
        self.at = self.at[self.outside(self.at)]
        self.step = step[self.at]
        self.after = depth + np.cumsum(self.step, dtype=np.int64)

    def outside(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.quotes, at) + self.inside) % 2 == 0

    def found(self, byte: str, depth: int) -> np.ndarray:
        """Places of a character outside strings at a depth."""
        at = np.flatnonzero(self.b == ord(byte))
        at = at[np.concatenate([[self.depth], self.after])[np.searchsorted(self.at, at)] == depth]
        return at[self.outside(at)]

    def end(self) -> tuple[int, int]:
        """Whether a string is open at the end, and the depth there."""
        return (self.inside + len(self.quotes)) % 2, int(self.after[-1]) if len(self.after) else self.depth


@contextmanager
def _files():
    """A function that opens a path; the last file stays open."""
    held: dict = {}

    def get(path: str):
        if path not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[path] = opened(path)
        return held[path]

    try:
        yield get
    finally:
        for f in held.values():
            f.close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its quotes, and for a beginning outside (0) and inside (1) a string the change and the lowest of the depth."""
    names = ("path", "k", "at", "n", "quotes", "d0", "d1", "low0", "low1")
    types = (pa.string(), *[pa.int64()] * 8)
    with _files() as get:
        for r in _rows(batches):
            f = get(r["path"])
            piece, slashes = f.read_at(r["n"], r["at"]), _slashes(Blocks(f), r["at"])
            scans = [Scan(piece, inside, 0, slashes) for inside in (0, 1)]
            low = [int(min(0, s.after.min(initial=0))) for s in scans]
            row = (r["path"], r["k"], r["at"], r["n"], len(scans[0].quotes), *(s.end()[1] for s in scans), *low)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the sum of a column over all ranges of the file before each: within blocks of ranges, and over the blocks."""
    blocks = rows.withColumn("block", F.floor(F.col("k") / SUMMED))
    sums = blocks.groupBy("path", "block").agg(F.sum(value).alias("__sum"))
    before = sums.select("path", "block", F.coalesce(F.sum("__sum").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("path", "block").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("__own", own).join(before, ["path", "block"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "block")


def _key(read: Callable[[int, int], bytes], at: int) -> str | None:
    """The string that ends before the colon at a place."""
    window = 256
    while True:
        start = max(0, at - window)
        text = read(start, at - start).rstrip(_SPACE)
        i = len(text) - 1
        while text.endswith(b'"') and (i := text.rfind(b'"', 0, i)) >= 0:
            run = i - len(text[:i].rstrip(b"\\"))
            if run == i and start:
                break  # the backslashes may go on before the window
            if run % 2 == 0:
                return _string(text[i:])
        if not start:
            return None
        window *= 2


def _string(text: bytes) -> str | None:
    try:
        return json.loads(text)
    except ValueError:
        return None


def _value(read: Callable[[int, int], bytes], at: int) -> tuple[int, bytes]:
    """Where the value after a colon begins, and its first byte (empty at the end of the file)."""
    while (c := read(at + 1, 1)) and c in _SPACE:
        at += 1
    return at + 1, c


def _text(read: Callable[[int, int], bytes], at: int) -> str | None:
    """The string that begins with the quote at a place."""
    window = 256
    while True:
        piece = read(at, window)
        ends = Scan(piece, 0, 0, 0).quotes
        if len(ends) > 1:
            return _string(piece[: ends[1] + 1])
        if len(piece) < window:
            return None
        window *= 2


def _roots(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the ranges that touch the root object: where arrays named key begin, where values with brackets end, and texts named type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _files() as get:
            for r in _rows(batches):
                f = get(r["path"])
                read = Blocks(f)
                scan = Scan(f.read_at(r["n"], r["at"]), r["inside"], r["depth"], _slashes(read, r["at"]))
                out = [(r["at"] + int(p), "close", None) for p in scan.at[(scan.after == 1) & (scan.step < 0)]]
                for p in scan.found(":", 1):
                    name = _key(read, r["at"] + int(p))
                    if name in (key, "type"):
                        at, c = _value(read, r["at"] + int(p))
                        if name == key:  # of repeated names the last counts, whatever its value
                            out.append((at, "open" if c == b"[" else "none", None))
                        if name == "type":
                            out.append((at, "type", _text(read, at) if c == b'"' else None))
                places, roles, texts = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(out), pa.string()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["path", "place", "role", "text"])

    return run


def _next(f, at: int, inside: int, depth: int, end: int) -> int:
    """The first place from at on where an element of the array that ends at end does."""
    read, size = Blocks(f), 1 << 16
    while at < end:
        scan = Scan(f.read_at(min(size, end - at), at), inside, depth, _slashes(read, at))
        cuts = scan.found(",", 2)
        if len(cuts):
            return at + int(cuts[0])
        at += len(scan.b)
        inside, depth = scan.end()
        size = min(2 * size, RANGE)
    return end


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, place, text of the elements that begin in each range."""

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "place", "text"])

    with _files() as get:
        for r in _rows(batches):
            f, at, stop = get(r["path"]), r["at"], r["at"] + r["n"]
            piece = f.read_at(r["n"], at)
            scan = Scan(piece, r["inside"], r["depth"], _slashes(Blocks(f), at))
            cuts = [p for p in (scan.found(",", 2) + at).tolist() if r["first"] < p < r["last"]]
            if at <= r["first"] < stop:
                cuts.insert(0, r["first"])
            if not cuts:
                continue
            ends = cuts[1:] + [r["last"] if r["last"] < stop else _next(f, stop, *scan.end(), r["last"])]
            rows, size = [], 0
            for a, z in zip(cuts, ends, strict=True):
                text = (piece[a + 1 - at : z - at] if z <= stop else f.read_at(z - a - 1, a + 1)).strip(_SPACE)
                if text:
                    rows.append((r["path"], a + 1, text.decode("utf-8", "replace")))
                    size += len(text)
                if size > BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)


def elements(files: DataFrame, key: str, kind: str | None = None, size: int = RANGE) -> DataFrame:
    """path, place, text of each element of the array named key in the root object of each file (path, length; other columns are left out): its JSON text, and the place in the file after the bracket or comma before it.

    Files are UTF-8, of any layout. With kind, only files whose root has a text of that value named type. A file without such an array, that isn't a whole document by its quotes and brackets, or that is empty, gives no rows. Of repeated names
    the last counts. Each range is read twice (ranges within one long element once, and once more with it); the sums of one range are one small row. Runs of backslashes are followed back to their beginning, which is slow only for runs
    longer than a range.
    """
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("k"), "length").filter("length > 0").selectExpr("path", "k", f"k * {size} as at", f"least(cast({size} as bigint), length - k * {size}) as n")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, (files.agg(F.sum("length")).first()[0] or 0) // RANGE))
    integers = "quotes long, d0 long, d1 long, low0 long, low1 long"
    sums = written(ranges.repartition(tasks).mapInArrow(_sums, f"path string, k long, at long, n long, {integers}"), "range-sums")
    parity = _before(sums, "quotes", "q").selectExpr("*", "q % 2 as inside").selectExpr("path", "k", "at", "n", "quotes", "inside", "if(inside = 0, d0, d1) as d", "if(inside = 0, low0, low1) as low")
    state = written(_before(parity, "d", "depth").withColumn("low", F.col("low") + F.col("depth")), "range-states")
    events = state.filter("low <= 1").repartition(tasks).mapInArrow(_roots(key), "path string, place long, role string, text string")
    closed = F.min(F.when(F.col("role") == "close", F.col("place"))).over(W.partitionBy("path").orderBy("place").rowsBetween(1, W.unboundedFollowing))
    is_array = F.col("role").isin("open", "none")
    spans = events.withColumn("end", closed).groupBy("path").agg(
        F.max(F.when(is_array, F.struct("place", "role", "end"))).alias("a"), F.max(F.when(F.col("role") == "type", F.struct("place", "text"))).alias("t")
    )
    spans = spans.filter("a.role = 'open'" if kind is None else F.expr("a.role = 'open'") & (F.col("t.text") == kind)).selectExpr("path", "a.place as first", "a.end as last")
    whole = state.groupBy("path").agg(F.sum("d").alias("d"), F.sum("quotes").alias("q"), F.min("low").alias("low")).filter("d = 0 and q % 2 = 0 and low >= 0").select("path")
    wanted = state.filter("low <= 2").join(spans.join(whole, "path"), "path").filter("at <= last and at + n > first")
    return wanted.select("path", "at", "n", "inside", "depth", "first", "last").repartition(tasks).mapInArrow(_elements, "path string, place long, text string")
