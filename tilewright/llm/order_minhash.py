"""Order MinHash fingerprints.

A text's elements are its character k-mers, each numbered among its equals. Each of the hash functions selects the elements with the least
values; their k-mers, in the order in which they stand in the text, are hashed to one 32-bit place of the fingerprint. The share of equal places of
two fingerprints estimates a likeness that falls with the edit distance: unlike a set's, it sees moved and repeated parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.ordered import key, ranges_of, text_hash
from tilewright.llm.text import U64, mix, stream
from tilewright.session import text_batches

#: Length of k-mers, elements in a tuple, hash functions (places of a fingerprint).
K, TUPLE, PLACES = 5, 2, 64
#: Rows in one range of ids.
RANGE_ROWS = 4096

_MULTIPLIER = (stream(303, PLACES) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (stream(404, PLACES) >> U64(32)).astype(np.uint32)
_POINT = stream(505, K) | U64(1)
#: Columns of hash values that are held at once.
_WIDE = 8192


def fingerprint(points: np.ndarray) -> np.ndarray:
    """The places (unsigned 32-bit) of a text of code points. Texts shorter than a k-mer have one element, the whole text; the empty text too."""
    n = len(points)
    if n < K:
        return ((mix(np.full(1, sum((int(p) + 1) * int(w) for p, w in zip(points, _POINT, strict=False)) & (1 << 64) - 1, U64) + U64(n))[0] * stream(606, PLACES)) >> U64(32)).astype(np.uint32)
    h = np.zeros(n - K + 1, U64)
    for i in range(K):
        h += points[i : n - K + 1 + i] * _POINT[i]
    kmer = mix(h) >> U64(32)
    # sorted by k-mer, then by place: the number of an occurrence is its distance from its run's start
    rows = np.sort(kmer << U64(32) | np.arange(len(kmer), dtype=U64))
    value, place = rows >> U64(32), (rows & U64(0xFFFFFFFF)).astype(np.int64)
    index = np.arange(len(rows))
    start = np.where(np.concatenate(([True], value[1:] != value[:-1])), index, 0)
    occurrence = (index - np.maximum.accumulate(start)).astype(U64)
    element = (mix(value * U64(0x9E3779B97F4A7C15) + occurrence) >> U64(32)).astype(np.uint32)
    # the two least of each hash function, block by block
    least = np.full((PLACES, 0), 0, np.uint32)
    where = np.zeros((PLACES, 0), np.int64)
    line = np.arange(PLACES)
    for a in range(0, len(element), _WIDE):
        hashed = _MULTIPLIER[:, None] * element[None, a : a + _WIDE] + _ADD[:, None]
        picks = []
        for _ in range(min(TUPLE, hashed.shape[1])):
            at = hashed.argmin(axis=1)
            picks.append((hashed[line, at].copy(), at + a))
            hashed[line, at] = 0xFFFFFFFF
        least = np.concatenate([least, *[v[:, None] for v, _ in picks]], axis=1)
        where = np.concatenate([where, *[w[:, None] for _, w in picks]], axis=1)
    order = np.argsort(least, axis=1, kind="stable")[:, :TUPLE]
    chosen = np.take_along_axis(where, order, axis=1)
    places = place[chosen]
    chosen = np.take_along_axis(value[chosen], np.argsort(places, axis=1, kind="stable"), axis=1)
    out = np.full(PLACES, chosen.shape[1], U64)
    for i in range(chosen.shape[1]):
        out = mix(out * U64(0x9E3779B97F4A7C15) + chosen[:, i])
    return (out >> U64(32)).astype(np.uint32)


def as_text(places: np.ndarray) -> str:
    """Eight hexadecimal digits for each place."""
    return places.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order; a row's next row in the same range follows it, and a range ends with the guest that begins the next range."""
    held = None  # range, id, text, points and fingerprint of the row that waits for its next
    for batch in batches:
        out = []
        for part, doc_id, guest, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "guest", "text")), strict=True):
            if guest and (held is None or held[0] != part):
                continue  # an equal row of the guest that has been
            points = _points(text)
            print_ = fingerprint(points)
            if held is not None and held[0] == part:
                _, own_id, own_text, own_points, own = held
                cut = len(own_text) - len(own_text) // 2
                tail = len(own_text) // 2
                edited = own_text[:cut] + text[:tail]
                changed = fingerprint(np.concatenate((own_points[:cut], points[:tail])))
                out.append((own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, print_)))
            held = None if guest else (part, doc_id, text, points, print_)
        columns = zip(*out, strict=True) if out else [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in _FIELDS.split(", ")])


def order_minhash(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), and of each text with its last half replaced from the next row in descending doc_id.

    Null is the empty text. Null ids come last; rows of one id are in descending order of a hash of their text. After the last row comes the first, so a single row is its own
    next. Other columns aren't read. Rows are dealt out by ranges of (id, hash), a task each, with one guest: the first row of the range after it. The first keys of ranges
    (bounded in number) come to the driver and are broadcast.
    """
    docs = text_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges_of(docs, range_rows)
    last = len(ranges) - 1
    keyed = docs.select("doc_id", "text", key().alias("id"), text_hash().alias("h"))
    keyed = keyed.withColumn("part", F.lit(last) - ranges.number(F.col("id"), F.col("h")))
    # the first key of each range that has rows
    heads = sorted(tuple(r) for r in keyed.groupBy("part").agg(F.max(F.struct("id", "h")).alias("k")).select("part", "k.id", "k.h").collect())
    # it is a guest of the range before, the first of all one of the last
    names = docs.sparkSession.createDataFrame([(*heads[k][1:], heads[k - 1][0]) for k in range(len(heads))], "id long, h long, before int")
    own = F.struct("part", F.lit(False).alias("guest"))
    visits = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = keyed.join(F.broadcast(names), ["id", "h"], "left").select("doc_id", "text", "id", "h", F.explode(visits).alias("visit")).select("visit.part", "visit.guest", "doc_id", "text", "id", "h")
    rows = rows.repartitionById(len(ranges), "part").sortWithinPartitions("part", "guest", F.desc("id"), F.desc("h"), F.desc("text"))
    return rows.select("part", "guest", "doc_id", "text").mapInArrow(_fingerprints, _FIELDS)
