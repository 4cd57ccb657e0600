"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised: A-Z and the accented capitals of Latin-1 are lower-cased, runs of ASCII characters other than letters and digits are one space. A passage of n bytes with e edits
still shares n + 1 - q (e + 1) of its q-grams, and all of them lie on diagonals (place in the document less place in the item) that differ by at most e. So the shared q-grams of a document are
counted in diagonal bands of width e + 1 that overlap by half, twice as wide as e; a band's region is retained if it reaches that bound, and verified by a banded alignment of the whole item
within the edit budget. Shorter budgets are used for items so short that the bound would vanish. Items of under 20 bytes are searched exactly, as whole words.

Shared q-grams are counted in portions of bounded size, and all regions of a portion are aligned at once, so that a phrase that many items begin with costs array steps only.

The items are a query set: they are read in blocks of bounded size, each broadcast to tasks that pass over all documents once. With more than one block, a pass for each finds the leaked
texts, by two hashes of the text; these rows are then joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.text import BYTE_HASH, U64, mix, ranges, sliced, span_hash, utf8
from tilewright.session import text_batches, written

#: Length of q-grams (9 to 16 bytes), and edits allowed as a share of an item's length.
Q, ERRORS = 9, 0.08
#: Normalised bytes of items in a block.
BLOCK_BYTES = 4 << 20
#: Items of fewer normalised bytes must stand as whole words, without an edit.
SHORTEST = 20
#: Shared q-grams that are looked at at once, and cells of alignments.
MOST_HITS, MOST_CELLS = 1 << 21, 1 << 21
#: Budgets from which on cells have 32 bits.
SHORT_CELLS = 10_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes and offsets of rows of text; each row keeps a space at either end, if it isn't empty."""
    out = _FOLD[data]
    if len(out) > 1:
        after = data[:-1] == 0xC3
        tail = data[1:]
        upper = after & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        out[1:][upper] += 0x20
    blank = out == 0x20
    stays = np.ones(len(out), bool)
    stays[1:] = ~(blank[1:] & blank[:-1])
    begins = offsets[:-1][np.diff(offsets) > 0]
    stays[begins] = True
    kept = np.concatenate(([0], np.cumsum(stays)))
    return out[stays], kept[offsets]


def qgrams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    wide = data.astype(U64)
    two = wide[:-1] << U64(8) | wide[1:]
    four = two[:-2] << U64(16) | two[2:]
    eight = four[:-4] << U64(32) | four[4:]
    return mix(eight[:n] * U64(0x9E3779B97F4A7C15) + (eight[Q - 8 : n + Q - 8] & U64((1 << 8 * (Q - 8)) - 1)))


def budget(n: int) -> int:
    """Edits allowed in an item of n bytes: the share, less where the lemma's bound would fall under one."""
    return max(0, min(int(ERRORS * n), (n + 1) // Q - 2))


@dataclass
class Block:
    """Items of a block: ids, normalised bytes, their q-grams in sorted order with item and place, a bitmap of the hashes' high bits; short items by length as sorted hashes with items."""

    ids: list[int]
    texts: list[bytes]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([budget(n) for n in self.lengths.tolist()], np.int64)
        self.bound = self.lengths + 1 - Q * (self.most + 1)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)


_BITS = 22


def make_block(items: list[tuple[int, str]]) -> Block:
    ids, texts, keys, item, place, short = [], [], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for item_id, text in items:
        data, _ = normalised(*utf8(pa.array([text], pa.string())))
        own = data.tobytes().strip()
        if not own:
            continue
        if len(own) < SHORTEST:
            short.setdefault(len(own), []).append(len(ids))
        else:
            h = qgrams(np.frombuffer(own, np.uint8))
            keys.append(h)
            item.append(np.full(len(h), len(ids)))
            place.append(np.arange(len(h)))
        ids.append(item_id)
        texts.append(own)
    keys, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
    order = np.argsort(keys, kind="stable")
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(keys >> U64(64 - _BITS)).astype(np.int64)] = True
    hashed = {}
    for n, own in short.items():
        flat = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
        h = span_hash(BYTE_HASH[flat], np.arange(len(own)) * n, np.arange(1, len(own) + 1) * n)
        by = np.argsort(h, kind="stable")
        hashed[n] = h[by], np.array(own)[by]
    return Block(ids, texts, keys[order], item[order], place[order], bitmap, hashed)


def find_short(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, 0) of the short items that stand in normalised rows as whole words."""
    if not block.short or not len(data):
        return []
    outside = np.ones(len(data) + 1, bool)  # what may follow or precede a word: a space, or another row
    outside[:-1] = data == 0x20
    begins = ~outside[:-1]
    begins[1:] &= outside[:-2]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins & ~outside[:-1])
    row = np.searchsorted(offsets, starts, "right") - 1
    value, found = BYTE_HASH[data], []
    for n, (hashes, items) in block.short.items():
        ends = starts + n
        fits = ends <= offsets[row + 1]
        fits[fits] = (ends[fits] == offsets[row[fits] + 1]) | outside[ends[fits]]
        a, r = starts[fits], row[fits]
        h = span_hash(value, a, a + n)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(high > low).tolist():
            words = data[a[k] : a[k] + n].tobytes()
            found += [(int(r[k]), i, 0) for i in items[low[k] : high[k]].tolist() if block.texts[i] == words]
    return sorted(set(found))


def least_edits(block: Block, data: np.ndarray, item: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least edits between items and any part of data[low:high], on alignments whose diagonals (place in data less place in the item) begin with first and are at least
    2 (e + 1) for a budget of e; e + 1 stands for more than e."""
    most = block.most[item]
    out = most + 1
    raw = data.tobytes()
    for c, (i, a, z) in enumerate(zip(item.tolist(), low.tolist(), high.tolist(), strict=True)):
        if raw.find(block.texts[i], a, z) >= 0:
            out[c] = 0
    by_length = np.flatnonzero(out)
    by_length = by_length[np.argsort(block.lengths[item[by_length]], kind="stable")]
    k = 0
    while k < len(by_length):
        # as many as their cells allow, the longest last
        n = block.lengths[item[by_length[k:]]]
        width = 2 * (np.maximum.accumulate(most[by_length[k:]]) + 1)
        take = max(1, int(np.searchsorted(np.arange(1, len(n) + 1) * (n + width), MOST_CELLS, "right")))
        own, width = by_length[k : k + take], int(width[min(take, len(n)) - 1])
        k += take
        # cells hold at most three budgets and a bit
        kind = np.int16 if int(most[own].max()) < SHORT_CELLS else np.int32
        n, far = block.lengths[item[own]], (most[own] + 1).astype(kind)
        # line t holds what stands at data[first + t]; a cell (i, d) of the alignment is at line i + d
        line = first[own] + np.arange(int(n[-1]) + width + 1)[:, None]
        outside = (line < low[own]) | (line > high[own])
        text = data[np.clip(line, 0, len(data) - 1)]
        letters = block.flat[np.minimum(block.starts[item[own]] + np.arange(int(n[-1]))[:, None], len(block.flat) - 1)]
        # a start anywhere costs nothing
        cells = np.where(outside[:width], far, kind(0))
        for i in range(1, int(n[-1]) + 1):
            new = cells + (text[i - 1 : i - 1 + width] != letters[i - 1])  # a match or change
            np.minimum(new[:-1], cells[1:] + kind(1), out=new[:-1])  # an item's byte left out
            np.copyto(new, far, where=outside[i : i + width])
            step = 1
            while step < width:  # bytes of data left out: one, then up to three, then up to seven
                np.minimum(new[step:], new[:-step] + kind(step), out=new[step:])
                step *= 2
            np.copyto(new, far, where=outside[i : i + width])
            cells = np.minimum(new, far)
            if (ended := int(np.searchsorted(n, i, "right"))) or i % 16 == 0:
                least = cells.min(axis=0)
                out[own[:ended]] = least[:ended]
                stays = (np.arange(len(own)) >= ended) & (least < far)
                if not stays.any():
                    break
                if ended or 2 * np.count_nonzero(stays) < len(own):
                    own, n, far, cells, outside, text, letters = own[stays], n[stays], far[stays], cells[:, stays], outside[:, stays], text[:, stays], letters[:, stays]
    return out


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of the columns; as one integer each, where that has enough bits."""
    low = [int(c.min()) for c in columns]
    bits = [(int(c.max()) - a).bit_length() for c, a in zip(columns, low, strict=True)]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return [c[new] for c in columns]
    packed = np.zeros(len(columns[0]), np.int64)
    for c, a, n in zip(columns, low, bits, strict=True):
        packed = packed << n | c - a
    packed.sort()
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    out = []
    for a, n in zip(low[::-1], bits[::-1], strict=True):
        out.append((packed & (1 << n) - 1) + a)
        packed = packed >> n
    return out[::-1]


def find(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item of the block, edits) of all items found in normalised rows."""
    out = find_short(block, data, offsets)
    h = qgrams(data)
    hits = np.flatnonzero(block.bitmap[(h >> U64(64 - _BITS)).astype(np.int64)])
    if not len(hits) or not len(block.keys):
        return out
    row = np.searchsorted(offsets, hits, "right") - 1
    inside = hits + Q <= offsets[row + 1]
    hits = hits[inside]
    low, high = np.searchsorted(block.keys, h[hits], "left"), np.searchsorted(block.keys, h[hits], "right")
    shared = high > low
    hits, low, n = hits[shared], low[shared], (high - low)[shared]
    total = np.cumsum(n)
    counts, k = [], 0
    while k < len(hits):
        stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + MOST_HITS, "right")))
        entry = ranges(low[k:stop], n[k:stop])
        where, item = np.repeat(hits[k:stop], n[k:stop]), block.item[entry]
        band = (where - block.place[entry]) // (block.most[item] + 1)
        # a q-gram of the document counts once in each band of an item
        item, band, where = _distinct(item, band, where)
        r = np.searchsorted(offsets, where, "right") - 1
        head = np.ones(len(item), bool)
        head[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (r[1:] != r[:-1])
        head = np.flatnonzero(head)
        counts.append((item[head], band[head], r[head], np.diff(np.append(head, len(item)))))
        k = stop
    if not counts:
        return out
    item, band, r, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    # bands of double width start at every half width: each is made of one band and the next, one of which has half of the bound
    bits, low = int(r.max()).bit_length(), int(band.min()) - 1
    wide = (int(band.max()) - low + 2).bit_length()
    cell = (item << wide | band - low) << bits | r
    if len(counts) > 1:
        cell, back = np.unique(cell, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        item, band, r = cell >> bits + wide, (cell >> bits & (1 << wide) - 1) + low, cell & (1 << bits) - 1
    heavy = np.flatnonzero(2 * n >= block.bound[item])
    pairs = []
    for step in (-1, 1):
        other = cell[heavy] + (step << bits)
        at = np.minimum(np.searchsorted(cell, other), len(cell) - 1)
        enough = n[heavy] + np.where(cell[at] == other, n[at], 0) >= block.bound[item[heavy]]
        pairs.append(cell[heavy[enough]] + (min(step, 0) << bits))
    cell = np.unique(np.concatenate(pairs))
    item, band, r = cell >> bits + wide, (cell >> bits & (1 << wide) - 1) + low, cell & (1 << bits) - 1
    most = block.most[item]
    first = band * (most + 1)
    low = np.maximum(offsets[r], first - most)
    high = np.minimum(offsets[r + 1], first + 2 * (most + 1) + block.lengths[item] + most)
    edits = least_edits(block, data, item, first, low, high)
    found: dict[tuple[int, int], int] = {}
    for key, e in zip(zip(r.tolist(), item.tolist(), strict=True), edits.tolist(), strict=True):
        if e <= block.most[key[1]]:
            found[key] = min(e, found.get(key, e))
    return out + [(a, b, e) for (a, b), e in found.items()]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items (item_id, text) in blocks of at most about BLOCK_BYTES bytes (one item at least)."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if held and size + n > BLOCK_BYTES:
            yield make_block(held)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield make_block(held)


def _searched(shared, columns: list[str], only_found: bool):
    """Adds __items (ids, ascending) and __edits to the columns, the last of which is the text, left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            items: list[set] = [set() for _ in range(len(batch))]
            edits: list[int | None] = [None] * len(batch)
            data, offsets = utf8(batch.column("__text"))
            for i, j in sliced(offsets):
                part, at = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for r, item, e in find(known, part, at):
                    items[i + r].add(known.ids[item])
                    edits[i + r] = e if edits[i + r] is None else min(e, edits[i + r])
            ids = pa.array([sorted(x, key=lambda v: (v is not None, v)) for x in items], pa.list_(pa.int64()))
            arrays = [*(batch.column(c) for c in columns), ids, pa.array(edits, pa.int32())]
            out = pa.RecordBatch.from_arrays(arrays, [*columns, "__items", "__edits"])
            yield out.filter(pa.array([e is not None for e in edits], pa.bool_())) if only_found else out

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), leaked, n_items, items (array of the item ids found, ascending) and least_edits (null if none).

    Null is the empty text, which has no leak. Items that are null or have no letter or digit are never found; a null item_id is reported as null. Items of one id are one item.
    Rows of docs stay as they are, repeated or with a null id. There is no shuffle of documents with one block of items. With more, leaked texts are found block by block and joined by two 64-bit
    hashes of the text, so only the kept columns are shuffled, if the leaked texts are too many to be broadcast.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"leaked", "n_items", "items", "least_edits"} & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    text, context = docs["text"].alias("__text"), docs.sparkSession.sparkContext
    found = blocks(benchmark)
    block, later = next(found, make_block([])), next(found, None)
    if later is None:
        rows = text_batches(docs).select(*keep, text).mapInArrow(_searched(context.broadcast(block), keep, False), fields + "__items array<long>, __edits int")
    else:
        keys = [F.xxhash64(docs["text"]).alias("__k1"), F.xxhash64(F.lit(1), docs["text"]).alias("__k2")]
        leaks = None
        while block is not None:
            search = _searched(context.broadcast(block), ["__k1", "__k2"], True)
            own = written(text_batches(docs).filter("text is not null").select(*keys, text).mapInArrow(search, "__k1 long, __k2 long, __items array<long>, __edits int"), "leaks")
            leaks = own if leaks is None else leaks.union(own)
            block, later = later, next(found, None)
        leaks = leaks.groupBy("__k1", "__k2").agg(F.array_distinct(F.flatten(F.collect_set("__items"))).alias("__items"), F.min("__edits").alias("__edits"))
        rows = docs.select(*keep, *keys).join(leaks, ["__k1", "__k2"], "left").withColumn("__items", F.coalesce("__items", F.array().cast("array<long>")))
    items = F.sort_array("__items")
    return rows.select(*keep, (F.size("__items") > 0).alias("leaked"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col("__edits").alias("least_edits"))
