"""Dealing rows out in the order of an integer id, in ranges of about even bytes, each of which is one task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most, and rows of the sample (in the mean) for each: they bound what the driver and each task hold of the bounds (about 40 MB, and 400 KB). With more data ranges grow, and are sorted on disk.
MOST_RANGES, SAMPLED = 25_000, 64
#: Null ids stand as the smallest integer.
NULL_ID = -(1 << 63)
#: What a row weighs beside the bytes of its text.
ROW_BYTES = 200


def key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(NULL_ID))


def text_hash(text: str = "text") -> Column:
    """Tells rows of one id apart, so that an id with many texts is spread over ranges."""
    return F.xxhash64(text)


@dataclass
class Ranges:
    """Lower bounds of all ranges but the first, in ascending order of (id, hash of the text)."""

    ids: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.ids) + 1

    def find(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each row's range: how many bounds are at or below it."""
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(self.ids), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            below = (self.ids[mid] < ids[open_]) | (self.ids[mid] == ids[open_]) & (self.hashes[mid] <= hashes[open_])
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low

    def number(self, id_: Column, hash_: Column) -> Column:
        """The range's number as a column; only the two keys go to Python."""

        @F.pandas_udf("int")
        def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for ids, hashes in batches:
                yield pd.Series(self.find(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)).astype(np.int32))

        return part(id_, hash_) if len(self.ids) else F.lit(0)


def ranges_of(docs: DataFrame, rows_per_range: int) -> Ranges:
    """Bounds for docs (doc_id, text) from a bounded sample: ranges of about so many rows, or more where that would be over MOST_RANGES, balanced by bytes.

    The sample only settles how even the ranges are.
    """
    n = docs.count()
    parts = min(-(-n // rows_per_range), MOST_RANGES)
    if parts < 2:
        return Ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys = docs.select(key().alias("id"), text_hash().alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("w"))
    got = keys.sample(min(1.0, SAMPLED * parts / n), seed=7).toArrow()
    ids, hashes, weight = (got.column(c).to_numpy() for c in ("id", "h", "w"))
    order = np.lexsort((hashes, ids))
    ids, hashes, total = ids[order], hashes[order], np.cumsum(weight[order])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts) if len(ids) else np.zeros(0, np.int64)
    at = np.unique(np.minimum(at, len(ids) - 1))
    new = np.ones(len(at), bool)
    new[1:] = (ids[at[1:]] != ids[at[:-1]]) | (hashes[at[1:]] != hashes[at[:-1]])
    return Ranges(ids[at[new]], hashes[at[new]])
