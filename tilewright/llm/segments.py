"""A bounded store of what distinct segments of text (found by a 64-bit hash, and checked by another of 32 bits) encode to, kept by each Python worker between batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tilewright.llm.text import U64, ranges

#: Slots of the direct table (a power of two), and segments after which the store starts again.
SLOT_BITS, MOST_SEGMENTS, MOST_VALUES = 21, 1_500_000, 16_000_000


class SegmentStore:
    """encode gets the indexes of new segments and returns their values end to end and the number of values of each."""

    def __init__(self, most_segments: int | None = None, most_values: int | None = None) -> None:
        self.most_segments, self.most_values = most_segments or MOST_SEGMENTS, most_values or MOST_VALUES
        self.clear()

    def clear(self) -> None:
        self.slot_hash, self.slot_item = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, np.int32)
        self.rest_hash, self.rest_item = np.zeros(0, U64), np.zeros(0, np.int32)
        self.start, self.length, self.check, self.values = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.uint32), np.zeros(1 << 14, np.int32)
        self.items = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        item = np.where(self.slot_hash[slot] == h, self.slot_item[slot], -1)
        if len(self.rest_hash):
            left = np.flatnonzero(item < 0)
            at = np.minimum(np.searchsorted(self.rest_hash, h[left]), len(self.rest_hash) - 1)
            item[left] = np.where(self.rest_hash[at] == h[left], self.rest_item[at], -1)
        return item

    def _add(self, h: np.ndarray, check: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(h), len(values)
        while self.items + n > len(self.start):
            self.start, self.length, self.check = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.check))
        while self.used + m > len(self.values):
            self.values = np.resize(self.values, 2 * len(self.values))
        item = np.arange(self.items, self.items + n, dtype=np.int32)
        self.start[item], self.length[item], self.check[item] = self.used + np.cumsum(lengths) - lengths, lengths, check
        self.values[self.used : self.used + m] = values
        self.items, self.used = self.items + n, self.used + m
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slot_hash[slot] == 0
        self.slot_hash[slot[free]], self.slot_item[slot[free]] = h[free], item[free]
        kept = self.slot_hash[slot] == h
        if not kept.all():
            order = np.argsort(joined := np.concatenate((self.rest_hash, h[~kept])))
            self.rest_hash, self.rest_item = joined[order], np.concatenate((self.rest_item, item[~kept]))[order]

    def lookup(self, h: np.ndarray, check: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The values of the segments with these hashes, end to end, and how many each has. Where two segments share the first hash only, nothing is looked up."""
        item = self._find(h)
        if ((item >= 0) & (self.check[item] != check)).any():
            return encode(np.arange(len(h)))
        if (missing := np.flatnonzero(item < 0)).size:
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if (check[missing] != check[missing[first]][back]).any():
                return encode(np.arange(len(h)))
            values, lengths = encode(missing[first])
            if self.items + len(new) > self.most_segments or self.used + len(values) > self.most_values:
                had_start, had_length, had_values = self.start, self.length, self.values
                kept = np.flatnonzero(item >= 0)
                n = np.zeros(len(h), np.int64)
                n[kept], n[missing] = had_length[item[kept]], lengths[back]
                own_start = np.cumsum(lengths) - lengths
                out = np.empty(int(n.sum()), np.int32)
                at = np.cumsum(n) - n
                out[ranges(at[kept], n[kept])] = had_values[ranges(had_start[item[kept]], n[kept])]
                out[ranges(at[missing], n[missing])] = values[ranges(own_start[back], n[missing])]
                self.clear()
                if len(new) <= self.most_segments and len(values) <= self.most_values:
                    self._add(new, check[missing[first]], values, lengths)
                return out, n
            base = self.items
            self._add(new, check[missing[first]], values, lengths)
            item[missing] = base + back
        n = self.length[item].astype(np.int64)
        return self.values[ranges(self.start[item], n)], n
