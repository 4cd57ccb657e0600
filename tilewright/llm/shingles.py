"""Word shingles of whole texts.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A text's set holds the 64-bit hashes of its
distinct runs of five words; a text of one to four words has the whole sequence as its only member; a text without words,
or null, has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tilewright.llm.text import BYTE_HASH, U64, mix, sliced, span_hash, stream, utf8

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = BYTE_HASH.copy()
_LOWER[0x41:0x5B] = BYTE_HASH[0x61:0x7B]
_PLACE = stream(23, 64) | U64(1)


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the rows in data, and each row's first word (n + 1 indexes); gaps tells which bytes are between words."""
    solid = ~gaps[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int = WORDS) -> list[tuple[int, int, np.ndarray]]:
    """For each row two 64-bit hashes of its word sequence, and the sorted hashes of its set."""
    data, offsets = utf8(column)
    out = []
    for i, j in sliced(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, row = words(part, at)
        word = span_hash(_LOWER[part], starts, ends)
        n = np.diff(row)
        # five-word runs, of which those that cross rows aren't used
        run = np.zeros(max(0, len(word) - size + 1), U64)
        for k in range(size):
            run += word[k : len(word) - size + 1 + k] * _PLACE[k] if len(run) else 0
        run = mix(run)
        for r in range(j - i):
            a, b = row[r], row[r + 1]
            if n[r] == 0:
                out.append((0, 0, run[:0]))
                continue
            own = word[a:b]
            order = np.arange(len(own), dtype=U64)
            keys = [int(mix(np.array([np.sum(mix(own + order * U64(c))) + U64(n[r])]))[0]) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            if n[r] < size:
                members = np.array([keys[0]], U64)
            else:
                members = np.sort(run[a : b - size + 1])
                members = members[np.concatenate(([True], members[1:] != members[:-1]))]
            out.append((keys[0], keys[1], members))
    return out
