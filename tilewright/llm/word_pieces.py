"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces stand in one trie with two roots: for pieces that begin a word and for those that go on. Each node has a failure link and the number of pieces that are
complete when it is followed, worked out beforehand, so that reading a word byte by byte counts its greedy longest-match pieces in linear time
without making any. All new words of a batch are read at once, one byte of each in a step; each worker reads each distinct word once.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.segments import SegmentStore
from tilewright.llm.shingles import words
from tilewright.llm.text import BYTE_HASH, sliced, span_check, span_hash, utf8
from tilewright.session import text_batches

ROOT, MORE, NONE = 0, 1, -1


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word, and pieces that go on, of a byte-level vocabulary file: those with a space before them begin one.

    The empty piece among the first is a space by itself: a word may begin with it and go on with pieces of the second kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {t["content"] for t in known["added_tokens"]}
    pieces = [bytes(spelt[c] for c in t) for t in known["model"]["vocab"] if t not in special]
    return [p[1:] for p in pieces if p[0] == 32], [p for p in pieces if p[0] != 32]

#: So many words are walked by themselves.
FEW = 4


class Automaton:
    def __init__(self, first: Iterable[bytes], more: Iterable[bytes], lone_space: bool = False) -> None:
        first = set(first)
        children: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((ROOT, first), (MORE, more)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in children[at]:
                        children[at][b] = len(children)
                        children.append({})
                        whole.append(False)
                    at = children[at][b]
                whole[at] = whole[at] or bool(piece)
        link, pops = [NONE] * len(children), [0] * len(children)
        if lone_space and b"" in first:
            link[ROOT], pops[ROOT] = MORE, 1
        queue = deque([ROOT, MORE])
        while queue:
            u = queue.popleft()
            for b, v in children[u].items():
                if whole[v]:
                    link[v], pops[v] = MORE, 1
                else:
                    z, n = link[u], pops[u]
                    while z != NONE and b not in children[z]:
                        z, n = link[z], n + pops[z]
                    link[v], pops[v] = (children[z][b], n) if z != NONE else (NONE, 0)
                queue.append(v)
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        moves = sorted((u << 8 | b, v) for u, own in enumerate(children) for b, v in own.items())
        self.move = np.array([k for k, _ in moves], np.int64)
        self.to = np.array([v for _, v in moves], np.int64)
        self.moves = dict(moves)

    def _follow(self, at: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.move):
            return np.full(len(at), NONE)
        key = at << 8 | b
        k = np.minimum(np.searchsorted(self.move, key), len(self.move) - 1)
        return np.where(self.move[k] == key, self.to[k], NONE)

    def _walk(self, at: int, n: int, rest: bytes) -> tuple[int, int]:
        """State and popped pieces after the other bytes of one word."""
        for b in rest:
            while (to := self.moves.get(at << 8 | b, NONE)) == NONE:
                n += int(self.pops[at])
                if (at := int(self.link[at])) == NONE:
                    return at, n
            at = to
        return at, n

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; -1 for a word that the vocabulary can't spell."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        size, starts = size[order], starts[order]
        at, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            live = np.arange(np.searchsorted(-size, -k, "left"))  # words longer than k
            live = live[at[live] != NONE]
            if len(live) <= FEW:  # the ends of the longest words are walked one by one
                for w in live.tolist():
                    at[w], n[w] = self._walk(int(at[w]), int(n[w]), data[starts[w] + k : starts[w] + size[w]].tobytes())
                break
            b = data[starts[live] + k].astype(np.int64)
            while len(live):
                to = self._follow(at[live], b)
                went = to != NONE
                at[live[went]] = to[went]
                live, b = live[~went], b[~went]
                n[live] += self.pops[at[live]]
                at[live] = self.link[at[live]]
                stays = at[live] != NONE
                live, b = live[stays], b[stays]
        live = np.flatnonzero((at != NONE) & (at != MORE))
        while len(live):
            n[live] += self.pops[at[live]]
            at[live] = self.link[at[live]]
            live = live[(at[live] != NONE) & (at[live] != MORE)]
        out = np.empty(len(size), np.int64)
        out[order] = np.where(at == NONE, -1, n)
        return out


@lru_cache(maxsize=2)
def loaded(path: str, lone_space: bool = False) -> tuple[Automaton, SegmentStore]:
    return Automaton(*byte_vocabulary(path), lone_space), SegmentStore()


def count_pieces(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, lone_space: bool = False) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), n_words, n_tokens, n_unknown.

    vocabulary: path of a byte-level vocabulary file that every executor has. Words are runs between ASCII white space, as they are. With lone_space a word that no piece with a space begins
    has the space as a token by itself, so it is spelt as the vocabulary spells the word after a space. A word that can't be spelt is one token, counted in n_unknown too. Null and empty texts have none. Repeated rows and null ids stay as they are. No shuffle.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"n_words", "n_tokens", "n_unknown"} & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "n_words long, n_tokens long, n_unknown long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, store = loaded(vocabulary, lone_space)
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            out = [np.zeros((0, 3), np.int64)]
            for i, j in sliced(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = words(part, at)

                def fresh(k: np.ndarray, part=part, starts=starts, ends=ends) -> tuple[np.ndarray, np.ndarray]:
                    return automaton.lengths(part, starts[k], ends[k]).astype(np.int32), np.ones(len(k), np.int64)

                n = store.lookup(span_hash(BYTE_HASH[part], starts, ends), span_check(BYTE_HASH[part], starts, ends), fresh)[0].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
                total = np.concatenate(([0], np.cumsum(np.where(n < 0, 1, n))))[first]
                lost = np.concatenate(([0], np.cumsum(n < 0)))[first]
                out.append(np.stack([np.diff(first), np.diff(total), np.diff(lost)], axis=1))
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(table[:, k]) for k in range(3)], [*keep, "n_words", "n_tokens", "n_unknown"])

    return text_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, fields)
