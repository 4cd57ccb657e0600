"""Byte-pair pieces as the sentencepiece library makes them: encoding by vectorised merge rounds, and decoding.

A text is " " + text with each space as U+2581. No piece has that mark behind another character, so no merge crosses the start of a run of
marks; nor does one cross a character that no longer piece has, such as a line feed. Texts are cut there into segments, and each worker
encodes each distinct segment once. New segments are cut further between any two characters that no piece has side by side, and all are merged at once:
in each round every segment's pairs of minimal rank are merged, the leftmost of those that overlap, and the flat symbol arrays are compacted, until no
pair remains. Characters that aren't pieces become byte pieces.

The library merges one pair at a time, the leftmost of the best. A round does the same merges: as long as none of them makes a pair that is as good or better,
the next best pair is the next of that round. Where one does, the round's later merges in that segment wait. Long segments are divided into units, each with its minimum, so that a
round only looks at units that hold a merge, and the arrays are compacted when half of them are merged away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tilewright.llm.segments import SegmentStore
from tilewright.llm.text import BYTE_HASH, ranges, sliced, span_check, span_hash, utf8
from tilewright.session import text_batches

MARK = "▁"
#: Symbols in one unit of a segment.
UNIT = 256
_NONE = np.int64(1) << 40


class PieceModel:
    """The pieces of a model file, and the ranks of the pairs that merge."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, normal = model.normalizer_spec, model.SentencePiece.NORMAL if hasattr(model, "SentencePiece") else 1
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only pair-merge models with byte fallback, a dummy prefix and no other normalisation are supported")
        self.end = self.library.eos_id()
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece with a space inside")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.names = [str(i) for i in range(len(model.pieces))]
        # symbols: pieces by id, then characters that occur in pieces but aren't pieces themselves
        symbol = {p: i for p, (i, _) in pieces.items()}
        for c in sorted({c for p in pieces for c in p if c not in symbol}):
            symbol[c] = len(model.pieces) + len(symbol)
        self.symbol = symbol
        self.char = {c: s for c, s in symbol.items() if len(c) == 1}
        self.barriers = {c for c in ("\n", "\t", "\r") if not any(c in p and len(p) > 1 for p in pieces)}
        order = {s: r for r, s in enumerate(sorted({score for _, score in pieces.values()}, reverse=True))}
        pairs = {}
        for p, (i, score) in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] << 32 | symbol[p[k:]]] = (order[score], i)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()], np.int64)
        self.pair_made = np.array([pairs[k][1] for k in self.pair_key.tolist()], np.int64)
        # pieces that are part of a pair of their own rank or a better one: making them may put another pair first
        of = {i: order[score] for i, score in pieces.values()}
        self.early = np.zeros(max(symbol.values()) + 1, bool)
        self.early[[x for key, (rank, _) in pairs.items() for x in (key >> 32, key & 0xFFFFFFFF) if rank <= of.get(x, -1)]] = True
        self.beside = np.array(sorted({ord(p[k]) << 32 | ord(p[k + 1]) for p in pieces for k in range(len(p) - 1)}), np.int64)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (_NONE: no merge) and the pieces that they make."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_made[at]

    def merge_rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges flat symbols (below 0: never merges), of ascending segments, until no pair remains; returns what is left."""
        done_symbols, done_segments = [], []
        while len(symbols):
            symbols, segment, open_ = self._rounds(symbols, segment)
            keep = ~open_[segment]
            done_symbols.append(symbols[keep])
            done_segments.append(segment[keep])
            symbols, segment = symbols[~keep], segment[~keep]
        if not done_symbols:
            return symbols, segment
        symbols, segment = np.concatenate(done_symbols), np.concatenate(done_segments)
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounds until half of the symbols are merged away or no pair remains: the compacted arrays, and which segments still have pairs."""
        symbols, n = symbols.copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        new = np.ones(n, bool)
        new[1:] = segment[1:] != segment[:-1]
        rank, made = np.full(n, _NONE), np.zeros(n, np.int64)
        rank[:-1], made[:-1] = self._ranked(symbols[:-1], symbols[1:])
        rank[:-1][new[1:]] = _NONE
        head = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        unit_start = np.flatnonzero(place % UNIT == 0)
        unit = np.repeat(np.arange(len(unit_start)), np.diff(np.append(unit_start, n)))
        unit_size = np.diff(np.append(unit_start, n))
        unit_segment = segment[unit_start]
        unit_head = np.flatnonzero(np.concatenate(([True], unit_segment[1:] != unit_segment[:-1])))
        unit_least = np.minimum.reduceat(rank, unit_start)
        sizes = np.diff(np.append(unit_head, len(unit_start)))
        live, dead = np.ones(n, bool), 0
        while True:
            least = np.minimum.reduceat(unit_least, unit_head)
            found = np.repeat(least, sizes)
            units = np.flatnonzero((unit_least == found) & (found < _NONE))
            if not len(units) or 2 * dead > n:
                break
            at = ranges(unit_start[units], unit_size[units])
            at = at[rank[at] == np.repeat(found[units], unit_size[units])]
            # of pairs that overlap the leftmost merges: every second one of a run
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            index = np.arange(len(at))
            run = np.maximum.accumulate(np.where(chained, 0, index))
            at = at[(index - run) % 2 == 0]
            at = self._unhindered(at, symbols, segment, after, before, rank, made)
            gone = after[at]
            symbols[at] = made[at]
            rank[gone], live[gone] = _NONE, False
            onward = after[gone]
            after[at] = onward
            before[onward[onward < n]] = at[onward < n]
            beside = before[at]
            beside = beside[beside >= 0]
            for i in (at, beside):  # only the pairs beside what was merged change
                j = np.minimum(after[i], n - 1)
                r, made[i] = self._ranked(symbols[i], symbols[j])
                rank[i] = np.where((after[i] < n) & (segment[i] == segment[j]), r, _NONE)
            dead += len(at)
            touched = np.unique(unit[np.concatenate((at, beside, gone))])
            size = unit_size[touched]
            unit_least[touched] = np.minimum.reduceat(rank[ranges(unit_start[touched], size)], np.cumsum(size) - size)
        open_ = np.zeros(int(segment[-1]) + 1, bool)
        open_[unit_segment[unit_head]] = least < _NONE
        return symbols[live], segment[live], open_

    def _unhindered(self, at: np.ndarray, symbols: np.ndarray, segment: np.ndarray, after: np.ndarray, before: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """The merges of a round up to and with the first of each segment that makes a pair that is as good or better."""
        if not self.early[made[at]].any():
            return at
        n = len(symbols)
        left, right = before[at], after[after[at]]
        merged = np.zeros(len(at), bool)
        merged[1:] = right[:-1] == at[1:]
        previous = np.where(merged, made[np.roll(at, 1)], symbols[left])
        a, _ = self._ranked(previous, made[at])
        b, _ = self._ranked(made[at], symbols[np.minimum(right, n - 1)])
        a[(left < 0) | (segment[left] != segment[at])] = _NONE
        b[(right >= n) | (segment[np.minimum(right, n - 1)] != segment[at])] = _NONE
        hinders = np.minimum(a, b) <= rank[at]
        earlier = np.cumsum(hinders) - hinders
        of = segment[at]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        return at[earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and the number of each; segments already have marks for spaces."""
        char, text = self.char, "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        table = np.array([char.get(chr(c), -1 - int(c)) for c in kinds.tolist()], np.int64)
        symbols = table[back] if len(kinds) else np.zeros(0, np.int64)
        segment = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        # no piece goes over two characters that no piece has side by side
        wide = points.astype(np.int64)
        pair = wide[:-1] << 32 | wide[1:]
        cut = np.ones(len(points), bool)
        cut[1:] = (segment[1:] != segment[:-1]) | (self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair)
        left, where = self.merge_rounds(symbols, np.cumsum(cut) - 1)
        where = segment[np.flatnonzero(cut)][where]
        # what isn't a piece goes to bytes
        odd = np.flatnonzero((left < 0) | (left >= len(self.names)))
        if odd.size:
            names = {s: c for c, s in self.char.items() if s >= len(self.names)}
            spelt = {s: [self.bytes[b] for b in (names[s] if s >= 0 else chr(-1 - s)).encode()] for s in set(left[odd].tolist())}
            flat, count = list(left.tolist()), np.ones(len(left), np.int64)
            for i in odd.tolist():
                flat[i] = spelt[flat[i]]
                count[i] = len(flat[i])
            left = np.array([x for s in flat for x in (s if isinstance(s, list) else (s,))], np.int64)
            where = np.repeat(where, count)
        return left.astype(np.int32), np.bincount(where, minlength=len(segments))

    def encode(self, column: pa.Array, store: SegmentStore) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows (from, to): the ids of all rows end to end, each with its end id, and the n + 1 offsets of the rows."""
        column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
        empty = pc.equal(pc.binary_length(column), 0)
        column = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        data, offsets = utf8(column)
        for i, j in sliced(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                yield i, j, np.full(j - i, self.end, np.int32), np.arange(j - i + 1)
                continue
            blank = part == 0x20
            begins = blank.copy()
            begins[1:] &= ~blank[:-1]
            for c in self.barriers:
                cut = part == ord(c)
                begins |= cut
                begins[1:] |= cut[:-1] & ~blank[1:]
            begins[at[:-1][np.diff(at) > 0]] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(part))
            raw = part.tobytes()

            def fresh(k: np.ndarray, starts=starts, ends=ends, raw=raw) -> tuple[np.ndarray, np.ndarray]:
                return self.encode_segments([raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])

            ids, n = store.lookup(span_hash(BYTE_HASH[part], starts, ends), span_check(BYTE_HASH[part], starts, ends), fresh)
            first = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, at)]  # the first id of each row
            out = np.full(len(ids) + (j - i), self.end, np.int32)
            row = np.repeat(np.arange(j - i), np.diff(first))
            out[np.arange(len(ids)) + row] = ids
            yield i, j, out, first + np.arange(j - i + 1)


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[PieceModel, SegmentStore]:
    """The model of a file and this worker's store for it."""
    return PieceModel(path), SegmentStore(600_000, 6_000_000)


def encode_decode(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text with an end id and decodes the ids again: one row per row of docs.

    model: path of a model file that every executor has. keep: the columns of docs to carry (doc_id). Columns that follow: n_tokens, ids_sha256 (of the decimal ids joined by
    a space), decoded_sha256, and ids (array<int>) if asked for. Null is the empty text, which has the end id only and decodes to the empty text. Repeated rows and null
    ids stay as they are. There is no shuffle. Columns of docs named like the new ones are left out unless kept under another name.
    """
    keep = keep or ["doc_id"]
    clash = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(keep)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, store = loaded(model)
        for batch in batches:
            n, digest, back, lists = [], [], [], []
            for i, j, ids, at in pieces.encode(batch.column("__text"), store):
                names = [pieces.names[x] for x in ids.tolist()]
                whole = ids.tolist()
                bounds = at.tolist()
                spans = [(bounds[r], bounds[r + 1]) for r in range(j - i)]
                n += [b - a for a, b in spans]
                digest += [hashlib.sha256(" ".join(names[a:b]).encode()).hexdigest() for a, b in spans]
                back += [hashlib.sha256(x.encode()).hexdigest() for x in pieces.library.decode([whole[a:b] for a, b in spans], num_threads=1)]
                if with_ids:
                    lists += [ids[a:b] for a, b in spans]
            columns = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return text_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, fields)
