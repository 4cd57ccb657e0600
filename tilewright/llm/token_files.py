"""Token ids in ORC files: stripes with integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt out by ranges of their id, sorted, and encoded, so that each file holds one range in ascending order and a reader finds a
document by file, stripe and row-group statistics. Stripes are read in parallel and each row's columns are read by themselves.

A byte-level pair-merge tokenizer first cuts a text into words by a pattern; a space or line feed between two characters that aren't white space always begins a
word, and a line feed there ends one too. Each worker has the tokenizers library encode each distinct piece between such places once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.ordered import key, ranges_of, text_hash
from tilewright.llm.segments import SegmentStore
from tilewright.llm.text import BYTE_HASH, sliced, span_check, span_hash, utf8
from tilewright.session import text_batches

#: Documents in one file.
FILE_ROWS = 8192

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True


def piece_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in data where a row begins, or a word of the pattern must begin."""
    n = len(data)
    left, right = _GRAPHIC[data], _GRAPHIC[data].copy()
    # letters of two bytes that begin with 0xC3 count too; of other characters some are white space
    lead = data == 0xC3
    left = left.copy()
    left[1:] |= lead[:-1]
    right |= lead
    alone = np.zeros(n, bool)
    if n > 2:
        alone[1:-1] = left[:-2] & right[2:]
    begins = alone & ((data == 0x20) | (data == 0x0A))
    begins[1:] |= alone[:-1] & (data[:-1] == 0x0A)
    begins[rows[rows < n]] = True
    return np.flatnonzero(begins)


class TokenEncoder:
    """The tokenizers library over distinct pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.store = SegmentStore()

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows (from, to): the ids of all rows end to end, each with its end id, and the n + 1 offsets of the rows."""
        data, offsets = utf8(column)
        for i, j in sliced(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                yield i, j, np.full(j - i, end, np.int32), np.arange(j - i + 1)
                continue
            starts = piece_starts(part, at[:-1][np.diff(at) > 0])
            ends = np.append(starts[1:], len(part))
            raw = part.tobytes()

            def fresh(k: np.ndarray, starts=starts, ends=ends, raw=raw) -> tuple[np.ndarray, np.ndarray]:
                texts = [raw[a:b].decode() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]
                lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
                return np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)

            ids, n = self.store.lookup(span_hash(BYTE_HASH[part], starts, ends), span_check(BYTE_HASH[part], starts, ends), fresh)
            first = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, at)]
            out = np.full(len(ids) + (j - i), end, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(first))] = ids
            yield i, j, out, first + np.arange(j - i + 1)


@lru_cache(maxsize=2)
def encoder(path: str) -> TokenEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return TokenEncoder(path)


_COLUMNS = "part int, place long, first long, doc_id long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 0, file_rows: int = FILE_ROWS, bloom: bool = True) -> None:
    """Writes docs (doc_id, text) as ORC files, each a range of ids, in ascending doc_id order: part, place (the row's number in its part), first (ids before it in its part), doc_id, n_tokens, ids.

    tokenizer: path of a tokenizer file that every executor has. end: the id appended to each document. A null text is the empty text. Null ids come
    first; rows of one id are ordered by a hash of their text, then by the text. Other columns aren't read. Nothing is written for an empty table but its schema.
    """
    docs = text_batches(docs).select("doc_id", "text")
    ranges = ranges_of(docs, file_rows)
    dealt = docs.select("doc_id", "text", key().alias("id"), text_hash().alias("h"))
    dealt = dealt.withColumn("part", ranges.number(F.col("id"), F.col("h")))
    dealt = dealt.repartitionById(len(ranges), "part").sortWithinPartitions("part", "id", "h", F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        here, place, first = None, 0, 0
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]):
                if a < b and parts[a] != here:
                    here, place, first = parts[a], 0, 0
                for i, j, ids, at in known.encode(batch.column("text").slice(a, b - a), end):
                    rows = batch.slice(a + i, j - i)
                    arrays = [rows.column("part"), pa.array(np.arange(place, place + j - i)), pa.array(first + at[:-1]), rows.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "place", "first", "doc_id", "n_tokens", "ids"])
                    place, first = place + j - i, first + int(at[-1])

    out = dealt.select("part", "doc_id", "text").mapInArrow(run, _COLUMNS)
    options = {"orc.create.index": "true", "orc.row.index.stride": "1024", "orc.stripe.size": str(16 << 20), "compression": "snappy"}
    options |= {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"} if bloom else {}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(part, place, first, doc_id, n_tokens, ids) of the files; with doc_ids only those, pruned by statistics and Bloom filters."""
    df = spark.read.schema(_COLUMNS).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "first", "doc_id")), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["part", "first", "doc_id", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers).

    A row's place within its part is in the file; the parts' totals (a row for each range, which are bounded in number) are summed up and broadcast.
    """
    tokens = read_tokens(spark, path)
    totals = tokens.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    digest = tokens.mapInArrow(_digest, "part int, first long, doc_id long, n_tokens long, ids_crc32 long")
    return digest.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
