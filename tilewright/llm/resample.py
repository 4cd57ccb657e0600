"""Importance resampling of documents towards a target text set, with hashed n-grams of words.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that isn't a letter or digit, so that bytes.split() yields the words. A run of words is
hashed by zlib.crc32 over its words joined by one space: the hash of a run seeds that of the run with one word more. Runs fall into buckets; Counters of
each task are summed to the bucket counts of the documents and of the target. A bucket's gain is a scaled log ratio of the two, a document's weight the
mean gain of its runs, and its score the weight plus noise of a Gumbel distribution that depends on the id only. The highest scores are drawn.

Null and empty texts, and texts without a word, have no features and weight 0. A row without an id has no noise: its score and rank are null and it is never
drawn, nor does it count as drawable. Rows that repeat an id are rows of their own; equal ones are ranked one after the other. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import text_batches, written

#: Words of the longest run, buckets, and the factor that log ratios are scaled by before they are floored.
ORDER, BUCKETS, SCALE = 2, 10_000, 1000
#: Documents with fewer words aren't drawn; percent of the others that is drawn; the noise's seed.
FEWEST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a text that are split at once.
PART_BYTES = 1 << 22

_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def parts(text: bytes, most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in order, in lists of a bounded number of bytes (a longer word is whole)."""
    clean = text.translate(_TABLE)
    at = 0
    while len(clean) - at > most:
        end = clean.rfind(b" ", at, at + most)
        if end < 0:
            end = clean.find(b" ", at + most)
            if end < 0:
                break
        yield clean[at:end].split()
        at = end + 1
    yield (clean[at:] if at else clean).split()


def feature_buckets(text: bytes, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of a text its number of words and the buckets of all runs of 1 to order words that end in it."""
    before: list[list[int]] = [[] for _ in range(order - 1)]  # the hash of the run of each length that ends with the last word
    for words in parts(text):
        if not words:
            continue
        ended = list(map(crc32, words))
        every = [ended]
        for k in range(order - 1):
            # runs of k + 1 words that end at each word's left neighbour seed those of k + 2 words
            seeds = before[k] + ended[:-1]
            longer = list(map(crc32, words[len(words) - len(seeds) :], map(crc32, repeat(b" "), seeds)))
            before[k] = ended[-1:]
            every.append(longer)
            ended = longer
        yield len(words), np.array([h for hashes in every for h in hashes], np.int64) % buckets


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is in all texts of docs (text). Each task reduces its texts to one Counter, so buckets x tasks rows are shuffled and as many as there are buckets come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch, "text"):
                for _, own in feature_buckets(text, order, buckets):
                    found.update(own.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["bucket", "n"])

    got = text_batches(docs).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket, in doubles."""
    n, all_docs, all_target = len(docs), float(docs.sum()) + len(docs), float(target.sum()) + len(docs)
    return np.array([math.floor(SCALE * math.log((float(target[b]) + 1) * all_docs / ((float(docs[b]) + 1) * all_target))) for b in range(n)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the features' gains) of every row of docs (doc_id, text). No shuffle."""
    buckets = len(gains)
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(_texts(batch, "text")):
                for words, own in feature_buckets(text, order, buckets):
                    out[:, row] += (words, len(own), gains[own].sum())
            out[2] //= np.maximum(out[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, fields)


def noise(seed: int = SEED) -> Callable:
    """floor(-1000 ln(-ln u)) as a column, u from the first 32 bits of the sha256 of seed:doc_id."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((first + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, and more), with rank: 1, 2, 3 ... for the floor(percent N / 100) highest scores of the N rows with enough words, in the order of score (descending) and doc_id; null for the others.

    Scores are whole numbers between bounds that logarithms of 64-bit counts set (some 200,000 at most), so the number of rows of each score comes to the
    driver: it settles the lowest score that is drawn and the rank that each score begins with. Rows of one score, which the noise keeps few, are ordered by id.
    """
    able = (F.col("n_words") >= fewest_words) & F.col("score").isNotNull()
    got = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    value, n = got.column("score").to_numpy(), got.column("n").to_numpy()
    at = np.argsort(-value)
    value, n = value[at], n[at]
    before, most = np.cumsum(n) - n, percent * int(n.sum()) // 100
    value, before = value[before < most], before[before < most]
    if not len(value):
        return scored.withColumn("rank", F.lit(None).cast("long"))
    spark, lowest = scored.sparkSession, int(value[-1])
    begins = spark.createDataFrame(pa.table({"score": value, "__before": before}))
    high = able & (F.col("score") >= lowest)
    ranked = scored.filter(high).join(F.broadcast(begins), "score").withColumn("rank", F.col("__before") + F.row_number().over(W.partitionBy("score").orderBy("doc_id")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("__before")
    return ranked.unionByName(scored.filter(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_words, n_features, weight, score and rank, by importance for target (text). Texts are read twice and never shuffled."""
    gains = bucket_gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    scored = weigh(docs, gains, order).withColumn("score", F.col("weight") + noise(seed))
    return draw(written(scored, "weights"), percent, fewest_words)
