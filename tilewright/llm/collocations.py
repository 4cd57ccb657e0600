"""Phrase collocations of each language: phrases of two to five words that stand together more often than their parts would by chance.

A-Z are lower-cased, texts are split at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words. Words are known by 64-bit hashes of language and word; the
counts of all words are kept with their spelling, and a seed by which two words of the corpus share a hash is given up for the next. For each place of a text there is one window:
the word and lead columns with the four after it, padded behind the end of its piece. Only whole windows are counted; a ROLLUP over their columns sums them to
the counts of all shorter prefixes, each of which is a phrase.

A window is also padded from the first pair of words on that can't be in a phrase of enough occurrences: of which a word, or the pair, has too few. Pairs are looked up in a bit table of
bounded size, made from exact counts; a pair that only shares a bit makes a longer window, no other result.

Null texts are empty, a null language is `und`, rows count as often as they are there, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.shingles import words
from tilewright.llm.text import U64, mix, ranges, sliced, span_check, span_hash, stream, utf8
from tilewright.session import discard, text_batches, written

#: Words of the longest phrase, occurrences that a phrase needs, rows of each language's report, and the factor of scores.
LONGEST, FEWEST, TOP, SCALE = 5, 100, 2000, 1000
#: A phrase is dropped if a longer one around it has so many percent of its occurrences.
COVERED = 100
#: Bits of the largest bit table (8 MB), and bits for each of its members where that many suffice.
MOST_BITS, BITS_EACH = 1 << 26, 16
#: Parts in which a language's best phrases are picked before they are ranked together.
PICKS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_STEP = U64(0x9E3779B97F4A7C15)
_W = [f"w{k}" for k in range(1, LONGEST + 1)]


def _tokens(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the batch: the lower-cased bytes, starts, ends, rows and hashes of the words, and which word is in the same piece as the one after it."""
    data, offsets = utf8(batch.column("text"))
    lang, lang_at = utf8(batch.column("lang"))
    values = stream(seed, 256)
    of_lang = mix(span_hash(values[lang], lang_at[:-1], lang_at[1:]) + _STEP)
    for i, j in sliced(offsets):
        part, at = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, at, _GAP)
        if not len(starts):
            continue
        row = np.repeat(np.arange(i, j), np.diff(first))
        value = values[part]
        h = mix((span_hash(value, starts, ends) ^ (span_check(value, starts, ends).astype(U64) * _STEP)) + of_lang[row])
        h[h == 0] = 1  # 0 is the padding
        piece = np.cumsum(_BREAK[part])[starts]
        joined = np.zeros(len(h), bool)
        joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        yield part, starts, ends, row, h, joined


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how often each is there."""
    key = np.zeros(len(columns[0]), U64)
    for c in columns:
        key = mix(key * _STEP + c)
    _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((c[first][which] != c).any() for c in columns):  # two rows share a key
        return columns, np.ones(len(key), np.int64)
    return [c[first] for c in columns], n.astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + b)


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & U64(64 * len(bits) - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def bit_table(df: DataFrame, members: int, column: str = "key") -> np.ndarray:
    """A table with the bit of each key set. Its size is bounded, and so is what comes to the driver."""
    size = 1 << 12
    while size < min(members * BITS_EACH, MOST_BITS):
        size *= 2
    at = F.col(column).bitwiseAND(F.lit(size - 1))
    got = df.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(U64)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """key, lang, word, f for every word of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, starts, ends, row, h, _ in _tokens(batch, seed):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                size = (ends - starts)[first]
                raw = np.ascontiguousarray(part[ranges(starts[first], size)])
                at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                word = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(raw)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), batch.column("lang").take(pa.array(row[first])), word, pa.array(n.astype(np.int64))], ["key", "lang", "word", "f"])

    return docs.mapInArrow(run, "key long, lang string, word string, f long").groupBy("key", "lang", "word").agg(F.sum("f").alias("f"))


def count_pairs(docs: DataFrame, often: np.ndarray, seed: int) -> DataFrame:
    """key (a hash of both) and f of the pairs of neighbouring words that may both be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h, joined in _tokens(batch, seed):
                known = _has(often, h)
                at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
                (a, b), n = _counted([h[at], h[at + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (a, b)] + [pa.array(n)], ["w1", "w2", "n"])

    return docs.mapInArrow(run, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("f"))


def count_windows(docs: DataFrame, pairs: np.ndarray, seed: int) -> DataFrame:
    """The longest windows, padded with 0, of two words at least: w1 to w5 and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h, joined in _tokens(batch, seed):
                going = np.zeros(len(h) + LONGEST, bool)
                going[: len(h) - 1] = joined[:-1] & _has(pairs, _pair(h[:-1], h[1:]))
                padded = np.concatenate((h, np.zeros(LONGEST, U64)))
                at = np.flatnonzero(going)
                columns, on = [h[at]], np.ones(len(at), bool)
                for k in range(1, LONGEST):
                    on = on & going[at + k - 1]
                    columns.append(np.where(on, padded[at + k], U64(0)))
                columns, n = _counted(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(n)], [*_W, "n"])

    return docs.mapInArrow(run, ", ".join(f"{w} long" for w in _W) + ", n long").groupBy(*_W).agg(F.sum("n").alias("n"))


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) by decimals of 38 digits: exact while a and n have up to 17 digits."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    # precisions whose sum is at most 38, so that no product is rounded
    top, bottom = whole(a, 17) * whole(n, 17) * F.lit(SCALE).cast("decimal(4,0)"), whole(left, 18) * whole(right, 18)
    return F.call_function("div", whole(top, 38), whole(bottom, 38)).cast("long")


def _part(first: int, size: int) -> Column:
    """The words of a phrase from one place on, as a key padded with 0."""
    return F.array(*[F.get("key", F.lit(first + k)) if k < size else F.lit(0).cast("long") for k in range(LONGEST)])


def collocations(docs: DataFrame, fewest: int = FEWEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of docs (lang, text). Texts are read three times and never shuffled."""
    texts = text_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(101, 109):
        vocabulary = written(count_words(texts, seed), "words")
        if vocabulary.groupBy("key").count().filter("count > 1").isEmpty():
            break
        discard(vocabulary)
    else:
        raise RuntimeError("words of the corpus share hashes by every seed")
    total = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = vocabulary.filter(F.col("f") >= fewest)
    often = bit_table(frequent, frequent.count())
    pairs = written(count_pairs(texts, often, seed).filter(F.col("f") >= fewest), "pairs")
    bits = bit_table(_pair_keys(pairs), pairs.count())
    rolled = count_windows(texts, bits, seed).rollup(*_W).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # a level of the rollup has the phrases of as many words as it doesn't sum over; what ends in padding is none
    size = F.lit(LONGEST) - F.bit_count("level")
    phrase = rolled.filter(F.col("f") >= fewest).withColumn("size", size.cast("int")).filter("size >= 2")
    phrase = phrase.withColumn("key", F.array(*[F.coalesce(w, F.lit(0)) for w in _W])).filter(F.expr("element_at(key, size) <> 0"))
    phrase = written(phrase.select("key", "size", F.col("f").alias("a")), "phrases")
    alone = frequent.select(F.array("key", *[F.lit(0).cast("long")] * (LONGEST - 1)).alias("key"), "f")
    known = phrase.select("key", F.col("a").alias("f")).unionByName(alone)

    inner = [(size, first, k) for size in range(3, LONGEST + 1) for k in range(2, size) for first in range(size - k + 1)]
    covers = phrase.filter("size > 2").select("a", F.explode(F.filter(F.array(*[F.when(F.col("size") == size, _part(first, k)) for size, first, k in inner]), lambda x: x.isNotNull())).alias("key"))
    covers = covers.groupBy("key").agg(F.max("a").alias("around"))
    left = phrase.join(covers, "key", "left").filter(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a"))).drop("around")

    cuts = [(size, k) for size in range(2, LONGEST + 1) for k in range(1, size)]
    cut = left.select("key", "a", F.explode(F.filter(F.array(*[F.when(F.col("size") == size, F.struct(F.lit(k).alias("cut"), _part(0, k).alias("first"), _part(k, size - k).alias("rest"))) for size, k in cuts]), lambda x: x.isNotNull())).alias("c")).select("key", "a", "c.*")
    cut = cut.join(known.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    named = left.select("key", F.posexplode("key").alias("at", "w")).filter("w <> 0").join(frequent.select(F.col("key").alias("w"), "lang", "word"), "w")
    named = named.groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = cut.join(named.select("key", "lang", "phrase"), "key").join(total, "lang")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("s"))
    scored = scored.select("lang", "phrase", "a", "n", "s.l", "s.r", "s.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    picked = scored.withColumn("pick", F.pmod(F.xxhash64("phrase"), F.lit(PICKS)))
    picked = picked.withColumn("rank", F.row_number().over(W.partitionBy("lang", "pick").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = picked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _pair_keys(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(U64) for c in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([pa.array(_pair(a, b).view(np.int64))], ["key"])

    return pairs.select("w1", "w2").mapInArrow(run, "key long")
