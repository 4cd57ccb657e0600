"""Fits over all labelled documents, of any number: their features in blocks of rows, and sums over the blocks.

Rows are dealt to blocks by a hash of their id. A loss of a block needs the block's rows only, so that its sum over all rows is one pass of tasks, each of which sends one
small array to the driver. The fits start from weights of the first blocks and end where the loss of all rows is least: the start decides how many passes that takes, not where it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import discard, text_batches, written

#: Rows of a block (about so many), and those of the rarer label in it: where there are fewer, rows of that label are copied to several blocks.
BLOCK_ROWS, FEWEST_IN_BLOCK = 1024, 64
#: Blocks of one file, which is read by one task.
FILE_BLOCKS = 16
#: Bits for each labelled id in the table that tells most other documents apart before they are measured, and of all of it.
BITS_EACH, MOST_BITS = 8, 1 << 26
#: Parts of the rows that are left out of a fit in turn.
FOLDS = 3
_BITMAP = 1 << 15


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1): other labels, null ids, and ids of both labels aren't used; repeated rows count once."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    return known.filter("quality = most").drop("most")


def _hash(seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(n))


def blocks(docs: DataFrame, known: DataFrame, sizes: dict[int, int], measure: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """block, doc_id, quality, fold, own, x (float32 features) of one text for each labelled id, written to the shared folder: a block's rows stand together in one file.

    sizes are the numbers of known rows of both labels, which must not be 0. A row is its own (own) in one block; copies of a rare label's rows are in others.
    """
    n = sum(sizes.values())
    n_bits = min(MOST_BITS, max(_BITMAP, 1 << (BITS_EACH * n).bit_length()))
    bit = _hash(59, n_bits) + 1  # the functions of bitmaps number from 1
    table = np.zeros(n_bits // 8, np.uint8)
    for r in known.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        table[(r["k"] - 1) * (_BITMAP // 8) : r["k"] * (_BITMAP // 8)] = np.frombuffer(r["bits"], np.uint8)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((table[at >> 3] >> (at & 7) & 1).astype(bool)))
            x = measure(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    texts = text_batches(docs).filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _hash(59, n_bits).alias("at"))
    rows = texts.mapInArrow(measured, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id")
    n_blocks = max(1, n // BLOCK_ROWS)
    copies = {q: min(n_blocks, -(-FEWEST_IN_BLOCK * n_blocks // m)) for q, m in sizes.items()}
    which = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 0, copies[0]).otherwise(copies[1]) - 1)).alias("copy")
    rows = rows.select("doc_id", "quality", _hash(67, FOLDS).cast("int").alias("fold"), "x", _hash(61, n_blocks).alias("first"), which)
    rows = rows.select(((F.col("first") + F.col("copy")) % n_blocks).alias("block"), "doc_id", "quality", "fold", (F.col("copy") == 0).alias("own"), "x")
    dealt = rows.repartition(-(-n_blocks // FILE_BLOCKS), "block").sortWithinPartitions("block", "doc_id")
    return written(dealt, "blocks", {"parquet.block.size": 1 << 30})  # one row group, which no two tasks read


def _arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """x (float64), label, fold, own of rows of blocks()."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)
    label, fold = batch.column("quality").to_numpy(), batch.column("fold").to_numpy()
    return x, label, fold, np.array(batch.column("own").to_pylist(), bool)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of one block after the other."""
    held, now = [], None
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and block[i] != now:
                yield _arrays(pa.Table.from_batches(held))
                held = []
            now = block[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield _arrays(pa.Table.from_batches(held))


def first_rows(table: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, label, fold of the first blocks, of about so many rows (one block at least)."""
    found = table.filter(F.col("block") < max(1, rows // BLOCK_ROWS)).filter("own").orderBy("block", "doc_id").toArrow()
    return _arrays(found)[:3]


def _summed(df: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of the arrays that parts() makes of a task's batches, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts(batches):
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["s"])

    return sum(np.frombuffer(s, np.float64) for s in df.mapInArrow(run, "s binary").toArrow().column("s").to_pylist())


def over_blocks(table: DataFrame, work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of work(x, label, fold, own) over all blocks, flat."""
    return _summed(table, lambda batches: (work(*b).ravel() for b in _by_block(batches)))


def moments(table: DataFrame, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of all rows' features; shift is near the mean."""

    def work(x: np.ndarray, label: np.ndarray, fold: np.ndarray, own: np.ndarray) -> np.ndarray:
        d = x[own] - shift
        return np.concatenate(([len(d)], d.sum(axis=0), (d * d).sum(axis=0)))

    total = over_blocks(table, work)
    first, second = total[1:].reshape(2, -1) / total[0]
    return shift + first, np.sqrt(np.maximum(second - first**2, 0))


def margins(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """quality, m: of(x, fold) for each row, once, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, label, fold, own in _by_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array(label[own], pa.int32()), pa.array(of(x, fold)[own], pa.float64())], ["quality", "m"])

    return written(table.mapInArrow(run, "quality int, m double"), "margins")


def over_margins(found: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of work(m, label) over all batches of margins()."""
    return _summed(found, lambda batches: (work(b.column("m").to_numpy(), b.column("quality").to_numpy()) for b in batches))


def _turned(bits: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles of these bits, and back."""
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def at_ranks(found: DataFrame, ranks: list[int]) -> list[float]:
    """The values of m at these places (from 0) of its order, exactly: 16 bits of them after the other, by counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_turned((b.column("m").to_numpy() + 0.0).view(np.int64)))], ["key"])

    keys, out = written(found.select("m").mapInArrow(run, "key long"), "keys"), []
    for rank in ranks:
        rows, k = keys, 0
        for shift in (48, 32, 16, 0):
            part = F.shiftright("key", shift)
            for k, n in sorted(map(tuple, rows.groupBy(part.alias("k")).count().collect())):
                if rank < n:
                    break
                rank -= n
            rows = rows.filter(part == k)
        out.append(float(_turned(np.array([k], np.int64)).view(np.float64)[0]))
    discard(keys)
    return out


def minimise(value: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, curve: np.ndarray, small: float = 1e-6, passes: int = 200) -> np.ndarray:
    """The points (one a row) at which several convex functions are least, all by the same passes: value(points) gives their values and slopes.

    Steps are those of L-BFGS, with a curvature near that of the functions (curve) as its first guess; they end when no coordinate of the next one is over small.
    """
    first = np.linalg.inv(curve)
    at, step = start.astype(np.float64), np.zeros(start.shape)
    now, slope = value(at)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in at]

    def direction(k: int) -> np.ndarray:
        q, used = slope[k].copy(), []
        for s, y in reversed(past[k]):
            used.append((s @ q) / (s @ y))
            q -= used[-1] * y
        q = first @ q
        for (s, y), a in zip(past[k], reversed(used), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    step = np.array([direction(k) for k in range(len(at))])
    going = np.abs(step).max(axis=1) > small
    for _ in range(passes):
        if not going.any():
            break
        new, then = value(np.where(going[:, None], at + step, at))
        for k in np.flatnonzero(going):
            if new[k] > now[k] + 1e-4 * (slope[k] @ step[k]) + 1e-13 * abs(now[k]):
                step[k] /= 2
            else:
                if step[k] @ (then[k] - slope[k]) > 0:
                    past[k] = [*past[k][-9:], (step[k].copy(), then[k] - slope[k])]
                at[k], now[k], slope[k] = at[k] + step[k], new[k], then[k]
                step[k] = direction(k)
            going[k] = np.abs(step[k]).max() > small
    return at
