"""MinHash near-duplicates: many universal hash minima with banding, signature verification, exact confirmation on full sets,
and connected components by alternating large-star and small-star.

1. One scan makes each document's word-sequence key, set size and signature; copies in one batch become one row with a list of ids. Documents of one
   word sequence have one representative (the smallest id), found by a grouped minimum.
2. The representatives' bands are grouped: the smallest id of a bucket is its hub, and every other member is held against the hub
   only, so that a bucket of k members makes k - 1 pairs. The texts of all members are set aside, with a long signature of each. A pair whose long
   signatures agree in enough places is confirmed on full sets, which are made again from the whole texts, dealt by hub in chunks, so that a
   hub of many members is spread over many tasks.
3. Buckets that then hold one component are done. In the others, members outside the bucket's largest component are held against all members of
   other components by long signature, chunk by chunk, each pair in the first band that it shares. At first only the likest partner in each chunk leaves the task, and is confirmed; what
   lies between the new components is then compared once more, and all pairs that may be links are confirmed.

A link of similarity s or more is missed only if its two signatures agree in no band (with 32 bands of 4, less than 5e-6 at 0.75), or its long ones
in fewer than s - 0.06 of 1024 places (4.4 standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.shingles import WORDS, shingle_sets
from tilewright.llm.text import U64, mix, stream
from tilewright.session import discard, text_batches, written

BANDS, ROWS = 32, 4
#: Places of a long signature, and how far they may fall below the similarity before a pair is given up.
PLACES, SLACK = 1024, 0.06
#: Members of a bucket in one chunk of the comparison by signature.
TARGETS = 512
#: Members of a hub in one chunk of the confirmation.
CHUNK = 256

#: Factors and addends of the universal hashes: those of the bands, then those of long signatures.
_A, _B = ((stream(seed, BANDS * ROWS + PLACES) >> U64(32)).astype(np.uint32) for seed in (101, 202))
_A |= np.uint32(1)
SHORT, LONG = slice(0, BANDS * ROWS), slice(BANDS * ROWS, None)


def signature(members: np.ndarray, which: slice = SHORT) -> np.ndarray:
    """The minimum of each universal hash a * x + b over the (non-empty) set."""
    x = (members >> U64(32)).astype(np.uint32)
    a, b = _A[which, None], _B[which, None]
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (a * x[None, k : k + 1024] + b).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


_SKETCH = "docs array<long>, k1 long, k2 long, n_shingles long, bands array<long>"


def _sketches(size: int):
    """Rows of one word sequence in a batch become one row with all their ids, so that a large group of copies is few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], tuple[np.ndarray, list[int | None]]] = {}
            for doc_id, (a, b, members) in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), size), strict=True):
                groups.setdefault((a, b), (members, []))[1].append(doc_id)
            keys = np.array(list(groups), U64).reshape(-1, 2).view(np.int64)
            sets, ids = [m for m, _ in groups.values()], [d for _, d in groups.values()]
            bands = [band_keys(signature(m)).view(np.int64) if len(m) else None for m in sets]
            columns = [pa.array(ids, pa.list_(pa.int64())), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(m) for m in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["docs", "k1", "k2", "n_shingles", "bands"])

    return run


def _long(size: int):
    """Adds the low bytes of the long signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), size)
            sig = [(signature(s, LONG) & np.uint32(0xFF)).astype(np.uint8).tobytes() for _, _, s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(sig, pa.binary())], ["doc_id", "text", "sig"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sig_x", "sig_y"))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array((a == b).mean(axis=1), pa.float64())], ["x", "y", "agree"])


def _confirm(size: int, percent: int):
    """For each member x of a hub y whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, U64)
        for batch in batches:
            member, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("member", "x", "y"))
            out = []
            for k, (_, _, own) in enumerate(shingle_sets(batch.column("text"), size)):
                if not member[k]:
                    hub = own
                    continue
                place = np.searchsorted(hub, own)
                common = int(np.count_nonzero(hub[np.minimum(place, len(hub) - 1)] == own)) if len(hub) else 0
                if 100 * common >= percent * (len(own) + len(hub) - common):
                    out.append((x[k], y[k]))
            columns = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "y"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (member x, hub y) that are links, written."""
    chunks = pairs.groupBy("y").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # only hubs of several chunks are joined to their members: so few that adaptive execution mostly broadcasts them, and a large hub's members stay where they are
    several = pairs.join(chunks.filter("chunks > 1"), "y", "left")
    members = several.select("x", "y", F.coalesce(F.pmod(F.hash("x"), "chunks"), F.lit(0)).alias("chunk"), F.lit(True).alias("member"), F.col("x").alias("doc_id"))
    hubs = chunks.select(F.col("y").alias("x"), "y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"), F.col("y").alias("doc_id"))
    rows = members.union(hubs).join(texts.select("doc_id", "text").hint("merge"), "doc_id").drop("doc_id")
    rows = rows.repartition("y", "chunk").sortWithinPartitions("y", "chunk", "member")
    return written(rows.mapInArrow(_confirm(size, percent), "x long, y long"), "links")


def _alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose long signatures agree in enough places, written."""
    sig = texts.select("doc_id", "sig")
    both = pairs.join(sig.select(F.col("doc_id").alias("x"), F.col("sig").alias("sig_x")), "x").join(sig.select(F.col("doc_id").alias("y"), F.col("sig").alias("sig_y")), "y")
    return written(both.mapInArrow(_agreement, "x long, y long, agree double").filter(F.col("agree") >= least).select("x", "y"), "alike")


def _compare(least: float, likest: bool):
    """Rows of a bucket's chunk: its targets, which are held, then the probes, which pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            out_x, out_y = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "chunk", "probe")), strict=True))
            x, c, minor, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "c", "minor", "place"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, PLACES)
            bands = np.array(batch.column("bands").to_pylist(), np.int64).reshape(batch.num_rows, BANDS)
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i][:2] != here:
                    here, held = keys[i][:2], []
                if not keys[i][2]:
                    held.append((x[i:j], c[i:j], minor[i:j], sig[i:j], bands[i:j]))
                elif held:
                    tx, tc, tm, ts, tb = (np.concatenate(z) for z in zip(*held, strict=True))
                    held = [(tx, tc, tm, ts, tb)]
                    for k in range(i, j):
                        # of two members outside the largest component one comes as a probe to the other
                        able = np.flatnonzero((tc != c[k]) & (~tm | (tx < x[k])))
                        able = able[(tb[able] == bands[k]).argmax(axis=1) == place[k]] if len(able) else able
                        agree = (ts[able] == sig[k]).mean(axis=1)
                        able = able[agree >= least] if not likest or not len(able) else able[[int(agree.argmax())]][agree.max(keepdims=True) >= least]
                        out_x.append(np.maximum(tx[able], x[k]))
                        out_y.append(np.minimum(tx[able], x[k]))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in (out_x, out_y)], ["x", "y"])

    return run


def _between(bands: DataFrame, alone: DataFrame, texts: DataFrame, named: DataFrame, least: float, likest: bool) -> DataFrame:
    """Pairs of a bucket's members in different components whose long signatures agree in so many places, written; if likest, one of each member and chunk."""
    rows = bands.join(named.withColumnRenamed("node", "x"), "x", "left").select("band", "place", "x", F.coalesce("component", "x").alias("c"))
    parts = rows.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "c")).getField("c").alias("major"))
    parts = parts.filter("parts > 1").select("band", F.ceil(F.col("n") / TARGETS).cast("int").alias("chunks"), "major")
    rows = written(rows.join(parts, "band").withColumn("minor", F.col("c") != F.col("major")), "rows")
    targets = rows.select("band", "place", "x", "c", "minor", F.pmod(F.hash("x"), "chunks").alias("chunk"), F.lit(False).alias("probe"))
    probes = rows.filter("minor").select("band", "place", "x", "c", "minor", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("probe"))
    known = texts.select("doc_id", "sig").join(alone, "doc_id").withColumnRenamed("doc_id", "x")
    both = targets.union(probes).join(known, "x")
    both = both.repartition("band", "chunk").sortWithinPartitions("band", "chunk", "probe")
    out = written(both.mapInArrow(_compare(least, likest), "x long, y long").distinct(), "between")
    discard(rows)
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.75, size: int = WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, copy_of.

    component_id is the smallest doc_id reachable by links of the given Jaccard similarity or more (in whole hundredths); equal
    word sequences are linked. Texts without words (null and empty texts too) are linked with nothing. copy_of is the smallest id with the same
    word sequence. Rows with a null doc_id keep null in component_id and aren't kept. Rows that repeat a doc_id are one document, which is linked with everything that any of its
    texts is linked with. Other columns of docs aren't read.
    """
    docs = text_batches(docs).select("doc_id", "text")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _of_single_ids(docs, similarity, size)
    # each row is a document of its own at first; the components of the rows of one id are joined
    rows = written(docs.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row"), F.col("doc_id").alias("own"), "text"), "rows")
    near = _of_single_ids(rows.select(F.col("row").alias("doc_id"), "text"), similarity, size)
    of = near.withColumnRenamed("doc_id", "row").join(rows.select("row", "own"), "row", "left")
    parts = of.filter("own is not null").select("own", "component_id").distinct()
    links = parts.join(parts.groupBy("own").agg(F.min("component_id").alias("x")), "own").filter("component_id != x").select("x", F.col("component_id").alias("y"))
    named = components(links, "x", "y").withColumnRenamed("node", "component_id")
    of = written(of.join(named, "component_id", "left").withColumn("root", F.coalesce("component", "component_id")), "roots")
    smallest = of.groupBy("root").agg(F.min("own").alias("component_id"))
    first = of.filter("n_shingles > 0").groupBy("copy_of").agg(F.min("own").alias("first"))
    out = of.drop("component_id").join(smallest, "root", "left").join(first, "copy_of", "left")
    out = written(out.select(F.col("own").alias("doc_id"), "n_shingles", F.when(F.col("own").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("own") == F.col("component_id"), F.lit(False)).alias("kept"), F.col("first").alias("copy_of")), "near")
    for df in (rows, near, of):
        discard(df)
    return out


def _of_single_ids(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """near_duplicates() where no id is repeated."""
    percent = round(100 * similarity)
    sketches = written(docs.mapInArrow(_sketches(size), _SKETCH), "sketches")
    full = sketches.filter("n_shingles > 0").withColumn("doc_id", F.array_min("docs")).filter("doc_id is not null")
    firsts = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"))
    of = sketches.select("docs", "k1", "k2", "n_shingles").join(firsts, ["k1", "k2"], "left")
    copies = written(of.select("docs", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("copy_of")).alias("copy_of")), "copies")
    # the key has the id in it, so the copies of a large group don't meet
    alone = full.join(firsts.withColumnRenamed("copy_of", "doc_id"), ["k1", "k2", "doc_id"]).select("doc_id", "bands")
    alone = written(alone, "alone")
    discard(sketches)

    bands = alone.select(F.col("doc_id").alias("x"), F.posexplode("bands").alias("place", "band"))
    hubs = bands.groupBy("band").agg(F.min("x").alias("y"), F.max("x").alias("last")).filter("y != last").select("band", "y")
    bands = written(bands.join(hubs, "band"), "bands")  # of buckets with two members or more
    pairs = written(bands.select("x", "y").filter("x != y").distinct(), "pairs")
    wanted = bands.select(F.col("x").alias("doc_id")).distinct()
    texts = written(docs.join(wanted.hint("merge"), "doc_id").mapInArrow(_long(size), "doc_id long, text string, sig binary"), "texts")
    close = _alike(pairs, texts, similarity - SLACK)
    found = _links(close, texts, percent, size)
    scratch = [alone, bands, pairs, texts, close, found]
    named = written(components(found, "x", "y"), "named")
    for least, likest in ((similarity, True), (similarity - SLACK, False)):
        more = _between(bands, alone, texts, named, least, likest).join(close, ["x", "y"], "left_anti")
        found = _links(more, texts, percent, size)
        scratch.append(found)
        if not found.isEmpty():  # what is known already stands as one link of each node to its component
            scratch.append(named)
            named = written(components(named.select(F.col("node").alias("x"), F.col("component").alias("y")).union(found), "x", "y"), "named")
    out = copies.join(named.withColumnRenamed("node", "copy_of"), "copy_of", "left").select("copy_of", "component", "n_shingles", F.explode("docs").alias("doc_id"))
    component = F.coalesce("component", "copy_of", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNotNull() & (component == F.col("doc_id"))).alias("kept"), "copy_of")
    out = written(out, "near")
    for df in (copies, named, *scratch):
        discard(df)
    return out

