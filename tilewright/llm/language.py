"""Language identification by interpolated Kneser-Ney models of characters.

Texts are lower-cased, everything but letters and marks becomes one space, and each text is framed by spaces. Every language has a model of up to
four characters: absolute discounting at each order, continuation counts below the highest, and the uniform distribution at the end. Counts are made of all
training texts: tasks count the distinct four-character grams of their rows, Spark adds them up, and the lower orders are aggregations of those.

For scoring, the grams of all languages stand in one sorted array of hashes for each order, with the full interpolated log-probabilities of every language beside them; a text's score for a language
is its cross-entropy by character. Grams are known by 62 bits of a hash, so that practically none share counts however many there are. Languages are dealt out in groups, each of which is a model of stated size (of one language at least); with more than one
group, texts are scored against one after the other. The lowest cross-entropy wins, and it is accepted if it is at most the language's calibrated limit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.text import U64, mix, ranges
from tilewright.session import text_batches, written

ORDER = 4
#: Bits of a gram's hash: of fifty million grams any two share one with a chance under one in a thousand.
FOLD_BITS = 62
#: Languages of one group, and its probabilities of the highest order (distinct grams x languages; one language may have more): they bound what is broadcast at once.
MOST_LANGUAGES, MOST_CELLS = 32, 1 << 23
#: Rows of the calibration sample for each language, the largest share of its rows that they may be, the fewest rows of a language that spares some, and the share of them that is accepted.
CALIBRATION_ROWS, MOST_SPARED, FEWEST_ROWS, ACCEPTED = 4000, 0.2, 10, 0.995
_SCALES = 2.0 ** np.arange(-2, 11)
DISCOUNT = 0.75
#: Characters that are worked on at once.
_SLICE = 1 << 20


def _character_table() -> np.ndarray:
    """For each of the first 65,536 code points its lower-case letter, or a space; letters beyond them are folded into that range by scoring them as they are modulo it."""
    out = np.full(1 << 16, 32, np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low[0]) if ord(low[0]) < 1 << 16 else c
    return out


_TABLE: list[np.ndarray] = []
_LETTER: list[np.ndarray] = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts end to end, framed by three spaces at the start and one at the end; n + 1 offsets; which texts have a letter."""
    if not _TABLE:
        _TABLE.append(_character_table())
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)]))
    points = np.frombuffer("".join(f"   {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = points >= 1 << 16
    chars, letter = _TABLE[0][points & 0xFFFF].astype(U64), _LETTER[0][points & 0xFFFF]
    if far.any():
        kinds, back = np.unique(points[far], return_inverse=True)
        group = np.array([unicodedata.category(chr(c))[0] for c in kinds.tolist()])
        chars[far], letter[far] = np.where(np.isin(group, ("L", "M")), kinds & 0xFFFF | 1, 32)[back], (group == "L")[back]
    size = np.array([len(t) + 4 for t in texts], np.int64)
    ends = np.cumsum(size)
    space = chars == 32
    # of a run of spaces one is left, but the three that frame a text all stay
    stays = np.ones(len(chars), bool)
    stays[1:] = ~(space[1:] & space[:-1])
    starts = ends - size
    for k in range(3):
        stays[starts + k] = True
    stays[starts + 3] = ~space[starts + 3]
    if len(texts):  # a text without letters keeps the space that ends it
        stays[ends[np.add.reduceat(stays, starts, dtype=np.int64) == 3] - 1] = True
    kept = np.concatenate(([0], np.cumsum(stays)))
    has = np.add.reduceat(letter, starts, dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    return chars[stays], np.concatenate(([0], kept[ends])), has


def grams(chars: np.ndarray) -> np.ndarray:
    """The four-character gram that ends at each place from the fourth on: 16 bits a character."""
    if len(chars) < ORDER:
        return np.zeros(0, U64)
    return chars[:-3] << U64(48) | chars[1:-2] << U64(32) | chars[2:-1] << U64(16) | chars[3:]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    texts = pc.fill_null(batch.column(column), "").to_pylist()
    i, n = 0, len(texts)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + len(texts[j]) <= _SLICE):
            total += len(texts[j])
            j += 1
        yield i, j, texts[i:j]
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of each language with their counts, for each part of a batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for name in sorted(set(langs)):
            own = batch.filter(pa.array([x == name for x in langs]))
            for _, _, texts in _texts(own, "text"):
                chars, at, _ = letters(texts)
                whole = grams(chars)
                # grams that end in the frame, or cross two texts, aren't counted
                ends = np.ones(len(whole), bool)
                for k in range(3):
                    ends[np.clip(at[1:-1] - 3 + k, 0, max(0, len(whole) - 1))] = False
                sorted_ = np.sort(whole[ends])
                first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(sorted_)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(sorted_[first].view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fold(gram: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The folded hash of grams of an order (their last 16 * order bits)."""
    mask = U64((1 << 16 * order) - 1)
    return (mix((gram & mask) + U64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(64 - bits)).astype(np.int64)


def distinct_grams(docs: DataFrame) -> DataFrame:
    """The distinct four-character grams of docs (text, lang): (lang, gram, n), written."""
    raw = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    return written(raw.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def count_grams(level: DataFrame, bits: int = FOLD_BITS) -> DataFrame:
    """Of every order the folded grams of distinct_grams(): (lang, level, h, gram, n, kinds).

    level k: n is the count (below the highest order: of different characters before it), gram one gram of the fold. level -k: the folded contexts of grams of
    order k, with the sum n of their grams' counts and the number kinds of their grams.
    """
    out = None
    for order in range(ORDER, 0, -1):

        def folded(batches: Iterator[pa.RecordBatch], order: int = order) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gram = batch.column("gram").to_numpy().view(U64)
                h, context = fold(gram, order, bits), fold(gram >> U64(16), order - 1, bits)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h), pa.array(context), batch.column("gram"), batch.column("n")], ["lang", "h", "context", "gram", "n"])

        rows = level.mapInArrow(folded, "lang string, h long, context long, gram long, n long")
        own = rows.groupBy("lang", F.lit(order).alias("level"), "h").agg(F.min("gram").alias("gram"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
        contexts = rows.groupBy("lang", F.lit(-order).alias("level"), F.col("context").alias("h")).agg(F.min("gram").alias("gram"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
        out = own.union(contexts) if out is None else out.union(own).union(contexts)
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
        level = level.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n"))
    return out


@dataclass
class LanguageModel:
    """For each order: sorted hashes, where they stand, log-probabilities (hash x language); and for contexts the log of the share of the next lower order."""

    langs: list[str]
    bits: int
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = -12.0
    limit: np.ndarray | None = None
    scale: float = 20.0
    _places: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": {}}

    def _find(self, level: int, h: np.ndarray) -> np.ndarray:
        """Where the hashes stand in a level's sorted array, or -1."""
        if level not in self._places:
            own = self.hashes[level]
            top = min(self.bits, len(own).bit_length() + 1)
            first = np.searchsorted(own, np.arange(1 << top, dtype=np.int64) << (self.bits - top)).astype(np.int32)
            self._places[level] = first, np.append(own, np.iinfo(np.int64).max)
        first, own = self._places[level]
        # from the first of those with its highest bits on, a hash is looked for in order
        out, live = np.full(len(h), -1, np.int32), np.arange(len(h))
        at = first[h >> (self.bits - (len(first).bit_length() - 1))]
        while len(live):
            got = own[at]
            hit = got == h
            out[live[hit]] = at[hit]
            less = got < h
            live, at, h = live[less], at[less] + 1, h[less]
        return out

    def log_probabilities(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """ln p(last character | those before it) of each gram in each language."""
        if order == 0:
            return np.full((len(gram), len(self.langs)), self.floor, np.float32)
        at = self._find(order, fold(gram, order, self.bits))
        miss = np.flatnonzero(at < 0)
        out = self.logs[order][at] if len(self.logs[order]) else np.zeros((len(gram), len(self.langs)), np.float32)
        if miss.size:
            lower = self.log_probabilities(gram[miss], order - 1)
            head = self._find(-order, fold(gram[miss] >> U64(16), order - 1, self.bits))
            known = head >= 0
            lower[known] += self.logs[-order][head[known]]
            out[miss] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cross-entropy (nats a character) of each text in each language, and which texts have a letter."""
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0, bool)
        chars, at, has = letters(texts)
        first, size = at[:-1], np.diff(at) - 3  # a text's grams end at its fourth character and after; the frame makes one at least
        value = self.log_probabilities(grams(chars)[ranges(first, size)])
        return -np.add.reduceat(value, np.cumsum(size) - size, axis=0, dtype=np.float64) / size[:, None], has


@dataclass
class GroupedModel:
    """Languages of several models, each of which is broadcast by itself; the languages stand in the order of the groups."""

    langs: list[str]
    groups: list[Broadcast]
    limit: np.ndarray | None = None
    scale: float = 20.0


def build(rows: pa.Table, langs: list[str], bits: int, letters_known: int | None = None) -> LanguageModel:
    """Interpolated Kneser-Ney probabilities of the counted grams (count_grams: a row or less for each distinct gram of an order and context).

    letters_known: distinct characters, if there are other languages than these.
    """
    model = LanguageModel(langs, bits)
    lang = pc.index_in(rows.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    level, h, n, kinds = (rows.column(c).to_numpy() for c in ("level", "h", "n", "kinds"))
    gram = rows.column("gram").to_numpy().view(U64)

    def dense(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(level == k)
        hashes, first, back = np.unique(h[own], return_index=True, return_inverse=True)
        counts, different = np.zeros((2, len(hashes), len(langs)))
        counts[back, lang[own]], different[back, lang[own]] = n[own], kinds[own]
        return hashes, gram[own[first]] if len(own) else gram[:0], counts, different

    model.floor = -float(np.log((len(np.unique(h[level == 1])) if letters_known is None else letters_known) + 1))
    for order in range(1, ORDER + 1):
        hashes, one, counts, _ = dense(order)
        heads, _, total, different = dense(-order)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(total > 0, DISCOUNT * different / total, 1.0)
        model.hashes[order], model.hashes[-order], model.logs[-order] = hashes, heads, np.log(share).astype(np.float32)
        place = model._find(-order, fold(one >> U64(16), order - 1, bits))
        lower = np.exp(model.log_probabilities(one, order - 1).astype(np.float64))
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[place], 1)
        model.logs[order] = np.log(own + share[place] * lower).astype(np.float32)
    return model


def grouped(langs: list[str], kinds: dict[str, int]) -> list[list[str]]:
    """The languages in groups of at most MOST_LANGUAGES and about MOST_CELLS probabilities (of one language at least)."""
    out: list[list[str]] = []
    total = 0
    for x in langs:
        total += (n := kinds.get(x, 0))
        if not out or len(out[-1]) == MOST_LANGUAGES or (len(out[-1]) + 1) * total > MOST_CELLS:
            out.append([])
            total = n
        out[-1].append(x)
    return out


def train(docs: DataFrame, bits: int = FOLD_BITS, calibration_rows: int = CALIBRATION_ROWS, accepted: float = ACCEPTED) -> LanguageModel | GroupedModel:
    """Learns from docs (text, lang); rows with a null in either aren't used.

    Of each language with FEWEST_ROWS rows or more, texts whose hash is low (about calibration_rows of its rows, a fifth at most) are left out of the counts: the scale of scores and the
    limits of rejection are fitted on these, each different text once. Counts cover all other rows.
    """
    docs = text_batches(docs).select("text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    shares = {x: min(MOST_SPARED, calibration_rows / n) if n >= FEWEST_ROWS else 0.0 for x, n in sizes.items()}
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, shares[x])])[F.col("lang")] if langs else F.lit(0.0)
    spared = F.pmod(F.xxhash64("text", F.lit(41)), F.lit(1 << 20)) < F.lit(1 << 20) * share
    level = distinct_grams(docs.filter(~spared))
    kinds = {r["lang"]: r["count"] for r in level.groupBy("lang").count().collect()}
    groups = grouped(langs, kinds)
    context = docs.sparkSession.sparkContext
    if len(groups) <= 1:
        model = build(count_grams(level, bits).toArrow(), langs, bits)
    else:
        known = level.select(F.col("gram").bitwiseAND(F.lit(0xFFFF))).distinct().count()
        parts = ((own, level.filter(F.col("lang").isin(own))) for own in groups)
        model = GroupedModel(langs, [context.broadcast(build(count_grams(rows, bits).toArrow(), own, bits, known)) for own, rows in parts])
    if not langs:
        return model
    sample = docs.filter(spared).distinct()
    if isinstance(model, GroupedModel):
        number = F.array_position(F.lit(langs), F.col("lang")) - 1
        valued = with_entropies(sample.select(number.cast("int").alias("truth"), F.col("text").alias("__text")), model, ["truth"]).filter("__has").select("truth", F.col("__values").alias("values"))
    else:
        valued = sample.mapInArrow(_calibrate(context.broadcast(model)), "truth int, values array<double>")
    got = valued.mapInArrow(_judged, "truth int, own double, best boolean, losses array<double>").toArrow()
    truth, own, best = (got.column(c).to_numpy() for c in ("truth", "own", "best"))
    if len(truth):
        loss = got.column("losses").combine_chunks().flatten().to_numpy().reshape(-1, len(_SCALES)).mean(axis=0)
        model.scale = float(_SCALES[int(np.flatnonzero(loss <= loss.min() + 1e-3)[0])])  # the mildest of those that do as well
    model.limit = _limits(own[best], truth[best], len(langs), accepted)
    return model


def _limits(entropies: np.ndarray, truth: np.ndarray, langs: int, accepted: float) -> np.ndarray:
    """Of each language the entropy up to which a text is accepted: so many of its deviations over its mean that a new text of all languages exceeds it with the chance that isn't
    accepted (the sample's highest, if it is too small for that). Languages without a sample accept all."""
    n = np.bincount(truth, minlength=langs)
    mean = np.bincount(truth, entropies, langs) / np.maximum(n, 1)
    square = np.bincount(truth, (entropies - mean[truth]) ** 2, langs)
    common = square.sum() / max(1, len(truth)) + 1e-6
    deviation = np.sqrt((square + 2 * common) / (n + 2))  # of few rows mostly the common one
    z = np.sort((entropies - mean[truth]) / deviation[truth])
    rank = min(len(z), int(np.ceil(accepted * (len(z) + 1))))
    return np.where(n > 0, mean + (z[rank - 1] if len(z) else 0.0) * deviation, np.inf)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of entropies: that of the true language, whether it is the lowest, and for each scale the true language's surprise."""
    for batch in batches:
        truth, rows = batch.column("truth").to_numpy(), batch.column("values")
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        margins = values - values.min(axis=1, keepdims=True) if len(batch) else values
        own = margins[np.arange(len(batch)), truth] if len(batch) else np.zeros(0)
        losses = [c * own + np.log(np.exp(-c * margins).sum(axis=1)) for c in _SCALES]
        yield pa.RecordBatch.from_arrays(
            [batch.column("truth"), pa.array(values[np.arange(len(batch)), truth] if len(batch) else own), pa.array(own == 0), pa.array(list(np.stack(losses, axis=1)), pa.list_(pa.float64()))], ["truth", "own", "best", "losses"]
        )


def _calibrate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {x: k for k, x in enumerate(model.langs)}
        for batch in batches:
            for i, j, texts in _texts(batch, "text"):
                values, has = model.entropies(texts)
                truth = [number[x] for x in batch.column("lang").slice(i, j - i).to_pylist()]
                keep = np.flatnonzero(has).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([truth[k] for k in keep], pa.int32()), pa.array([values[k] for k in keep], pa.list_(pa.float64()))], ["truth", "values"])

    return run


def with_entropies(docs: DataFrame, model: GroupedModel, keep: list[str]) -> DataFrame:
    """docs (keep, __text) with __has (a letter) and __values (the cross-entropies in the model's order); texts are written between two groups, so that a worker holds one."""
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    names = [*keep, "__text", "__has", "__values"]
    rows = docs.select(*keep, "__text", F.lit(False).alias("__has"), F.array().cast("array<double>").alias("__values"))
    for k, shared in enumerate(model.groups):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for i, j, texts in _texts(batch, "__text"):
                    values, has = known.entropies(texts)
                    part = batch.slice(i, j - i)
                    before = part.column("__values").to_pylist()
                    values = [[*a, *b] for a, b in zip(before, values.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-2]), pa.array(has), pa.array(values, pa.list_(pa.float64()))], names)

        rows = rows.mapInArrow(run, f"{types}__text string, __has boolean, __values array<double>")
        if k < len(model.groups) - 1:
            rows = written(rows, "entropies")
    return rows.drop("__text")


def identify(docs: DataFrame, model: LanguageModel | GroupedModel, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), lang_pred, score, entropy, rejected.

    lang_pred is the language of the lowest cross-entropy (the first by name of equals), or und if the text is null or has no letter, or nothing was learned; score is then 0, entropy null.
    score is the scaled softmax of the entropies. rejected: the entropy is over the language's calibrated limit, or und. Repeated rows and null ids stay. No shuffle;
    the model is broadcast (one group of languages at a time, if there are several).
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"lang_pred", "score", "entropy", "rejected"} & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "lang_pred string, score double, entropy double, rejected boolean"
    if several := isinstance(model, GroupedModel):
        shared = docs.sparkSession.sparkContext.broadcast(GroupedModel(model.langs, [], model.limit, model.scale))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for i, j, texts in [(0, len(batch), [])] if several else _texts(batch, "__text"):
                if several:
                    values, has = np.array(batch.column("__values").to_pylist(), np.float64).reshape(len(batch), len(known.langs)), batch.column("__has").to_numpy(zero_copy_only=False)
                else:
                    values, has = known.entropies(texts)
                if not known.langs:
                    has[:] = False
                    values = np.zeros((len(texts), 1))
                best = values.argmin(axis=1)
                low = values.min(axis=1)
                score = 1 / np.exp(-known.scale * (values - low[:, None])).sum(axis=1)
                limit = known.limit[best] if known.limit is not None and known.langs else np.full(len(best), np.inf)
                columns = [
                    pa.array([known.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], pa.string()), pa.array(np.where(has, score, 0.0)),
                    pa.array(low, mask=~has), pa.array(~has | (low > limit)),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep] + columns, [*keep, "lang_pred", "score", "entropy", "rejected"])

    rows = text_batches(docs).select(*keep, docs["text"].alias("__text"))
    return (with_entropies(rows, model, keep) if several else rows).mapInArrow(run, fields)
