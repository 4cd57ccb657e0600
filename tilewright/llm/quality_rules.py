"""Quality rules: counts of every whole text against fixed limits, then a calibrated classifier of hashed word and character n-grams.

Words are runs of bytes other than 0x20 and 0x09-0x0D; lines are split at line feeds. The classifier is a logistic regression on the square roots of shares of
hashed runs of one and two words and of three characters, learned from labelled quality rows; its probability is calibrated on rows left out of the fit. A document is kept if
it passes the counts and its probability reaches a fixed threshold.

Null and empty texts have no words and fail the counts. Rows that repeat an id are rows of their own, a null id stays null, and an empty table gives no rows. With labels of one
kind only, or none, all probabilities are equal and the counts alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import labelled
from tilewright.llm.shingles import words
from tilewright.llm.text import BYTE_HASH, U64, mix, sliced, span_hash, utf8
from tilewright.session import discard, text_batches

#: Texts with fewer words fail, and those with a greater percentage of their words in repeated windows of three words.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Probability from which on a document that passes the counts is kept.
KEEP_FROM = 0.5
#: Labelled documents up to which the fit is made on the driver; with more, about so many give the weights that the fit over all of them starts from.
TRAIN_ROWS = 12_000
#: Bits of the bucket of a run of words, and of characters; strength of the penalty; parts of the rows that are left out in turn.
BITS, RIDGE, FOLDS = 9, 1e-2, 3
FEATURES = 2 << BITS
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ROW, _SECOND, _THIRD = U64(0xC2B2AE3D27D4EB4F), U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def _shares(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Square roots of the buckets' shares in each row."""
    n = np.bincount((row << BITS) | (h >> U64(64 - BITS)).astype(np.int64), minlength=rows << BITS).reshape(rows, -1)
    return np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its counts (in the order of COUNTS) and its features."""
    data, offsets = utf8(column)
    counts, out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64), np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, j in sliced(offsets):
        part, at, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], j - i
        if not len(part):
            continue
        of_byte = np.repeat(np.arange(rows), np.diff(at))
        lead, solid = (part & 0xC0) != 0x80, ~_SPACE[part]
        starts, ends, first = words(part, at)
        row = np.repeat(np.arange(rows), np.diff(first))
        value = BYTE_HASH[part]
        word = span_hash(value, starts, ends)
        own = row.astype(U64) * _ROW
        # lines: from a row's start or behind a line feed up to the next one; those with a word
        feeds = np.flatnonzero(part == 0x0A)
        line_starts = np.unique(np.concatenate((at[:-1], feeds + 1)))
        line_ends = np.unique(np.concatenate((at[1:], feeds)))
        line_starts = line_starts[line_starts < len(part)]
        line_starts = line_starts[part[line_starts] != 0x0A]  # an empty line ends where it begins
        line_ends = line_ends[np.searchsorted(line_ends, line_starts, "right")]
        wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[wordy], line_ends[wordy]
        line_row = of_byte[line_starts]
        _, distinct = np.unique(mix(span_hash(value, line_starts, line_ends) + line_row.astype(U64) * _ROW), return_index=True)
        # windows of three words of one row
        window = np.flatnonzero(row[2:] == row[:-2])
        _, which, times = np.unique(mix(word[window] + word[window + 1] * _SECOND + word[window + 2] * _THIRD + own[window]), return_inverse=True, return_counts=True)
        again = window[times[which] > 1]
        repeated = np.zeros(len(word), bool)
        for k in range(3):
            repeated[again + k] = True
        for k, of in enumerate((row, of_byte[lead & solid], of_byte[_SYMBOL[part]], line_row, row[repeated])):
            counts[i:j, k] = np.bincount(of, minlength=rows)
        counts[i:j, 3] -= np.bincount(line_row[distinct], minlength=rows)
        two = np.flatnonzero(row[1:] == row[:-1])
        out[i:j, : 1 << BITS] = _shares(np.concatenate((row, row[two])), np.concatenate((word, mix(word[two] + word[two + 1] * _SECOND))), rows)
        points, of_point = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64), of_byte[lead]
        three = of_point[2:] == of_point[:-2]
        out[i:j, 1 << BITS :] = _shares(of_point[2:][three], mix((points[:-2] | points[1:-1] << U64(21) | points[2:] << U64(42))[three]), rows)
    return counts, out


@dataclass
class RuleModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: The calibration: the logit is slope x margin + shift.
    slope: float
    shift: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _logistic(z: np.ndarray, label: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and, last, the bias (which isn't penalised) of least mean logistic loss, by Newton's method with halved steps where a whole one would raise the loss."""
    z = np.concatenate((z, np.ones((len(z), 1), z.dtype)), axis=1)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        margin = (z @ w) * np.where(label == 1, 1, -1)
        return float(np.mean(np.logaddexp(0, -margin)) + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - label) / len(z) + penalty * w
        curve = (z * (p * (1 - p)).astype(z.dtype)[:, None]).T @ z / len(z)
        step = np.linalg.solve(curve.astype(np.float64) + np.diag(penalty), slope)
        rate = 1.0
        while (then := loss(w - rate * step)) > now and rate > 1e-3:
            rate /= 2
        if then > now:
            break
        w, gained, now = w - rate * step, now - then, then
        if gained < 1e-8:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, ridge: float = RIDGE, folds: int = FOLDS) -> RuleModel:
    """Weights from all rows; the calibration from margins of rows left out of the fit, each fold in turn (from the own margins where a label has under twenty rows a fold)."""
    model = RuleModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0, 0.0)
    kinds = [np.flatnonzero(label == k) for k in (0, 1)]
    if not min(map(len, kinds)):
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float32)
    w = _logistic(z, label, ridge)
    model.weights, model.bias = w[:-1], float(w[-1])
    margin = z @ w[:-1] + w[-1]
    if min(map(len, kinds)) >= 20 * folds:
        fold = np.empty(len(label), np.int64)
        for rows in kinds:
            fold[rows] = np.random.default_rng(37).permutation(len(rows)) % folds
        for f in range(folds):
            w = _logistic(z[fold != f], label[fold != f], ridge)
            margin[fold == f] = z[fold == f] @ w[:-1] + w[-1]
    spread = max(float(margin.std()), 1e-9)
    slope, shift = _logistic((margin / spread)[:, None], label, 1e-4)
    model.slope, model.shift = float(slope) / spread, float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    """Learns from all labels (doc_id, quality) and docs (doc_id, text). Labels other than 0 and 1, null ids, and ids of both labels aren't used; repeated rows count once.

    Up to train_rows labelled rows are broadcast to find their texts, and the features of one text for each id come to the driver (4 KB a row); with more, see fit_blocks().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    known = labelled.known_labels(labels)
    sizes = dict(map(tuple, known.groupBy("quality").count().collect()))
    if sum(sizes.values()) > train_rows:
        if len(sizes) < 2:
            return fit(np.zeros((0, FEATURES)), np.zeros(0))
        table = labelled.blocks(docs, known, sizes, lambda texts: measure(texts)[1])
        model = fit_blocks(table, train_rows)
        discard(table)
        return model
    rows = text_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(run, "doc_id long, quality int, x binary")
    table = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s")).select("doc_id", "s.quality", "s.x").orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return fit(x, table.column("quality").to_numpy())


def _curve(z: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The curvature of the mean logistic loss of rows (with a last one for the bias) at w."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return (z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(penalty)


def _losses(z: np.ndarray, label: np.ndarray, points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each point (a row) the weight of the rows, and the sums of their logistic losses and slopes; weight has a column for each point."""
    margin = z @ points.T
    loss = np.logaddexp(0, -margin * np.where(label == 1, 1, -1)[:, None])
    pull = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[:, None]) * weight
    return np.concatenate((weight.sum(axis=0)[:, None], (loss * weight).sum(axis=0)[:, None], pull.T @ z), axis=1)


def _mean(total: np.ndarray, points: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes of the mean losses, with the penalty, of sums of _losses()."""
    total = total.reshape(len(points), -1)
    n = np.maximum(total[:, :1], 1)
    return total[:, 1] / n[:, 0] + (penalty * points**2).sum(axis=1) / 2, total[:, 2:] / n + penalty * points


def fit_blocks(table: DataFrame, start_rows: int, ridge: float = RIDGE) -> RuleModel:
    """What fit() does, over rows of any number in blocks (labelled.blocks): losses are summed over all blocks. The first blocks give the weights to start from."""
    model = RuleModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0, 0.0)
    x, label, _ = labelled.first_rows(table, start_rows)
    sizes = labelled.over_blocks(table, lambda x, label, fold, own: np.bincount(label[own], minlength=2))
    if not sizes.min():  # a label whose texts aren't there
        return model
    mean, scale = labelled.moments(table, x.mean(axis=0))
    model.mean, model.scale = mean, scale = mean, np.maximum(scale, 1e-3)
    folds = labelled.FOLDS if sizes.min() >= 20 * labelled.FOLDS else 0
    penalty = np.append(np.full(FEATURES, ridge), 1e-6)

    def biased(x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))), axis=1)

    def value(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the first with all rows, the others without a fold
        work = lambda x, label, fold, own: _losses(biased(x[own]), label[own], points, (fold[own][:, None] != np.arange(len(points)) - 1).astype(float))
        return _mean(labelled.over_blocks(table, work), points, penalty)

    z, w = biased(x), np.zeros(FEATURES + 1)
    if len(np.unique(label)) == 2:
        w = _logistic(z[:, :-1].astype(np.float32), label, ridge)
    weights = labelled.minimise(value, np.tile(w, (1 + folds, 1)), _curve(z, w, penalty), 1e-4)  # the losses then agree to some 1e-7
    model.weights, model.bias = weights[0, :-1], float(weights[0, -1])
    found = labelled.margins(table, lambda x, fold: (biased(x) * (weights[1 + fold] if folds else weights[:1])).sum(axis=1))
    n, total, squares = labelled.over_margins(found, lambda m, label: np.array([len(m), m.sum(), (m * m).sum()]))
    spread = max(float(np.sqrt(max(squares / n - (total / n) ** 2, 0))), 1e-9)
    light = np.array([1e-4, 1e-6])
    line = lambda m: np.stack((m / spread, np.ones(len(m))), axis=1)

    def calibration(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _mean(labelled.over_margins(found, lambda m, label: _losses(line(m), label, points, np.ones((len(m), len(points))))), points, light)

    own = line(z @ weights[0])
    start = _logistic(own[:, :1], label, 1e-4) if len(np.unique(label)) == 2 else np.zeros(2)
    slope, shift = labelled.minimise(calibration, start[None], _curve(own, start, light))[0]
    model.slope, model.shift = float(slope) / spread, float(shift)
    discard(found)
    return model


def apply_rules(docs: DataFrame, model: RuleModel, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), the counts, base_failed, probability and kept. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    added = [*COUNTS, "base_failed", "probability", "kept"]
    if clash := set(added) & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, probability double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = measure(batch.column("__text"))
            failed = (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            p = model.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c) for c in counts.T] + [pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= KEEP_FROM))], [*keep, *added])

    return text_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, fields)
