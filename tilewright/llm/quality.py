"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text. The weights are learned from preference pairs (a document of label 1 over one of
label 0) by logistic loss on the difference of their features. A document is accepted if its strength is at least a quantile of the strengths of the labelled rows (each third of them by weights
learned from the others): the share of label 0 in it. The score is a logistic curve of the strength, with its slope fitted to the labels, that passes 0.7 at that threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import labelled
from tilewright.llm.shingles import words
from tilewright.llm.text import BYTE_HASH, U64, sliced, span_hash, utf8
from tilewright.session import discard, text_batches

#: Labelled documents up to which the fit is made on the driver; with more, about so many give the weights that the fit over all of them starts from.
TRAIN_ROWS = 12_000
#: Preference pairs in which each document of the rarer label is, and the strength of the penalty.
PAIRS_EACH, RIDGE = 6, 1e-2
#: Rows of each label from which on the threshold is that of rows left out of the fit.
FEWEST_FOLDED = 60
#: The score at the threshold.
AT_THRESHOLD = 0.7

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",", "!?", ";:'\"()-", "|<>{}[]\\/=_~^`", "#$%&*@+"]
_KINDS = len(_CLASSES) + 1
_CLASS = np.full(256, _KINDS - 1, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _k
#: Bits of a word's hash that tell its share apart from others'.
WORD_BITS = 8
#: Shares of byte classes, of pairs of classes and of hashed words, and six more.
FEATURES = _KINDS + _KINDS * _KINDS + (1 << WORD_BITS) + 6


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text; null and empty texts have zeros."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for i, j in sliced(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        rows, size = j - i, np.maximum(np.diff(at), 1)[:, None]
        row, kind = np.repeat(np.arange(rows), np.diff(at)), _CLASS[part]
        single = np.bincount(row * _KINDS + kind, minlength=rows * _KINDS).reshape(rows, -1)
        inside = row[1:] == row[:-1]
        pair = np.bincount((row[1:] * _KINDS * _KINDS + kind[:-1] * _KINDS + kind[1:])[inside], minlength=rows * _KINDS * _KINDS).reshape(rows, -1)
        starts, ends, first = words(part, at)
        h, n = span_hash(BYTE_HASH[part], starts, ends), np.diff(first)
        word = np.bincount(np.repeat(np.arange(rows), n) << WORD_BITS | (h >> U64(64 - WORD_BITS)).astype(np.int64), minlength=rows << WORD_BITS).reshape(rows, -1) / np.maximum(n, 1)[:, None]
        long = np.bincount(row, minlength=rows)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
        # lines that stand more than once
        feeds = np.flatnonzero(part == 0x0A)
        line_starts = np.unique(np.concatenate((at[:-1][np.diff(at) > 0], feeds + 1)))
        line_starts = line_starts[line_starts < len(part)]
        lines = span_hash(BYTE_HASH[part], line_starts, np.append(line_starts[1:], len(part)))
        line_first = np.searchsorted(line_starts, at)
        different = np.array([len(np.unique(lines[a:b])) for a, b in zip(line_first[:-1].tolist(), line_first[1:].tolist(), strict=True)])
        m = np.diff(line_first)
        letters = (ends - starts).astype(float)
        total = np.concatenate(([0.0], np.cumsum(letters)))[first]
        squares = np.concatenate(([0.0], np.cumsum(letters**2)))[first]
        mean = np.diff(total) / np.maximum(n, 1)
        extra = [np.log1p(long), mean, np.sqrt(np.maximum(np.diff(squares) / np.maximum(n, 1) - mean**2, 0)), distinct / np.maximum(n, 1), different / np.maximum(m, 1), np.log1p(n)]
        out[i:j] = np.where(long[:, None] > 0, np.concatenate([single / size, pair / size, word, np.stack(extra, axis=1)], axis=1), 0.0)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, strengths: np.ndarray) -> np.ndarray:
        shift = np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (strengths - self.threshold) + shift, -30, 30)))


def preferences(label: np.ndarray, pairs_each: int = PAIRS_EACH) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of label 1 and label 0, in which each row of either label stands about equally often."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    n = max(len(good), len(bad), pairs_each * min(len(good), len(bad)))
    rng = np.random.default_rng(29)
    return np.resize(rng.permutation(good), n), np.resize(rng.permutation(bad), n)


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE) -> QualityModel:
    """Weights by Newton's method on the pairs' logistic loss. With one label only, or no rows, all strengths are equal and everything is accepted."""
    if not len(x):
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model = QualityModel(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    model.weights = _weights(z, label, pairs_each, ridge)
    s = _left_out(z, label, pairs_each, ridge, model.strengths(x))
    ordered, k = np.sort(s), len(bad)
    model.threshold = float((ordered[k - 1] + ordered[k]) / 2)  # the quantile of the share of label 0
    best = np.inf
    for slope in 2.0 ** np.arange(-6, 7):
        model.slope = float(slope)
        p = np.clip(model.scores(s), 1e-9, 1 - 1e-9)
        loss = -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))
        if loss < best - 1e-4:
            best, chosen = loss, float(slope)
    model.slope = chosen
    return model


def _weights(z: np.ndarray, label: np.ndarray, pairs_each: int, ridge: float) -> np.ndarray:
    """The weights of least logistic loss on the pairs' differences, by Newton's method."""
    better, worse = preferences(label, pairs_each)
    diff, n = z[better] - z[worse], len(better)
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # the chance that the pair is the other way
        slope = -(diff.T @ p) / n + ridge * w
        curve = (diff * (p * (1 - p)).astype(np.float32)[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _left_out(z: np.ndarray, label: np.ndarray, pairs_each: int, ridge: float, own: np.ndarray) -> np.ndarray:
    """Strengths of the rows by weights that were learned without the row's third of them, as new documents have them; the own ones where a label has too few rows for that."""
    fold = np.empty(len(label), np.int64)
    for k in (0, 1):
        rows = np.flatnonzero(label == k)
        if len(rows) < FEWEST_FOLDED:
            return own
        fold[rows] = np.random.default_rng(31).permutation(len(rows)) % 3
    out = np.zeros(len(label))
    for f in range(3):
        seen = fold != f
        out[~seen] = z[~seen] @ _weights(z[seen], label[seen], pairs_each, ridge)
    return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learns from all labels (doc_id, quality) and docs (doc_id, text). Labels other than 0 and 1, null ids, and ids of both labels aren't used; repeated rows count once.

    Up to train_rows labelled rows are broadcast to find their texts, and the features of one text for each id come to the driver; with more, see fit_blocks().
    """
    known = labelled.known_labels(labels)
    sizes = dict(map(tuple, known.groupBy("quality").count().collect()))
    if sum(sizes.values()) > train_rows:
        if len(sizes) < 2:
            return fit(np.zeros((0, FEATURES)), np.zeros(0))
        table = labelled.blocks(docs, known, sizes, features)
        model = fit_blocks(table, train_rows)
        discard(table)
        return model
    rows = text_batches(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_sample_features, "doc_id long, quality int, x array<double>")
    table = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s")).select("doc_id", "s.quality", "s.x").orderBy("doc_id").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return fit(x, table.column("quality").to_numpy())


def fit_blocks(table: DataFrame, start_rows: int, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE) -> QualityModel:
    """What fit() does, over rows of any number in blocks (labelled.blocks): pairs are made within blocks, each row is in some, and losses are summed over all blocks.

    The first blocks give the weights to start from. The threshold is the exact quantile of all rows' strengths.
    """
    x, label, _ = labelled.first_rows(table, start_rows)
    n_rows, *sizes = (int(v) for v in labelled.over_blocks(table, lambda x, label, fold, own: np.array([own.sum(), *np.bincount(label[own], minlength=2)])))
    if not min(sizes):  # a label whose texts aren't there
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    mean, scale = labelled.moments(table, x.mean(axis=0))
    scale = np.maximum(scale, 1e-6)
    model = QualityModel(mean, scale, np.zeros(len(mean)), 0.0, 1.0)
    folds = labelled.FOLDS if min(sizes) >= FEWEST_FOLDED else 0

    def value(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(x: np.ndarray, label: np.ndarray, fold: np.ndarray, own: np.ndarray) -> np.ndarray:
            z = np.clip((x - mean) / scale, -8, 8)
            s, out, pull = z @ points.T, np.zeros((len(points), 2 + z.shape[1])), np.zeros((len(z), len(points)))
            for k in range(len(points)):  # the first with all rows, the others without a fold
                seen = np.flatnonzero(fold != k - 1)
                if len(np.unique(label[seen])) < 2:
                    continue
                better, worse = (seen[rows] for rows in preferences(label[seen], pairs_each))
                d = s[better, k] - s[worse, k]
                p = 1 / (1 + np.exp(np.clip(d, -30, 30)))
                pull[:, k] = np.bincount(worse, p, len(z)) - np.bincount(better, p, len(z))
                out[k, :2] = len(d), np.logaddexp(0, -d).sum()
            out[:, 2:] = pull.T @ z
            return out

        total = labelled.over_blocks(table, work).reshape(len(points), -1)
        n = np.maximum(total[:, :1], 1)
        return total[:, 1] / n[:, 0] + ridge / 2 * (points**2).sum(axis=1), total[:, 2:] / n + ridge * points

    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    w, curve = np.zeros(len(mean)), np.eye(len(mean))
    if len(np.unique(label)) == 2:
        w = _weights(z, label, pairs_each, ridge)
        better, worse = preferences(label, pairs_each)
        diff = (z[better] - z[worse]).astype(np.float64)
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(p) + ridge * np.eye(len(w))
    weights = labelled.minimise(value, np.tile(w, (1 + folds, 1)), curve)
    model.weights = weights[0]

    def left_out(x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (np.clip((x - mean) / scale, -8, 8) * (weights[1 + fold] if folds else weights[:1])).sum(axis=1)

    found = labelled.margins(table, left_out)
    model.threshold = sum(labelled.at_ranks(found, [sizes[0] - 1, sizes[0]])) / 2  # the quantile of the share of label 0
    slopes = 2.0 ** np.arange(-6, 7)
    losses = labelled.over_margins(found, lambda s, label: _slope_losses(model, s, label, slopes)) / n_rows
    discard(found)
    best = np.inf
    for slope, loss in zip(slopes.tolist(), losses.tolist(), strict=True):
        if loss < best - 1e-4:
            best, model.slope = loss, slope
    return model


def _slope_losses(model: QualityModel, s: np.ndarray, label: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """For each slope the sum of the log losses of strengths."""
    out = np.zeros(len(slopes))
    for k, slope in enumerate(slopes):
        p = np.clip(replace(model, slope=float(slope)).scores(s), 1e-9, 1 - 1e-9)
        out[k] = -np.where(label == 1, np.log(p), np.log(1 - p)).sum()
    return out


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the kept columns (doc_id), score (0 to 1) and predicted (1 if score >= 0.7, else 0). Null and empty texts are scored alike. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(model.strengths(features(batch.column("__text"))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(s, pa.float64()), pa.array((s >= AT_THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return text_batches(docs).select(*keep, docs["text"].alias("__text")).mapInArrow(run, fields)
