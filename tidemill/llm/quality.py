"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams (one and two words) and of word-shape n-grams (one to three shapes; a shape is a word with
runs of capitals, letters and digits each put as one sign), and of runs of one repeated word, are hashed to 2**18
features. Each is scaled by the log of
its smoothed count ratio between the classes, rows are brought to unit length, and a linear hinge-loss model is fitted
by dual coordinate descent on at most ``TRAIN_ROWS`` labelled rows. The weights are mixed with their mean magnitude as
usual for this model. A fifth of the sample is held back from the fit to turn margins into probabilities.

Defined results: a null or empty text has no features and gets the score of margin 0; with no labels, or labels of one
class only, every score is that class's share (0.5 without labels). Repeated rows each give a row; texts are never cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .linear import grams, labelled_features, pairs, platt, score_rows
from .shared import fold
from .text import Words, mix

BITS = 18
TRAIN_ROWS = 5000
SMOOTHING = 1.0
COST = 1.0
BLEND = 0.25
EPOCHS = 12

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48
_SHAPE[[9, 10, 11, 12, 13]] = 32


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams of each text."""
    words = Words(data, offsets)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = Words(shape[keep], place[offsets], fold=False)
    parts = [grams(words, (), 1), grams(words, (1,), 2)]
    parts += [grams(shapes, (), 3), grams(shapes, (1,), 4), grams(shapes, (1, 2), 5)]
    same = np.zeros(len(words.hash) + 1, dtype=bool)
    same[1:-1] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    run = same[:-1]
    for n in (2, 3, 4):  # a word for the n-th time in a row
        at = np.flatnonzero(run)
        parts.append((words.row[at], np.full(len(at), mix(np.array([n], np.uint64))[0])))
        run = same[:-1] & np.concatenate([[False], run[:-1]])
    return pairs(parts, BITS)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float, epochs: int) -> np.ndarray:
    """Weights of the linear hinge-loss model: coordinate steps on the dual, one row at a time, in a fixed order."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([v @ v for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            index, value = rows[i]
            gradient = y[i] * (w[index] @ value) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[index] += step * y[i] * value
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


class Model:
    """Weights per feature (ratio times hinge weight), length per feature, and the calibration."""

    def __init__(self, sample: list[tuple[int, np.ndarray]]):
        y = np.array([1 if label == 1 else -1 for label, _ in sample])
        self.ratio = np.zeros(1 << BITS)
        self.weights = np.zeros(1 << BITS)
        self.a, self.b = 0.0, 0.0
        share = (y == 1).mean() if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.b = float(np.log(share / (1 - share)))
            return
        fit = np.arange(len(y)) % 5 != 4
        counts = {}
        for side in (1, -1):
            own = [f for (_, f), label, use in zip(sample, y, fit) if use and label == side]
            c = np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=1 << BITS) + SMOOTHING
            counts[side] = c / c.sum()
        self.ratio = np.log(counts[1] / counts[-1])
        rows = []
        for _, f in sample:
            v = self.ratio[f]
            rows.append((f, v / max(np.sqrt(v @ v), 1e-12)))
        w = dual_descent([r for r, use in zip(rows, fit) if use], y[fit], 1 << BITS, COST, EPOCHS)
        used = w != 0
        w = (1 - BLEND) * (np.abs(w[used]).mean() if used.any() else 0) + BLEND * w
        self.weights = w * self.ratio
        held = [r for r, use in zip(sample, fit) if not use]
        total = np.array([self.weights[f].sum() for _, f in held])
        count = np.array([len(f) for _, f in held])
        self.a, self.b = platt(self.margin(total, count), y[~fit])

    @staticmethod
    def margin(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return total / np.sqrt(np.maximum(count, 1))

    def finish(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(total, count) + self.b, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns where crc32(doc_id) mod 5 is not 0, scores every document."""
    held_out = fold("doc_id", 5) == 0
    model = Model(labelled_features(docs, labels, "quality", ~held_out, train_rows, featurize))
    return score_rows(docs, held_out, model.weights.astype(np.float32), featurize, model.finish)
