"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are indicators of single words, whole and cut to their first 4 and 6 bytes (so inflected forms of a stem share
a feature), of two neighbouring words and of two words with one between them, hashed to 2**20. Each coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so what is
broadcast is a short list of (feature, weight). Learns from at most ``TRAIN_ROWS`` labelled rows.

Defined results: a null or empty text has no features and gets the score of the bias alone; without labels every score
is 0.5. Repeated rows each give a row; texts are never cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .linear import grams, labelled_features, pairs, score_rows
from .shared import fold
from .text import Words, mix

BITS = 20
TRAIN_ROWS = 6000
ALPHA, BETA, L2 = 0.2, 1.0, 1.0
#: L1 is this times the square root of the number of training rows of the rarer label, as a feature's noise grows with it.
SPARSITY = 0.5
EPOCHS = 3
STEMS = (4, 6)

#: A word's outer signs don't count: "idiot," and "idiot" are one word.
_EDGE = np.arange(256, dtype=np.uint8)
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'":
    _EDGE[_c] = 32


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams and skip-grams of each text."""
    words = Words(_EDGE[data], offsets)
    stems = [(words.row, mix(words.heads(n) + np.uint64(n))) for n in STEMS]
    return pairs([grams(words, (), 1), grams(words, (1,), 2), grams(words, (2,), 3), *stems], BITS)


def fit(sample: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal over the sample, in a fixed order; the bias has no L1 term."""
    size = 1 << BITS
    toxic = sum(y == 1 for y, _ in sample)
    strength = SPARSITY * min(toxic, len(sample) - toxic) ** 0.5
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size, 0.0, strength)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(sample)):
            y, f = sample[k]
            i = np.append(f, size)
            w = weight(i)
            p = 1 / (1 + np.exp(-min(max(w.sum(), -30), 30)))
            g = p - (y == 1)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1], float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns where crc32(doc_id) mod 4 is not 2, scores every document."""
    held_out = fold("doc_id", 4) == 2
    weights, bias = fit(labelled_features(docs, labels, "toxic", ~held_out, train_rows, featurize))

    def finish(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))

    return score_rows(docs, held_out, weights.astype(np.float32), featurize, finish)
