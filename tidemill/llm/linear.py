"""Hashed n-gram features and labelled samples for the linear text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, small_batches
from .text import Words, chunks, column_bytes, distinct, mix

#: Turns a chunk's bytes and offsets into (row, feature) pairs, sorted by row then feature, each once.
Featurizer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def grams(words: Words, gaps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-gram made of each word and those ``gaps`` places after it, within the row."""
    reach = max(gaps, default=0)
    n = len(words.hash)
    at = np.arange(max(0, n - reach))
    at = at[words.row[at] == words.row[at + reach]] if n > reach else at[:0]
    h = words.hash[at] + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for g in gaps:
        h = mix(h) * np.uint64(3) + words.hash[at + g]
    return words.row[at], mix(h)


def pairs(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of hashed grams; features are ``bits`` bits."""
    rows = np.concatenate([r for r, _ in parts]).astype(np.int64)
    hashes = np.concatenate([h for _, h in parts])
    key = distinct(rows << bits | (hashes >> np.uint64(64 - bits)).astype(np.int64))
    return key >> bits, key & ((1 << bits) - 1)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, featurize: Featurizer) -> list[tuple[int, np.ndarray]]:
    """(label, features) of at most ``bound`` labelled rows for which ``train`` holds; whole texts.

    The ids are chosen from ``labels`` alone, by the smallest hash. A document with several labels counts with the
    largest; one without a text counts as an empty text. Rows come in order of id.
    """
    y = F.max(F.col(label).cast("int")).alias("y")
    ids = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(y)
    chosen = bounded_sample(ids, bound, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, off = column_bytes(batch.column("text"))
            row, feature = featurize(data, off)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "features"])

    # At most ``bound`` ids, so the broadcast side has a fixed size; rows that repeat an id are one document, whose
    # smallest feature list stays, so the driver gets at most ``bound`` lists.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    found = small_batches(rows).mapInArrow(run, "doc_id long, y int, features binary")
    got = found.groupBy("doc_id", "y").agg(F.min("features").alias("features")).collect()
    return [(r.y, np.frombuffer(r.features, "<i4").astype(np.int64)) for r in sorted(got, key=lambda r: r.doc_id)]


def score_rows(docs: DataFrame, held_out: Column, weights: np.ndarray, featurize: Featurizer, finish: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: ``finish(sum of weights, number of features)`` is the score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in chunks(batches, "text"):
            data, off = column_bytes(batch.column("text"))
            row, feature = featurize(data, off)
            total = np.bincount(row, weights=w[feature], minlength=batch.num_rows)
            score = finish(total, np.bincount(row, minlength=batch.num_rows))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.3).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) fitted to labels by Newton steps, with smoothed targets; a is not negative."""
    pos, neg = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1, 5 / max(size, 1e-12))
        a, b = max(a - step[0], 0.0), b - step[1]
        if size < 1e-9:
            break
    return float(a), float(b)
