"""Importance resampling toward a target: n-gram buckets weigh documents, a distributed radix selection draws them.

A document's features are its words and pairs of consecutive words, each in one of ``BUCKETS`` buckets by crc32. The
bucket counts of all documents and of all target texts, summed by a shuffle, give each bucket a gain, the log of its
ratio of shares. A document's weight is the mean gain of its features, looked up in the array of gains, whose size is
fixed; its score adds Gumbel noise of its id's hash, so the highest scores are a draw without replacement by weight.

How many documents there are to draw is a count. The last one drawn is found by its composite key (score, document id)
digit by digit: a round counts the keys by their next 16 bits among those that agree so far, which is at most 65,536
counts however many rows, and picks the digit that holds the sought place. So no row is sorted to find it; only drawn
rows are sorted, by ranges, and numbered.

In Python crc32 is worked out for words alone, and once for each distinct word of a chunk. A pair's checksum follows from
those of its parts by the linear shift that crc32 has (tables for shifts of up to ``SHIFTS`` bytes, applied again for more).

Defined results: null and empty texts have no features, weight 0 and aren't drawn (they have under ``MIN_WORDS`` words);
a null doc_id counts as an empty one in the hash and comes last among ties; of rows alike in doc_id and score that
the last place divides, those of fewest features and least weight come first; an empty target or table works alike, with
counts of 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, running, small_batches
from .text import chunks

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
#: Bits of a digit of the key.
DIGIT = 16
SHIFTS = 64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # what is left when A-Z is lower-cased
_POLYNOMIAL = 0xEDB88320  # fixed value: crc32's, bits reversed


def _shift_tables() -> np.ndarray:
    """[bytes, which byte of the checksum, its value]: what the checksum becomes when so many zero bytes follow."""
    step = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ _POLYNOMIAL, step >> 1)
    step = step.astype(np.uint32)
    place = np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8)
    now = np.arange(256, dtype=np.uint32)[None, :] << place
    out = [now]
    for _ in range(SHIFTS):
        now = step[now & np.uint32(255)] ^ (now >> np.uint32(8))
        out.append(now)
    return np.array(out)


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums after ``size`` more zero bytes; combined by xor with the checksum of what follows, that of both."""
    left = size.copy()
    while True:
        by = np.minimum(left, SHIFTS)
        crc = _SHIFT[by, 0, crc & 255] ^ _SHIFT[by, 1, crc >> 8 & 255] ^ _SHIFT[by, 2, crc >> 16 & 255] ^ _SHIFT[by, 3, crc >> 24]
        left -= by
        if not left.any():
            return crc


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, each text's number of words, each text's number of features), texts one after the other."""
    found = [_WORD.findall(t.encode().lower()) if t else [] for t in texts]
    n = np.array([len(x) for x in found], dtype=np.int64)
    flat = [w for x in found for w in x]
    if not flat:
        return np.zeros(0, np.int64), n, np.zeros_like(n)
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in flat], dtype=np.int64)
    alone = np.array([crc32(w) for w in number], dtype=np.uint32)
    after = np.array([crc32(b" " + w) for w in number], dtype=np.uint32)
    size = np.array([len(w) + 1 for w in number], dtype=np.int64)
    second = at[1:]
    both = shifted(alone[at[:-1]], size[second]) ^ after[second]
    row = np.repeat(np.arange(len(texts)), n)
    same = np.flatnonzero(row[1:] == row[:-1])
    values = np.concatenate([alone[at], both[same]]).astype(np.int64) % buckets
    rows = np.concatenate([row, row[same]])
    return values[np.argsort(rows, kind="stable")], n, n + np.maximum(n - 1, 0)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) each bucket holds: added up in tasks, then by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in chunks(batches, "text", 1 << 20):
            n += np.bincount(features(batch.column("text").to_pylist(), buckets)[0], minlength=buckets)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have])], names=["bucket", "n"])

    found = small_batches(texts.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()  # as many rows as buckets
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths of a nat: the log of its share of the target over its share of the source, smoothed."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in chunks(batches, "text", 1 << 20):
            values, words, n = features(batch.column("text").to_pylist(), len(table))
            total = np.concatenate([[0], np.cumsum(table[values])])
            end = np.cumsum(n)
            weight = (total[end] - total[end - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, of the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _digits(key: list[Column]) -> list[Column]:
    """The key's parts (64-bit integers, ascending) as unsigned digits of DIGIT bits, the most significant first."""
    mask = (1 << DIGIT) - 1
    return [F.shiftrightunsigned(k.bitwiseXOR(F.lit(-(1 << 63))), 64 - DIGIT * (i + 1)).bitwiseAND(F.lit(mask)) for k in key for i in range(64 // DIGIT)]


def up_to(rows: DataFrame, key: list[Column], count: int) -> Column:
    """A condition that holds for the ``count`` rows of the smallest key, and for rows whose key equals the last one's.

    key: 64-bit integers that aren't null, compared in order. A round counts rows by the next digit among those that
    agree with the sought key so far; it ends as soon as whole digits make up the count.
    """
    digits = _digits(key)
    below, prefix, left = F.lit(False), F.lit(True), count
    if count <= 0:
        return below
    for digit in digits:
        counts = sorted((r[0], r[1]) for r in rows.where(prefix).groupBy(digit.alias("digit")).agg(F.count("*")).collect())  # 2 ** DIGIT at most
        for value, n in counts:
            if n >= left:
                break
            left -= n
        if n == left or value == counts[-1][0] and n <= left:
            return below | (prefix & (digit <= value))
        below, prefix = below | (prefix & (digit < value)), prefix & (digit == value)
    return below | prefix


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn toward target (text).

    Of the rows with at least min_words words, percent in a hundred (rounded down) are drawn: rank counts them from the
    highest score, ties by doc_id, and is null for the others.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise("doc_id"))
    scored = keep(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("fit")))
    fit = scored.where("fit")
    count = percent * fit.count() // 100
    key = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).cast("long")]
    drawn = F.col("fit") & up_to(fit, key, count)
    order = [*key, F.col("n_features"), F.col("weight"), F.col("row")]
    ranked = running(scored.where(drawn).withColumn("row", F.monotonically_increasing_id()), order, F.lit(1), "before")
    place = F.when(F.col("before") < count, F.col("before") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, place.alias("rank")).unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
