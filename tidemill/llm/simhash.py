"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link when at most ``THRESHOLD`` = 2 bits differ.
The anchors are the codewords of the Hamming code on bits 0-62 (covering radius 1, perfect; bit 63 takes no part).
A pair at distance 2 has a midpoint one bit from both, and the midpoint has an anchor one bit away. So both lie within
covering radius plus half the threshold (2 bits) of a common anchor, and a fingerprint is replicated to exactly the
anchors in that ball: 32, or 1 for a codeword. (Covering radius plus the whole threshold on one side would need 684.)
What meets at an anchor is a ball of radius 2, at most 2 * 2017 distinct fingerprints whatever the corpus, and is
compared bit by bit. Exact copies share a fingerprint and are grouped before replication, so a large group of copies
is one row.

Defined results: a null text is an empty one; a text without a word has fingerprint 0, which links like any other;
rows with a null doc_id get a fingerprint and the component of their group; repeated rows stay, each with its
component; an empty table gives an empty result; other columns are ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import drop_ids, keep, small_batches
from .text import chunks

SHINGLE = 3
SEED = 42
THRESHOLD = 2

# Eight byte lanes of a 64-bit word for each byte value: lane t is bit t, so lanes of up to 255 hashes add up at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8): bit i is set if over half of the shingles' XXH64 have it set."""
    words = text.lower().split()  # bytes.lower and bytes.split: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64)
    bits = 2 * sums.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out = [simhash(t.encode() if t else b"", shingle) for t in batch.column("text").to_pylist()]
            fp = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, fp long")


def _anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of fp, anchor) for all codewords within 2 bits of each fingerprint's low 63 bits."""
    x = fp.view(np.uint64) & np.uint64((1 << 63) - 1)
    syndrome = np.zeros(len(x), dtype=np.int64)
    for i in range(63):
        syndrome ^= np.where((x >> np.uint64(i)) & np.uint64(1), i + 1, 0)
    bit = np.concatenate([[0], np.uint64(1) << np.arange(63, dtype=np.uint64)]).astype(np.uint64)
    index, anchor = [np.arange(len(x))], [x ^ bit[syndrome]]
    for i in range(1, 64):  # pairs of positions i < j whose columns add up to the syndrome
        j = syndrome ^ i
        use = np.flatnonzero((syndrome > 0) & (j > i))
        index.append(use)
        anchor.append(x[use] ^ bit[i] ^ bit[j[use]])
    return np.concatenate(index), np.concatenate(anchor).view(np.int64)


def near_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of prints.fp at most 2 bits apart."""

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            index, anchor = _anchors(np.ascontiguousarray(fp))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[index])], names=["anchor", "fp"])

    # A few bytes a row become 32 rows each, so the rows are dealt to all tasks instead of being merged by their bytes.
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("fp").distinct().repartition(n, F.xxhash64("fp"))
    balls = (
        distinct.mapInArrow(replicate, "anchor long, fp long")
        .groupBy("anchor")
        .agg(F.collect_list("fp").alias("ball"))  # at most 2 * 2017 values
        .where(F.size("ball") > 1)
    )
    near = F.filter("ball", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= THRESHOLD))
    return balls.select("ball", F.explode("ball").alias("a")).select("a", F.explode(near).alias("b")).distinct()


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable."""
    prints = keep(fingerprints(docs, shingle))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    pairs = near_pairs(prints)
    named = (
        pairs.join(groups.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
        .join(groups.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    roots = connected_components(named)
    labels = groups.join(roots, groups.rep == roots.node, "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents left when of each component only the one of the smallest doc_id stays; columns as in docs.

    Rows that repeat that doc_id all stay (they are one document), and so do rows with a null doc_id.
    """
    return drop_ids(docs, components(docs, shingle).where("doc_id <> component_id"))
