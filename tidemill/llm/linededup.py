"""Line deduplication: near-equal lines by MinHash, one line kept per component.

1. Lines of at least ``MIN_CHARS`` characters (trimmed, lower-cased) are told apart by a 64-bit hash. A task works out
   the signature of a line it meets again only once, and what is shuffled later are distinct (band, line) pairs, so a
   line that stands in a third of all documents is as cheap as any other.
2. Each line gets a one-permutation MinHash signature of ``SLOTS`` = 40 slots over its ``SHINGLE``-character
   shingles, empty slots filled from the next full one, cut into 10 bands of 4: a pair of Jaccard similarity 0.8
   shares a band with probability 0.995.
3. Lines that share a band are candidates. Bands with the same members are compared once. A band of more than
   ``BLOCK`` lines is dealt to tasks as pairs of blocks, so every pair still meets. Candidates are verified by exact
   Jaccard similarity of their shingle sets, at ``SIMILARITY`` or more; a pair already known to be connected within
   the group isn't compared again, so what comes out is a spanning forest, not all pairs.
4. Distributed union-find gives components; the line of the smallest (doc_id, line number) stays, all others go.

Lines under ``MIN_CHARS`` characters take no part in 2 and 3; with ``short``, as in the registered queries, they are
grouped by their hash like all others, so their exact repeats go too.

Defined results: without ``short`` shorter lines are never removed; lines of spaces only stay; null and empty texts have no lines; a document may end up with an
empty text but is never dropped; rows with a null doc_id come first in the order; rows that repeat a doc_id are one
document, so their equal line numbers stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import keep, small_batches
from .text import chunks, distinct, mix

MIN_CHARS = 30
SHINGLE = 8
SLOTS = 40
BAND = 4
SIMILARITY = 0.8
BLOCK = 256
BINS = 256
#: Lines whose hash a task remembers; a line beyond them gets its signature again.
MET_LINES = 500_000
#: Candidate lines are broadcast to the scan that fetches their text up to this many, else joined by shuffle.
BROADCAST_LINES = 1_000_000

_PRIMES = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(SHINGLE)]


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of the lines; each line has at least SHINGLE characters."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.array([len(x) for x in lines])
    n = len(codes) - SHINGLE + 1
    h = codes[:n] * _PRIMES[0]
    for j in range(1, SHINGLE):
        h += codes[j : n + j] * _PRIMES[j]
    start = np.cumsum(size) - size
    line = np.repeat(np.arange(len(lines)), size)[:n]
    inside = np.arange(n) <= (start + size - SHINGLE)[line]
    return line[inside], mix(h[inside])


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, SLOTS) one-permutation MinHash."""
    line, h = _shingle_hashes(lines)
    out = np.full(len(lines) * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    slot = ((h >> np.uint64(40)) * np.uint64(SLOTS) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(out, line * SLOTS + slot, h)
    out = out.reshape(-1, SLOTS)
    empty = out == np.iinfo(np.uint64).max
    for step in range(1, SLOTS):  # an empty slot takes the next full one, marked by the distance
        if not empty.any():
            break
        other = np.roll(out, -1, axis=1)
        take = empty & ~np.roll(empty, -1, axis=1)
        out = np.where(take, mix(other + np.uint64(1)), out)
        empty &= ~take
    return out


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line_no, h, bands): each line's place and hash, and its band hashes where the task first meets it."""
    bands = SLOTS // BAND
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    met: set[int] = set()
    for batch in chunks(batches, "line", 1 << 19):
        hs = batch.column("h").to_pylist()
        long = (pc.utf8_length(batch.column("line")).to_numpy(zero_copy_only=False) >= MIN_CHARS).tolist()
        new = []
        for i, h in enumerate(hs):
            if long[i] and h not in met:
                new.append(i)
                if len(met) < MET_LINES:
                    met.add(h)
        sizes = np.zeros(len(hs), dtype=np.int64)
        sizes[new] = bands
        key = np.zeros((0, bands), dtype=np.uint64)
        if new:
            sig = signatures(batch.column("line").take(pa.array(new)).to_pylist()).reshape(-1, bands, BAND)
            key = np.broadcast_to(salt, sig.shape[:2]).copy()
            for j in range(BAND):
                key = mix(key ^ sig[:, :, j]) * np.uint64(5)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64).ravel()))
        columns = [batch.column("doc_id"), batch.column("line_no"), batch.column("h"), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "h", "bands"])


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct shingles, by 48 bits of their hash and sorted, one line after the other; offsets."""
    line, h = _shingle_hashes(lines)
    key = distinct(line.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    offsets = np.searchsorted(key, np.arange(len(lines) + 1, dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), offsets


def _similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return common >= SIMILARITY * (a + b - common)


def _tagged(keys: np.ndarray, offsets: np.ndarray, count: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The keys of lines, one after the other, each with the place of its line in front."""
    length = count[lines]
    index = np.arange(length.sum()) + np.repeat(offsets[lines] - (np.cumsum(length) - length), length)
    return np.repeat(np.arange(len(lines), dtype=np.uint64), length) << np.uint64(48) | keys[index]


def links_of_groups(lines: list[str], sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Spanning forests of the pairs of exact Jaccard similarity SIMILARITY or more, within each group of lines.

    The groups follow each other in lines. In each round every group that isn't one cluster yet compares its next line
    with all lines of other clusters that it hasn't met, for all groups at once. So a group whose lines are all like
    its first one takes one round, and no pair of lines of different clusters stays uncompared.
    """
    keys, offsets = _sets(lines)
    count = np.diff(offsets)
    size = np.array(sizes)
    group = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    cluster = np.arange(len(lines))
    clusters = size.copy()
    done = np.zeros(len(lines), dtype=bool)
    bin_of_key = np.repeat(np.arange(len(lines)) * BINS, count) + (keys & np.uint64(BINS - 1)).astype(np.int64)
    bins = np.bincount(bin_of_key, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)
    while True:
        at = np.flatnonzero(~done & (clusters > 1)[group])
        if not len(at):
            return
        pivots = at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]
        done[pivots] = True
        pivot = np.full(len(size), -1)
        pivot[group[pivots]] = pivots
        at = at[~done[at]]
        mine = pivot[group[at]]
        a, b = count[at], count[mine]
        others = at[(cluster[at] != cluster[mine]) & (np.minimum(a, b) >= SIMILARITY * np.maximum(a, b))]
        if not len(others):
            continue
        mine = pivot[group[others]]
        # What two lines share is at most what their shingles share bin by bin, so most unlike pairs need no more.
        most = np.minimum(bins[others], bins[mine]).sum(axis=1)
        may = _similar(most, count[others], count[mine])
        others, mine = others[may], mine[may]
        if not len(others):
            continue
        both = np.concatenate([_tagged(keys, offsets, count, others), _tagged(keys, offsets, count, mine)])
        both.sort()
        same = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
        common = np.bincount(same.astype(np.int64), minlength=len(others))
        hits = np.flatnonzero(_similar(common, count[others], count[mine]))
        for i, p in zip(others[hits].tolist(), mine[hits].tolist()):
            if cluster[i] != cluster[p]:
                g = group[p]
                own = cluster[start[g] : start[g] + size[g]]
                own[own == cluster[i]] = cluster[p]
                clusters[g] -= 1
                yield p, i


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each group of rows (bucket, i, j, h, line), which come sorted by group."""
    key, hs, lines, sizes, chars = None, [], [], [], 0

    def finish():
        pairs = [(hs[x], hs[y]) for x, y in links_of_groups(lines, sizes)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for *k, h, line in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if k != key:
                if chars > 1 << 19 or len(lines) > 4_000:  # whole groups only
                    yield finish()
                    hs, lines, sizes, chars = [], [], [], 0
                key = k
                sizes.append(0)
            sizes[-1] += 1
            hs.append(h)
            lines.append(line)
            chars += len(line)
    if lines:
        yield finish()


def lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line, h): the lines of at least ``least`` characters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "line_no", F.lower(F.trim("raw")).alias("line")).where(F.length("line") >= least)
    return rows.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h"))


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Verified links (a, b) between the hashes of distinct lines; signed: the rows of _signed for docs."""
    # One shuffle by band serves the search for bands of several lines and the join with them.
    spread = signed.select(F.explode("bands").alias("band"), "h").repartition("band")
    several = spread.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("band")
    members = keep(spread.join(several.hint("shuffle_hash"), "band").distinct())
    buckets = (
        members.groupBy("band")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("mark"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("mask"))
        .groupBy("n", "mark", "mask")
        .agg(F.min("band").alias("band"))
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h", F.lit(1)), F.col("g")).cast("int")
    dealt = keep(
        members.join(buckets.select("band", "n"), "band")
        .select("band", "h", blocks.alias("g"))
        .select("band", "h", "g", own.alias("own"))
        .select("band", "h", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
        .select(F.col("band").alias("bucket"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h")
    )
    wanted = dealt.select("h").distinct()
    if dealt.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = lines(docs).select("h", "line").join(wanted, "h").groupBy("h").agg(F.min("line").alias("line"))
    keys = ["bucket", "i", "j"]
    grouped = dealt.join(texts, "h").select(*keys, "h", "line").repartition(*keys).sortWithinPartitions(*keys, "h")
    return grouped.mapInArrow(_verify, "a long, b long")


def removals(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, line_no) of every line that goes; with short also exact repeats of lines under MIN_CHARS characters."""
    signed = keep(small_batches(lines(docs, 1 if short else MIN_CHARS)).mapInArrow(_signed, "doc_id long, line_no int, h long, bands array<long>"))
    roots = connected_components(links(docs, signed))
    places = signed.select("doc_id", "line_no", "h")
    firsts = places.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    named = firsts.join(roots, firsts.h == roots.node, "left").select("h", "first", "n", F.coalesce("root", "h").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where("all > 1")
    goes = named.join(kept, "root").select("h", "kept")
    return places.join(goes, "h").where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("kept"))).select("doc_id", "line_no")


def report(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per row of docs its lines and the numbers of those that go, from 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")))
    gone = removals(docs, short).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed")).withColumnRenamed("doc_id", "_id")
    joined = rows.join(gone, rows.doc_id.eqNullSafe(gone["_id"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs with the lines that go cut out of text, and n_chars (if there) counted anew; other columns unchanged."""
    gone = removals(docs, short).groupBy("doc_id").agg(F.collect_set("line_no").alias("removed")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("key"))
    joined = rows.join(gone, F.col("key").eqNullSafe(F.col("id")), "left")
    parts = F.split("doc.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "removed")
    text = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: p[i]), "\n"))[0]
    changed = F.col("removed").isNotNull() & F.col("doc.text").isNotNull()
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    columns = [F.when(changed, new[c]).otherwise(F.col(f"doc.{c}")).alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns]
    return joined.select(*columns)
