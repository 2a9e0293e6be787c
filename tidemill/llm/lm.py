"""Language-model scoring: a causal self-attention model on subword ids, beside a corpus-wide word unigram base.

A text is its sequence of words, A-Z lower-cased and split at ASCII white space, for the model as for the base: joined by
single spaces it is cut into ids of a public byte-level vocabulary, from which the words can be had back, so the model's
probability is that of the words. Texts are encoded once and kept on disk. The attention model (attention.py)
counts ids over all training documents, in tasks and then by a shuffle. Its weights start from a short fit on the
driver to at most ``START_DOCS`` documents of the smallest id hash. Then come ``ROUNDS`` rounds over the corpus: every
training document belongs to one of them by its id's hash, each task follows all its documents of the round by steps
of its own, which take every window of every text once, and the weights of all tasks, weighted by their numbers of
targets, are averaged by a shuffle and are where the next round begins. So the weights learn from every target of the
corpus. A round has as many tasks as can take ``LEAST_STEPS`` steps each, at most the corpus's partitions: a mean of
tasks that hardly moved would learn less the more tasks there are.

The base counts words over all training documents: counts are summed in tasks, then by word in a shuffle. The
``TOP_WORDS`` most frequent counts (a fixed bound, found by a histogram of the counts) are broadcast; what a document
has besides goes through a shuffle join with the full table, pre-aggregated by document and word, so no word is left
out and no frequent word becomes a hot key.

Defined results: a null text is an empty one and has one token, its end; without training documents the base score is
0 and the model is untrained; repeated rows each give a row; rows with a null doc_id count as training documents;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .shared import bounded_sample, fold, keep, small_batches
from .text import chunks

#: Documents of the fit that the weights start from, its passes and its rate.
START_DOCS = 1000
START_PASSES = 2
START_RATE = 0.02
#: Rounds over the corpus, and their rate at first.
ROUNDS = 4
RATE = 0.008
#: Steps that a task of a round should take at least; with fewer there are fewer tasks.
LEAST_STEPS = 48
#: Parameters in one row of a task's weights, and groups of tasks that are summed before the groups are.
SLOT = 4096
GROUPS = 256
TOP_WORDS = 1 << 17
#: Distinct words that a counting task holds before it hands them on.
FLUSH_WORDS = 300_000
#: Bytes of text scored at once; a longer text is scored whole.
CHUNK_BYTES = 1 << 18

# Fixed value: how the byte-level vocabulary's own tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def vocabulary(source: bytes) -> tiktoken.Encoding:
    """The encoder of a file of lines of base64 token and rank."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(vocab: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return np.array(vocab.encode_ordinary(text) if text else [], dtype="<u4")


def pack(ids: np.ndarray) -> bytes:
    """Ids as little-endian integers of as many bytes as they need (2 or 4), that number in front."""
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([wide]) + ids.astype(f"<u{wide}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def plain(text: str | None) -> str:
    """The words of a text, joined by single spaces."""
    return b" ".join(_words(text)).decode()


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # A-Z and ASCII white space only, as bytes methods do


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts of a task; the empty word stands for the end of a text."""

    def flush(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in chunks(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts.update(_words(text))
        counts[b""] += batch.num_rows
        if len(counts) > FLUSH_WORDS:
            yield flush(counts)
            counts.clear()
    if counts:
        yield flush(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs; the empty word counts the texts."""
    return small_batches(docs.select("text")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [unpack(x) for x in batch.column("ids").to_pylist()]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The texts' ids, some CHUNK_BYTES of them at once; a longer text is whole."""
    for batch in batches:
        texts, held = [], 0
        for t in _ids(batch):
            texts.append(t)
            held += 4 * (len(t) + 1)
            if held > CHUNK_BYTES:
                yield texts
                texts, held = [], 0
        if texts:
            yield texts


def encoded(rows: DataFrame, source: bytes) -> DataFrame:
    """rows (row, doc_id, held_out, text) with the column ids: the text's ids, packed."""
    shared = rows.sparkSession.sparkContext.broadcast(source)  # a vocabulary's size, under 1 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in chunks(batches, "text", 1 << 20):
            ids = [pack(encode(vocab, plain(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    return small_batches(rows).mapInArrow(run, "row long, doc_id long, held_out boolean, text string, ids binary")


def id_counts(train: DataFrame, ids: int, end: int) -> np.ndarray:
    """How often each id comes in the texts of train (column ids), the end once a text: counted in tasks, summed by id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ids, dtype=np.int64)
        for texts in _pieces(batches):
            n += np.bincount(np.concatenate(texts), minlength=ids)
            n[end] += len(texts)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have])], names=["id", "n"])

    found = train.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ids)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def _summed(rows: DataFrame, key: str, *others: str) -> DataFrame:
    """(slot, others, n, w): targets and weights (float64 bytes, already times the targets) of rows summed by slot and others."""

    def add(group: pa.Table) -> pa.Table:
        order = sorted(range(group.num_rows), key=lambda i: group.column(key)[i].as_py())  # the same sum whatever came first
        parts = group.column("w")
        total = np.frombuffer(parts[order[0]].as_py()).copy()
        for i in order[1:]:
            total += np.frombuffer(parts[i].as_py())
        n = pa.array([sum(group.column("n").to_pylist())], pa.int64())
        return pa.table({**{c: group.column(c).slice(0, 1) for c in ("slot", *others)}, "n": n, "w": pa.array([total.tobytes()], pa.binary())})

    schema = ", ".join(["slot int", *(f"{c} int" for c in others), "n long", "w binary"])
    return rows.groupBy("slot", *others).applyInArrow(add, schema)


def follow(p: dict[str, np.ndarray], of: attention.Layout, train: DataFrame, rounds: int = ROUNDS, rate: float = RATE, draw: int = 1, least_steps: int = LEAST_STEPS) -> dict[str, np.ndarray]:
    """Weights p fitted on to all texts of train (doc_id, ids), by rounds of local steps and averaging.

    draw: 1 learns from every window, k from each k-th.
    """
    spark = train.sparkSession
    layout = spark.sparkContext.broadcast(of)
    steps = of.total.sum() / rounds / draw / (attention.BATCH * attention.WINDOW)
    parts = train.select(F.spark_partition_id().alias("part")).distinct().count()
    tasks = max(1, min(int(steps / least_steps), parts) if least_steps else parts)
    turn = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(rounds)), F.lit(0))
    for i in range(rounds):
        weights = spark.sparkContext.broadcast(p)

        def run(batches: Iterable[pa.RecordBatch], i: int = i) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            fit = attention.Fit(weights.value, layout.value, rate * (1 - i / rounds), seed=part)
            for texts in _pieces(batches):
                fit.learn(texts, draw)
            if not fit.targets:
                return
            row = np.concatenate([v.ravel() for v in fit.p.values()]).astype(np.float64) * fit.targets
            parts = [row[at : at + SLOT].tobytes() for at in range(0, len(row), SLOT)]
            k = len(parts)
            columns = [pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([fit.targets] * k, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "part", "n", "w"])

        own = train.where(turn == i).select("ids")
        found = (own.coalesce(tasks) if tasks < parts else own).mapInArrow(run, "slot int, part int, n long, w binary")
        grouped = _summed(found.withColumn("some", F.pmod("part", F.lit(GROUPS)).cast("int")), "part", "some")
        rows = sorted(_summed(grouped, "some").collect(), key=lambda r: r.slot)  # one row for each SLOT parameters
        weights.unpersist()
        if rows:
            flat = np.concatenate([np.frombuffer(r.w) for r in rows]) / rows[0].n
            cuts = np.cumsum([v.size for v in p.values()])[:-1]
            p = {name: x.reshape(v.shape).astype(np.float32) for (name, v), x in zip(p.items(), np.split(flat, cuts))}
    return p


def fit(train: DataFrame, ids: int, start_docs: int = START_DOCS) -> attention.Model:
    """The attention model of train (doc_id, ids): ``ids`` ids, of which the last two begin and end a text.

    Counts and weights come from all texts; a bounded sample only gives the weights that the rounds start from.
    """
    begin, end = ids - 2, ids - 1
    of = attention.layout(id_counts(train, ids, end), begin, end)
    chosen = bounded_sample(train.where("doc_id is not null").select("doc_id").distinct(), start_docs, "doc_id")
    # At most start_docs ids, so the broadcast side has a fixed size; rows that repeat an id count as one document.
    rows = train.select("doc_id", "ids").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("ids").alias("ids")).collect()
    start = attention.Fit(attention.untrained(of), of, START_RATE)
    texts = [unpack(r.ids) for r in sorted(rows, key=lambda r: r.doc_id)]
    for _ in range(START_PASSES if texts else 0):
        start.learn(texts)
    return attention.Model(of, follow(start.p, of, train))


def top_words(counts: DataFrame, most: int = TOP_WORDS) -> pa.Table:
    """(word, n) of the words counted at least so often that they are ``most`` at most, by a histogram of the counts."""
    bins = 8
    step = F.floor(F.log2("n") * bins).cast("int")
    sizes = sorted(((r.step, r.m) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, total = None, 0
    for at, m in sizes:  # at most 64 * bins rows
        total += m
        if total > most:
            break
        least = at
    return counts.where(step >= least if least is not None else F.lit(False)).toArrow()


def score(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text); learns where crc32(doc_id) mod 7 is not 2.

    path: the vocabulary's file, lines of base64 token and rank.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        source = f.read()
    ids = vocabulary(source).n_vocab + 2
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counts = keep(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = top_words(counts)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    coded = keep(encoded(numbered, source), StorageLevel.DISK_ONLY)
    shared = spark.sparkContext.broadcast((top, fit(coded.where(~F.col("held_out")), ids)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_counts, model = shared.value
        words, n = top_counts.column("word").cast(pa.binary()).to_pylist(), top_counts.column("n").to_numpy()
        logs = dict(zip(words, np.log10(n + 1).tolist()))
        known_log = logs.get
        for batch in chunks(batches, "text", CHUNK_BYTES):
            n_tokens, top_sum, top_known, rest_words, rest_n, rest_at = [], [], [], [], [], [0]
            texts = batch.column("text").to_pylist()
            for text in texts:
                words = [*_words(text), b""]
                found = list(map(known_log, words))
                other = Counter([w for w, x in zip(words, found) if x is None]) if None in found else {}
                n_tokens.append(len(words))
                top_sum.append(sum(filter(None, found)))
                top_known.append(len(words) - found.count(None))
                rest_words += other.keys()
                rest_n += other.values()
                rest_at.append(len(rest_words))
            scores = model.log10_probabilities(_ids(batch))
            rest = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()).cast(pa.string()), pa.array(rest_n, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(top_sum, pa.float64()),
                    pa.array(top_known, pa.int64()), pa.array(scores), pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), rest),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "top_sum", "top_known", "score", "rest"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, top_sum double, top_known long, score double, rest array<struct<word: string, n: long>>"
    done = keep(coded.mapInArrow(run, schema))
    rest = done.select("row", F.inline("rest")).withColumnRenamed("n", "times")
    sums = (
        rest.join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_sum"), F.sum("times").alias("rest_known"))
    )
    zero = F.lit(0)
    return done.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("top_known") + F.coalesce("rest_known", zero)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("top_sum") + F.coalesce("rest_sum", zero.cast("double")) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score",
    )
