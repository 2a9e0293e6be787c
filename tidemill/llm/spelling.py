"""Spelling variants grouped by a symmetric-delete join.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts with A-Z lower-cased. In one of ``NOISE``
(document, run) pairs, by a hash, a letter is dropped, which plants the misspellings that the operator finds. Counted are
the distinct results of at least ``MIN_LENGTH`` code points; words of at least ``MIN_COUNT`` occurrences take part.

Every word emits itself and its distinct single deletions. Two words one edit apart share exactly one of these keys: if
one is longer, the shorter word itself; if they differ in one place, what is left without it (a second common key would
make the deletions at both places the same string). So the equi-join on keys finds each pair once, and an exact distance
check rejects what shares a key by deletions at different places. The words of one key differ from it by one inserted
letter, so they are at most (length + 1) * 90 whatever the corpus, and no corpus-wide count makes a key hot.

Per word the near words are counted and the one of most occurrences (ties: first in code-point order) is its form, if it
has at least ``RATIO`` times the word's own. As counts at least double along forms, there are no circles and chains are
short; roots are found by joining each root with its own root until nothing changes, which doubles the reach each time.

Texts are counted in tasks, so a frequent word is one row a task before the shuffle.

Every join is asked for as a sort-merge join. Spark takes an exploded table to be as large as what it was exploded from, and
a Parquet table to be as large as its files, so from sizes alone it would send all words, or all their keys, through the
driver to every task where the words' files are small but their rows many.

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the hash; rows that repeat a
document count again; other columns are ignored; an empty table, or one without words, gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .text import chunks

NOISE = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: Distinct words that a counting task holds before it hands them on.
FLUSH_WORDS = 300_000

_RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)  # shorter runs are no words, with or without a letter dropped


def words_of(doc_id: int | None, text: str, noise: int = NOISE) -> Counter:
    """The words of a text with how often they come, letters dropped as the hash of document and run says."""
    lower = text.encode().lower().decode()  # bytes.lower is A-Z only
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(lower)).items():
        h = crc32(run.encode(), start)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        out[run] += n
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in chunks(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if text:
                counts.update(words_of(doc_id, text))
            if len(counts) > FLUSH_WORDS:
                yield flush(counts)
                counts = Counter()
    if counts:
        yield flush(counts)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) that come at least min_count times."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = small_batches(rows).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def keys(words: DataFrame) -> DataFrame:
    """(key, word, n): every word with itself and with its distinct single deletions."""
    places = F.sequence(F.lit(1), F.length("word"))
    deletions = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    return words.select(F.explode(F.array_distinct(F.concat(F.array("word"), deletions))).alias("key"), "word", "n")


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the ordered pairs of words (word, n) that are one edit apart, each once."""
    emitted = keys(words)
    others = emitted.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    return emitted.join(others.hint("merge"), "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(found.hint("merge"), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of links (word, form): the last of the forms that follow from word.

    Words that no link leads on from aren't returned. A circle would never settle; after max_rounds that raises.
    """
    found = cut(links.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = found.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found = cut(stepped)
        moved = found.agg(F.count_if("moved")).first()[0]
        found = found.drop("moved")
        if not moved:
            return found
    raise RuntimeError(f"forms didn't settle in {max_rounds} rounds")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text)."""
    table = cut(forms(cut(vocabulary(docs))))
    ends = roots(table.where("form is not null"))
    return table.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
