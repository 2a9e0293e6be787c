"""Document fingerprints by closed syncmers, with DataFrame functions only.

Tokens are the lower-cased words of a text. A window of ``K`` = 5 words is chosen when the smallest hash among its
inner runs of ``S`` = 2 words is its first or last run: the choice depends on the window alone, so the same passage
has the same anchors wherever it stands. ``anchors`` gives every chosen window with its position; ``matches`` compares
whole tables of them.

Two texts are compared by the positions of all their anchors: two anchors that follow each other make a step (both
hashes and the words between their positions), so a step is common to two texts where both anchors stand at one shift
of positions, and a passage moved as a whole keeps its steps. ``likeness`` is the share of the steps of either text
that both have; nothing of it is sampled. The fingerprint column is a short sketch, the ``SKETCH`` smallest anchor
hashes as hex, for equality and look-ups; likeness doesn't depend on it.

Defined results: a null text is an empty one; a text without a chosen window (always so under five words) has one
anchor at word 0, the hash of the whole text, so equal texts have equal fingerprints and likeness 1; rows with a null
doc_id come first in the order, rows that repeat a doc_id stand in the order of their text's hash, and each gives a row;
other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ordered_buckets, sortable

K = 5
S = 2
SKETCH = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.transform(F.array(value), body)[0]


def anchor_list(text: Column) -> Column:
    """array<struct<pos int, anchor bigint>> of the text's closed syncmers, in order."""
    inner = K - S + 1
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:  # S = 2 neighbours
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))

    def chosen(s: Column) -> Column:
        def closed(i: Column) -> Column:
            first, last = s[i], s[i + inner - 1]
            middle = [s[i + j] for j in range(1, inner - 1)]
            at_first, at_last = first <= last, last <= first
            for m in middle:
                at_first, at_last = at_first & (first <= m), at_last & (last <= m)
            return at_first | at_last

        places = F.when(F.size(s) >= inner, F.filter(F.sequence(F.lit(0), F.size(s) - inner), closed))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(s[i], s[i + 2], s[i + 3]).alias("anchor")))

    found = _let(_let(hashes, runs), chosen)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat(F.lit("\0"), text)).alias("anchor")))
    return _let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole))


def sketch(found: Column) -> Column:
    """The smallest SKETCH distinct hashes of a text's anchors, sorted."""
    return F.slice(F.array_sort(F.array_distinct(found["anchor"])), 1, SKETCH)


def steps(found: Column) -> Column:
    """array<bigint>: the distinct steps of a text's anchors, the last anchor counting as one by itself."""
    n = F.size(found)
    follow = F.zip_with(
        F.slice(found, 1, n - 1), F.slice(found, 2, n), lambda a, b: F.xxhash64(a["anchor"], b["anchor"], b["pos"] - a["pos"])
    )
    return F.array_distinct(F.concat(F.filter(follow, lambda x: x.isNotNull()), F.array(F.xxhash64(F.element_at(found, -1)["anchor"]))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the steps of two texts together that both have: 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def as_hex(values: Column) -> Column:
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, anchor): every anchor of every text."""
    rows = docs.select("doc_id", anchor_list(F.coalesce("text", F.lit(""))).alias("found"))
    return rows.select("doc_id", F.inline("found"))


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shift, n): anchors that two texts share at one distance between their positions.

    ``left`` and ``right`` are rows of ``anchors``. Adaptive execution splits a frequent anchor's join.
    """
    a = left.select(F.col("doc_id").alias("left_id"), F.col("pos").alias("p"), "anchor")
    b = right.select(F.col("doc_id").alias("right_id"), F.col("pos").alias("q"), "anchor")
    joined = a.join(b, "anchor").where("left_id <> right_id")
    return joined.groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n"))


def fingerprinted(text: Column) -> Column:
    """struct<sketch, steps> of a text."""
    return _let(anchor_list(text), lambda found: F.struct(sketch(found).alias("sketch"), steps(found).alias("steps")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, print, next_text, next_print) of docs (doc_id, text): those of the next doc_id, after the last the first.

    Rows are dealt by ranges of doc_id and ordered within them; only each range's first row goes to the range before
    as well. The work on a text is done once, after it was dealt.
    """
    key = F.concat(F.coalesce(sortable(F.col("doc_id")), F.lit("")), sortable(F.xxhash64("text")))
    rows, firsts, _ = ordered_buckets(docs.select("doc_id", "text", key.alias("key")), "key")
    n = max(1, len(firsts))
    first = F.from_json(F.lit(json.dumps(firsts)), "array<string>")[F.col("bucket")]
    before = F.pmod(F.col("bucket") - 1, F.lit(n))
    # The first row of all follows the last one, so it stands behind all others of that range.
    at = F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("extra")))
    both = F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("extra")), F.struct(before.alias("at"), F.lit(1).alias("extra")))
    dealt = rows.select("doc_id", "text", "key", F.inline(F.when(F.col("key") == first, both).otherwise(at)))
    dealt = dealt.repartition(n, "at").sortWithinPartitions("at", "extra", "key")
    order = Window.partitionBy("at").orderBy("extra", "key")
    made = dealt.select("doc_id", "text", "key", "at", "extra", fingerprinted(F.col("text")).alias("print"))
    made = made.select("*", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print"))
    return made.where("extra = 0").select("doc_id", "text", "print", "next_text", "next_print")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness, beside that of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first.
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))")
    rows = rows.select("doc_id", "n_chars", "print", "next_print", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprinted(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("print.sketch")).alias("fingerprint"),
        as_hex(F.col("other.sketch")).alias("edited_fingerprint"),
        likeness(F.col("print.steps"), F.col("other.steps")).alias("near_edited"),
        likeness(F.col("print.steps"), F.col("next_print.steps")).alias("near_next"),
    )
