"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts are cut into tokens: words, and numbers together with a unit that follows. A token's template is its lower-cased
word, or a typed placeholder: ``<num>`` for a number, ``<qty>`` for a number with a unit, ``<name>`` for a capitalised
word that doesn't begin a sentence. Windows of ``WINDOW`` = 8 template tokens are hashed and hash-joined between
documents and benchmark items. A window of fewer than ``LITERALS`` = 2 words that aren't slots says too little as a
template, so it is hashed by its own values instead, on both sides.

An item of fewer than ``WINDOW`` tokens is one window of its own length. Under ``SHORT`` = 5 tokens only its values
count, and under ``TINY`` = 3 tokens ("42", "Rome") only a document that holds nothing else matches it. All lengths are
searched in one pass over the documents.

A matched window aligns document and item at one shift. Within an alignment the slots must be consistent: each value
of the item (a number, quantity or name) always stands against the same value of the document. A window that holds an
inconsistent slot doesn't count, unless all its slots equal the item's. An item counts as leaked into a document when
the windows that count cover at least ``COVERAGE`` of its windows. So verbatim passages match with equal slots, and
re-parameterised questions match with other slot values.

The benchmark side is broadcast only if its windows are at most ``BROADCAST_WINDOWS``; beyond that the same join runs
by shuffle. All windows of all documents take part; what leaves a document is the matches only, and only documents
with a match are read again for their slots.

Defined results: null or empty texts match nothing; items without a token never match, nor does an empty benchmark;
repeated rows count once; rows with a null doc_id are left out of the report and kept by ``clean``; other columns are
ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_ids

WINDOW = 8
LITERALS = 2
SHORT = 5
TINY = 3
COVERAGE = 0.4
BROADCAST_WINDOWS = 1_000_000
#: Documents with a match are broadcast to the scan that reads their slots up to this many, else joined by shuffle.
BROADCAST_IDS = 1_000_000

# Units that a number may carry.
UNITS = (
    "percent|per cent|kilometers|kilometres|kilometer|kilometre|meters|metres|meter|metre|miles|mile|inches|inch|feet|foot|yards|yard|km|cm|mm|m"
    "|kilograms|kilogram|grams|gram|pounds|pound|ounces|ounce|tons|ton|kg|mg|g|lb|lbs|oz|liters|litres|liter|litre|ml|l"
    "|seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|ms|min|hrs|hr|h|s"
    "|dollars|dollar|cents|cent|euros|euro|usd|eur|degrees|degree|watts|watt|kw|w|volts|volt|v|hz|khz|mhz|ghz|kb|mb|gb|tb|mph|kmh"
)
_TOKEN = rf"(?:[.!?:\n][^\p{{L}}\p{{N}}]*)?(?:\p{{N}}(?:[\p{{N}}.,:/]*\p{{N}})?(?:(?: ?(?i:{UNITS})(?![\p{{L}}\p{{N}}]))| ?[%$€£])?|\p{{L}}+)"
_LEAD = r"^[^\p{L}\p{N}]+"
_SLOTS = ("<num>", "<qty>", "<name>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """array<string>: the tokens of a text; one that begins a sentence keeps the signs before it."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _typed(x: Column, word: Callable[[Column], Column], slot: Callable[[str], Column]) -> Column:
    """word of a token's lower-cased word, or slot of the name of its placeholder."""
    first = F.ascii(x)
    bare = F.regexp_replace(x, _LEAD, "")

    def number(y: Column) -> Column:
        return F.when(F.substring(y, -1, 1).rlike(r"\p{N}"), slot(_SLOTS[0])).otherwise(slot(_SLOTS[1]))

    return (
        F.when((first >= 97) & (first <= 122), word(F.lower(x)))
        .when((first >= 48) & (first <= 57), number(x))
        .when((first >= 65) & (first <= 90), slot(_SLOTS[2]))
        .when(first >= 128, F.when(x.rlike(r"^\p{N}"), number(x)).when(x != F.lower(x), slot(_SLOTS[2])).otherwise(word(x)))
        .otherwise(F.when(bare.rlike(r"^\p{N}"), number(bare)).otherwise(word(F.lower(bare))))
    )


def template(x: Column) -> Column:
    """The template of one token."""
    return _typed(x, lambda w: w, F.lit)


def code(x: Column) -> Column:
    """The hash of one token's template, odd for a word and even for a slot."""
    return _typed(x, lambda w: F.xxhash64(w).bitwiseOR(F.lit(1)), lambda name: F.xxhash64(F.lit(name)).bitwiseAND(F.lit(-2)))


def _value(x: Column) -> Column:
    """A token's own value: lower case, without the signs before a sentence."""
    return F.lower(F.regexp_replace(x, _LEAD, ""))


def windows(text: Column, sizes: list[int]) -> Column:
    """array<array<bigint>>: for each of ``sizes`` the hashes of a text's windows, by position.

    Sizes under TINY give a window only where it is the whole text.
    """

    def of_size(words: Column, t: Column, size: int) -> Column:
        fits = F.size(t) == size if size < TINY else F.size(t) >= size

        def at(i: Column) -> Column:
            values = F.xxhash64(F.lit(-size), F.transform(F.slice(words, i + 1, size), _value))
            if size < SHORT:
                return values
            template_hash = F.xxhash64(*[t[i + j] for j in range(size)])
            quick = t[i].bitwiseAND(t[i + 1]).bitwiseAND(F.lit(1)) == 1  # the first two are words: mostly so
            literals = sum((t[i + j].bitwiseAND(F.lit(1)) for j in range(size)), F.lit(0))
            return F.when(quick, template_hash).when(literals >= LITERALS, template_hash).otherwise(values)

        return F.when(fits, F.transform(F.sequence(F.lit(0), F.size(t) - size), at))

    return _let(tokens(text), lambda words: _let(F.transform(words, code), lambda t: F.array(*[of_size(words, t, n) for n in sizes])))


def spread(rows: DataFrame, text: str, sizes: list[int], *columns: str) -> DataFrame:
    """(columns, size, pos, hash): a row for each window of each row's text."""
    by_size = rows.select(*columns, F.posexplode(windows(F.col(text), sizes)).alias("which", "hashes"))
    size = F.array(*map(F.lit, sizes))[F.col("which")]
    return by_size.select(*columns, size.alias("size"), F.posexplode("hashes").alias("pos", "hash"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, same_slots) for each item found in a document.

    same_slots tells a passage with the item's own slot values from one with others.
    """
    items = (
        benchmark.where("item_id is not null and text is not null")
        .select("item_id", F.col("text").alias("item_text"))
        .distinct()
        .withColumn("length", F.size(tokens(F.col("item_text"))))
        .where("length > 0")
    )
    sizes = sorted(r.size for r in items.select(F.least("length", F.lit(WINDOW)).alias("size")).distinct().collect()) or [WINDOW]  # at most 8
    own = spread(items, "item_text", sizes, "item_id", "length").where(F.col("size") == F.least("length", F.lit(WINDOW)))
    own = own.select("item_id", "size", F.col("pos").alias("bpos"), "hash")
    if own.select(F.lit(1)).limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        own = F.broadcast(own)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(spread(texts, "text", sizes, "doc_id").join(own, ["size", "hash"]).select("doc_id", "item_id", "pos", "bpos", "size").distinct())

    # Slots: only documents and items with a match are read again.
    ids = found.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sides = (
        found.join(texts.join(ids, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("d")), "doc_id")
        .join(items.select("item_id", tokens(F.col("item_text")).alias("b")), "item_id")
    )
    slots = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.col("size") - 1),
            lambda j: F.struct(template(F.col("b")[F.col("bpos") + j]).alias("kind"), _value(F.col("b")[F.col("bpos") + j]).alias("bv"), _value(F.col("d")[F.col("pos") + j]).alias("dv")),
        ),
        lambda s: s["kind"].isin(*_SLOTS),
    )
    shift = (F.col("pos") - F.col("bpos")).alias("shift")
    keys = ["doc_id", "item_id", "shift"]
    seen = cut(sides.select("doc_id", "item_id", shift, "bpos", slots.alias("slots")))
    each = seen.select(*keys, "bpos", F.inline("slots"))
    broken = each.groupBy(*keys, "bv").agg(F.min("dv").alias("low"), F.max("dv").alias("high")).where("low <> high").select(*keys, "bv", F.lit(True).alias("broken"))
    by_window = (
        each.join(broken, [*keys, "bv"], "left")
        .groupBy(*keys, "bpos")
        .agg(F.max(F.coalesce("broken", F.lit(False))).alias("broken"), F.max(F.col("bv") != F.col("dv")).alias("other"))
    )
    good = seen.select(*keys, "bpos").join(by_window, [*keys, "bpos"], "left").where("broken is null or not broken or not other")
    total = items.select("item_id", F.greatest(F.col("length") - WINDOW + 1, F.lit(1)).alias("n")).groupBy("item_id").agg(F.max("n").alias("n_windows"))
    return (
        good.groupBy("doc_id", "item_id")
        .agg(F.countDistinct("bpos").alias("n_matched"), (~F.max(F.coalesce("other", F.lit(False)))).alias("same_slots"))
        .join(total, "item_id")
        .withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
        .where(F.col("coverage") >= COVERAGE)
        .select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "n_matched", "coverage", "same_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked; columns as in docs."""
    return drop_ids(docs, leaks(docs, benchmark))
