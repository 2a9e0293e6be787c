"""Mixing sources to target weights by a low-discrepancy schedule of slots over shuffled blocks of equal many words.

Sources in order of their code points (null last) have the weights 5, 2, 1, 5, 2, 1 ... and share as many words as all
documents have. A source gets ``CAP`` times its own words at most; what it can't take is shared by the others by weight
until none is above its cap.

The documents of a source, shuffled by a hash of their ids, are one stream of words, repeated up to ``CAP`` times and
cut into blocks of ``BLOCK`` words, as many as its target holds (the last one is shorter). Slot i of the schedule is the
point i * golden ratio modulo 1; the source whose part of [0, 1) holds it, by cumulative targets, has the slot, and the
k-th slot of a source takes the source's k-th block. So any stretch of the schedule holds the sources in their shares.
Slots beyond a source's last block stay empty; the few blocks that no slot reached follow after the last slot.

Nothing grows on the driver but a number for each partition: sources are ranked and summed by ranges, points find their
source through equal buckets of [0, 1), which a source of any share spreads over, and slots are counted by stretches of
the square root of their number, so neither a hot source nor a long schedule meets in one task.

Defined results: a null or empty text, or one of white space, has size 0 and is taken 0 times; without words all targets
are 0; a null doc_id counts as an empty one in the shuffle; rows that repeat a document are documents of their own; other
columns are ignored; an empty table gives an empty result. The same rows give the same result, whatever the partitioning.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, running

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block.
BLOCK = 512
#: Buckets of [0, 1) at least, and for each source.
BUCKETS, BUCKETS_EACH = 1024, 4
#: The golden ratio's fractional part to 60 digits, and points that are stepped at once so that doubles stay exact enough.
GOLDEN = Fraction("0.618033988749894848204586834365638117720309179805762862135448")
STEP = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, key) for every row of docs: words of its text, and the hash that shuffles it."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), key.alias("key"))


def streams(docs: DataFrame) -> DataFrame:
    """sizes(docs) with ``at``: the words before it when all sources' shuffled streams stand one after the other.

    The row's own number comes last in the order, so that a document that is repeated many times spreads over ranges;
    rows alike up to there are alike in every result.
    """
    return running(sizes(docs), [F.col("source").asc_nulls_last(), F.col("key"), F.col("size"), F.col("row")], F.col("size"), "at")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, rank, source_size, first, target, take) of the sources of streams: ``first`` is where its stream begins,
    ``take`` the target as a whole number."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("first"))
    ranked = running(found, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    weight = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    ranked = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    level, full = 0.0, None
    while True:  # the level rises, so each round holds the sources of the one before and more
        above = F.col("most") <= F.col("weight") * F.lit(level)
        total, held, left, n = ranked.agg(F.sum("source_size"), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == full or not left:
            break
        full, level = n, float(total - (held or 0)) / left
    target = F.when(above, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    out = ranked.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    return cut(out.select("source", "rank", "source_size", "first", "target", "take"))


def _fraction(x: Fraction) -> float:
    return float(x - int(x))


def point(i: Column) -> Column:
    """Frac(i * golden ratio): by steps, so that its error stays under 1e-9 up to 2^36 slots."""
    return ((i / STEP).cast("long") * F.lit(_fraction(STEP * GOLDEN)) + (i % STEP) * F.lit(_fraction(GOLDEN))) % 1.0


def slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(position, rank, number): the source of each position of the schedule and the block of it that stands there.

    sources: those of ``targets``. Positions are those of the slots, of which some stay empty; blocks that got no slot
    follow them.
    """
    spark = sources.sparkSession
    numbered = cut(running(sources.where("take > 0"), [F.col("rank")], F.col("take"), "before").withColumn("blocks", F.ceil(F.col("take") / block)))
    n, words, count = numbered.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("take"), F.lit(0)), F.count("*")).first()
    buckets = max(BUCKETS, BUCKETS_EACH * count)
    low, high = F.col("before") / F.lit(float(words or 1)), (F.col("before") + F.col("take")) / F.lit(float(words or 1))
    parts = numbered.select("rank", low.alias("low"), high.alias("high"))
    spans = F.sequence(F.floor(F.col("low") * buckets), F.least(F.floor(F.col("high") * buckets), F.lit(buckets - 1)))
    parts = parts.withColumn("bucket", F.explode(spans))
    stretch = max(1, int(n**0.5))
    points = spark.range(n).select(F.col("id").alias("position"), point(F.col("id")).alias("x"))
    points = points.withColumn("bucket", F.floor(F.col("x") * buckets)).withColumn("stretch", F.floor(F.col("position") / stretch))
    owned = points.join(parts, "bucket").where("low <= x and x < high").select("position", "rank", "stretch")
    # The k-th slot of a source: its slots in earlier stretches, and those before in its own.
    counts = owned.groupBy("rank", "stretch").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("rank", "stretch", "n", F.coalesce(earlier, F.lit(0)).alias("earlier")))
    place = F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("position")) - 1
    have = owned.withColumn("place", place).join(counts.drop("n"), ["rank", "stretch"]).withColumn("number", F.col("place") + F.col("earlier"))
    placed = have.join(numbered.select("rank", "blocks"), "rank").where("number < blocks").select("position", "rank", "number")
    reached = counts.groupBy("rank").agg(F.sum("n").alias("reached"))
    short = numbered.join(reached, "rank", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < blocks")
    late = running(short.select("rank", "blocks", "reached"), [F.col("rank")], F.col("blocks") - F.col("reached"), "ahead")
    late = late.withColumn("number", F.explode(F.sequence("reached", F.col("blocks") - 1)))
    return placed.unionByName(late.select((F.lit(n) + F.col("ahead") + F.col("number") - F.col("reached")).alias("position"), "rank", "number"))


def pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """(rank, number, row, doc_id, turn, from, words): what each block holds of each document of streams.

    turn counts the repeats of the stream, from is the first word in the document.
    """
    own = rows.where("size > 0").join(sources.where("take > 0"), rows.source.eqNullSafe(sources.source)).select("row", "doc_id", "size", "rank", "take", "source_size", (F.col("at") - F.col("first")).alias("start"))
    turns = own.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("start", F.col("start") + F.col("turn") * F.col("source_size"))
    used = turns.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("take"))).where("end > start")
    cells = used.withColumn("number", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    begin, stop = F.greatest("start", F.col("number") * block), F.least("end", (F.col("number") + 1) * block)
    return cells.select("rank", "number", "row", "doc_id", "turn", (begin - F.col("start")).alias("from"), (stop - begin).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schedule, documents, sources): the mix in order, and what it was made of.

    schedule (position, rank, number, row, doc_id, turn, from, words): the pieces of documents at each position; within
    a position they stand in order of turn and of their place in the stream.
    """
    rows = streams(docs)
    sources = targets(rows, weights, cap)
    return slots(sources, block).join(pieces(rows, sources, block, cap), ["rank", "number"]), rows, sources


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    schedule, rows, sources = mix(docs, weights, cap, block)
    words = schedule.groupBy("row").agg(F.sum("words").alias("taken"))
    named = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return named.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
