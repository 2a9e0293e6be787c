"""Lineage cuts, row selection, folds and ordered buckets shared by the operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode where the session names none (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        known = tempfile.mkdtemp(prefix="tidemill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


#: Rows in an Arrow batch that Spark hands to a Python worker: whole texts, so that a batch is a few MB.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, with the session's Arrow batches held to BATCH_ROWS rows: a batch is in memory twice a task."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


class Scope:
    """What was cached and cut while it was entered, to be freed once the results that use it are written.

    Only that: tables of other calls, whose results may not have been read yet, stay. Outside any scope caches and cuts
    belong to the session.
    """

    def __init__(self) -> None:
        self._kept: list[DataFrame] = []
        self._cuts: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        self._token = _scope.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scope.reset(self._token)

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        while self._cuts:
            delete(*self._cuts.pop())


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: computed once, and kept if executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scope := _scope.get():
        scope._cuts.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, level: StorageLevel | None = None) -> DataFrame:
    """``df`` cached (in memory and on disk, or at ``level``), for a table used more than once; lost parts are worked out again."""
    if scope := _scope.get():
        scope._kept.append(df)
    return df.persist() if level is None else df.persist(level)


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of the integer ``value`` over all rows before, in the total order ``order``.

    Rows are dealt by ranges and cut there, so that each range keeps its number; the driver gets one sum a range, and
    a window within each range does the rest. Add an id of the row to ``order`` where equal keys can be many.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in dealt.groupBy("_range").agg(F.sum(value)).collect()}
    before, total = [], 0
    for i in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(i) or 0
    start = F.from_json(F.lit(json.dumps(before)), "array<long>")[F.col("_range")]
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(name, (start + F.coalesce(inside, F.lit(0))).cast("long")).drop("_range")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most ``bound`` rows of ``df``, those of the smallest hash of ``keys``: the same rows for any partitioning."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(bound)


def drop_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (column doc_id); null ids stay, columns are untouched."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_anti").select("doc.*")


def sortable(value: Column) -> Column:
    """A 64-bit integer as 16 hex digits in the same order."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def ordered_buckets(rows: DataFrame, key: str) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with a column ``bucket``, first keys, last keys): rows dealt by ranges of the string column ``key``.

    The ranges come from one range partitioning of the keys alone; the driver gets two keys for each partition and no
    more. A row finds its range among them by two steps of a nested search, so equal keys share a bucket and the rest
    spread evenly, whatever their distribution.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()
    ends = sorted((r.a, r.b) for r in found)
    firsts, lasts = [a for a, _ in ends], [b for _, b in ends]
    step = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)] or [[""]]
    starts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<string>")
    nested = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")
    group = F.greatest(F.size(F.filter(starts, lambda x: x <= F.col(key))) - 1, F.lit(0))
    inside = F.greatest(F.size(F.filter(nested[F.col("_group")], lambda x: x <= F.col(key))) - 1, F.lit(0))
    out = rows.withColumn("_group", group).withColumn("bucket", (F.col("_group") * step + inside).cast("int")).drop("_group")
    return out, firsts, lasts
