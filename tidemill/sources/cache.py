"""Tables kept beside the work: built once, read afterwards, rebuilt when their columns no longer fit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path if it was written to its end, else None."""
    fs, _ = _files(spark, path)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")):
        return None
    return spark.read.parquet(path)


def _fits(table: DataFrame, schema: str) -> bool:
    return dict(table.dtypes) == dict(table.sparkSession.createDataFrame([], schema).dtypes)


def cached(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The table at path, or what build gives, written there first. None if there is none and build gives None.

    schema: names and types that the table must have; one with others is stale. A new table is written to a folder of
    its own beside path and renamed when it is complete, so readers never meet half of one: what a lost run left without
    its end mark counts as absent. A stale table that can't be rebuilt stays where it is but isn't returned. If another
    run has published meanwhile, its table is taken.
    """
    found = published(spark, path)
    if found is not None and _fits(found, schema):
        return found.select(*_names(schema))
    table = build()
    if table is None:
        return None
    if not _fits(table, schema):
        raise ValueError(f"the table for {path} was built as {table.dtypes}, not as {schema}")
    fs, where = _files(spark, path)
    mark = uuid.uuid4().hex
    fresh, aside = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{mark}") for kind in ("new", "old"))
    table.select(*_names(schema)).write.parquet(fresh.toString())
    other = published(spark, path)
    if other is None or not _fits(other, schema):
        if fs.exists(where):
            fs.rename(where, aside)
        fs.rename(fresh, where)
    for left in (fresh, aside):
        fs.delete(left, True)
    return spark.read.parquet(path).select(*_names(schema))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
