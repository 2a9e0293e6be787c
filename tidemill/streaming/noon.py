"""Noon-day means of a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.daily import cleaned


def noon_means(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """(d, metric, site, value): a day is emitted once the watermark, ``late`` behind, has passed its noon."""
    rows = cleaned(stream).withColumn("at", F.date_trunc("second", "ts")).withWatermark("at", late)
    day = F.window("at", "1 day", "1 day", "12 hours 1 second")
    out = rows.groupBy(day.alias("w"), "metric", "site").agg(F.avg("value").alias("value"))
    return out.select(F.to_date("w.end").alias("d"), "metric", "site", "value")
