"""Observations to daily values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_name, no_nan, noon_day, second_of_day, valid

STATISTICS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median}


def cleaned(obs: DataFrame) -> DataFrame:
    """Observations without the sentinel and with NaN made null."""
    return obs.where(valid(F.col("value"))).withColumn("value", no_nan(F.col("value")))


def by_noon_day(obs: DataFrame, *keys: str) -> DataFrame:
    """Mean by noon day and keys (metric, site, or none); rows with a null key are left out."""
    rows = cleaned(obs)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(noon_day(F.col("ts")).alias("d"), *keys).agg(F.avg("value").alias("value"))


def wide(daily: DataFrame, key: str, values: list) -> DataFrame:
    """One column for each of ``values`` of ``key``; the list is given, so no job looks for it."""
    return daily.groupBy("d").pivot(key, values).agg(F.first("value", ignorenulls=True))


def _readings(obs: DataFrame, metrics: list[str] | None, sites: list[str] | None) -> DataFrame:
    rows = cleaned(obs).where("metric is not null and site is not null")
    if metrics:
        rows = rows.where(F.col("metric").isin(metrics))
    if sites:
        rows = rows.where(F.col("site").isin(sites))
    return rows


def get_daily(
    obs: DataFrame, agg: str = "mean", metrics: list[str] | None = None, sites: list[str] | None = None, start: str | None = None, end: str | None = None, cutoff: str | None = None, ordered: bool = False
) -> DataFrame:
    """Tidy (date, metric, site, value) by calendar day, or by the reading nearest noon with agg="midday".

    Rows without metric or site are left out. cutoff is the last day of readings (the whole day counts), start and end
    bound the days of the result; ordered sorts by metric, site and date.
    """
    rows = _readings(obs, metrics, sites)
    if cutoff:
        rows = rows.where(F.to_date("ts") <= F.lit(cutoff).cast("date"))
    if agg == "midday":
        out = midday(rows)
    else:
        out = rows.groupBy(F.to_date("ts").alias("date"), "metric", "site").agg(_statistic(agg).alias("value"))
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.orderBy("metric", "site", "date") if ordered else out


def _statistic(name: str) -> Column:
    value = STATISTICS[name]("value")
    return F.coalesce(value, F.lit(0.0)) if name == "sum" else value


def daily_statistics(obs: DataFrame) -> DataFrame:
    """(date, metric, site) with a column for each of STATISTICS, in one aggregation."""
    rows = _readings(obs, None, None)
    return rows.groupBy(F.to_date("ts").alias("date"), "metric", "site").agg(*(_statistic(n).alias(n) for n in STATISTICS))


def series_labels(daily: DataFrame) -> DataFrame:
    """daily with ``series``: its site if there is one metric, else its metric if there is one site, else both."""
    counts = daily.agg(F.countDistinct("metric").alias("_m"), F.countDistinct("site").alias("_s"))
    label = F.when(F.col("_m") == 1, F.col("site")).when(F.col("_s") == 1, F.col("metric")).otherwise(F.concat("metric", F.lit(" \u00b7 "), "site"))
    return daily.crossJoin(F.broadcast(counts)).withColumn("series", label).drop("_m", "_s")  # counts is one row


def with_target(daily: DataFrame, target: DataFrame) -> DataFrame:
    """(date, label, value, ordinal): the target (date, value) first, then each metric and site of daily, by name."""
    labelled = daily.select("date", F.concat("metric", F.lit("|"), "site").alias("label"), "value")
    names = labelled.select("label").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("label")))  # as few as the series shown
    return target.select("date", F.lit("target").alias("label"), "value", F.lit(0).alias("ordinal")).unionByName(labelled.join(names, "label").select("date", "label", "value", "ordinal"))


def midday(obs: DataFrame, order: str = "event_id") -> DataFrame:
    """The reading nearest noon of each noon day, metric and site; the first by ``order`` of equals."""
    rows = obs.select("*", noon_day(F.col("ts")).alias("date"), F.abs(second_of_day(F.col("ts")) - 43200).alias("dist"))
    return rows.groupBy("date", "metric", "site").agg(F.min_by("value", F.struct("dist", order)).alias("value"))


def feature_names(keys: DataFrame, key: str = "col_key", *by: str) -> DataFrame:
    """(by, ordinal, key, feature): clean names, with _1, _2 ... on clashes in the order of the keys.

    The feature dictionary is as small as the number of metrics, so one ordered window numbers it.
    """
    named = keys.select(*by, key).distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).withColumn("name", clean_name(F.col(key)))
    n = F.row_number().over(Window.partitionBy(*by, "name").orderBy("ordinal")) - 1
    return named.withColumn("n", n).select(*by, "ordinal", key, F.when(F.col("n") > 0, F.concat("name", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("name")).alias("feature"))
