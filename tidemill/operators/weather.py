"""Weather: hourly forecasts to days, forecast over actual by lead, three-day means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import weather_terms

MAX_LEAD = 7


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """(date, lead_day) of hourly rows (ts, lead_day, temp, rain, snow, wind): mean, min, sums (0 if none), max."""
    zero = F.lit(0.0)
    return hourly.groupBy(F.to_date("ts").alias("date"), "lead_day").agg(
        F.avg("temp").alias("t_mean"), F.min("temp").alias("t_min"), F.coalesce(F.sum("rain"), zero).alias("rain"),
        F.coalesce(F.sum("snow"), zero).alias("snow"), F.max("wind").alias("wind"),
    )


def lead_wide(forecast: DataFrame, value: str) -> DataFrame:
    return forecast.groupBy("date").pivot("lead_day", list(range(1, MAX_LEAD + 1))).agg(F.first(value)).withColumnsRenamed({str(k): f"{value}_L{k}" for k in range(1, MAX_LEAD + 1)})


def forecast_wide(forecast: DataFrame, **thresholds: float) -> DataFrame:
    """(date, wx_..._L1 .. wx_..._L7): the derived weather terms of forecasts (date, lead_day, t_mean, t_min, rain, snow, wind) by lead."""
    terms = weather_terms(*(F.col(c) for c in ("t_mean", "t_min", "rain", "snow", "wind")), **thresholds)
    rows = forecast.select("date", "lead_day", *terms)
    names = [c for c in rows.columns if c.startswith("wx_")]
    at = lambda c, k: F.max(F.when(F.col("lead_day") == k, F.col(c))).alias(f"{c}_L{k}")
    return rows.groupBy("date").agg(*(at(c, k) for c in names for k in range(1, MAX_LEAD + 1)))


def joined(features: DataFrame, weather: DataFrame, day: str = "d") -> DataFrame:
    """features with the weather (date, ...) of their day; days without weather keep nulls."""
    return features.join(weather.withColumnRenamed("date", day), day, "left")


def at_offset(origins: DataFrame, actual: DataFrame, forecast: DataFrame | None, value: str, offset: int = 0, name: str = "wx") -> DataFrame:
    """origins (d, h, ...) with the weather of day d + h - offset: the forecast of lead min(h - offset, 7), else the actual."""
    rows = origins.withColumn("_day", F.expr(f"date_add(d, h - {offset})")).withColumn("_lead", F.least(F.col("h") - offset, F.lit(MAX_LEAD)))
    rows = rows.join(actual.select(F.col("date").alias("_day"), F.col(value).alias("_actual")), "_day", "left")
    if forecast is None:
        return rows.withColumn(name, F.col("_actual")).drop("_day", "_lead", "_actual")
    f = forecast.select(F.col("date").alias("_day"), F.col("lead_day").alias("_lead"), F.col(value).alias("_forecast"))
    return rows.join(f, ["_day", "_lead"], "left").withColumn(name, F.coalesce("_forecast", "_actual")).drop("_day", "_lead", "_actual", "_forecast")


def mean3(origins: DataFrame, actual: DataFrame, forecast: DataFrame | None, value: str) -> DataFrame:
    """The mean of the weather at offsets 0, 1 and 2 that is there; null if none is."""
    rows = origins
    for k in range(3):
        rows = at_offset(rows, actual, forecast, value, k, f"_o{k}")
    total = sum((F.coalesce(f"_o{k}", F.lit(0.0)) for k in range(3)), F.lit(0.0))
    n = sum((F.col(f"_o{k}").isNotNull().cast("int") for k in range(3)), F.lit(0))
    return rows.withColumn("wx_mean3", F.when(n > 0, total / n)).drop("_o0", "_o1", "_o2")


def by_horizon(days: DataFrame, actual: DataFrame, forecast: DataFrame | None, names: list[str], smooth: list[str] = (), horizon: int = 10) -> DataFrame:
    """(d, wx array<array<double>>): what is known on each day d (column d of days) of the weather of d + 1 .. d + horizon.

    Element h - 1 has the columns ``names`` of day d + h, then the means of ``smooth`` over that day and the two before.
    A day after d is the forecast of lead min(days ahead, 7) where there is one, else the actual; d and earlier days are
    actual. actual (date, names ...), forecast (date, lead_day, names ...); a mean leaves missing days out.
    """
    values = lambda: F.array(*(F.col(c).cast("double") for c in names))
    asked = days.select("d").distinct().withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(horizon)))).withColumn("date", F.expr("date_add(d, k)"))
    rows = asked.join(actual.select("date", values().alias("_a")), "date", "left").withColumn("lead_day", F.least("k", F.lit(MAX_LEAD)))
    if forecast is None:
        rows = rows.withColumn("_v", F.col("_a"))
    else:
        rows = rows.join(forecast.select("date", "lead_day", values().alias("_f")), ["date", "lead_day"], "left")
        rows = rows.withColumn("_v", F.array(*(F.coalesce(F.when(F.col("k") > 0, F.col("_f")[i]), F.col("_a")[i]) for i in range(len(names)))))
    known = rows.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("k", "_v"))).alias("at"))

    def mean(h: int, i: int) -> Column:
        three = [F.col("at")[F.lit(h - j)][i] for j in range(3)]
        n = sum((x.isNotNull().cast("int") for x in three), F.lit(0))
        return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in three), F.lit(0.0)) / n)

    place = [names.index(c) for c in smooth]
    each = [F.array(*(F.col("at")[F.lit(h)][i] for i in range(len(names))), *(mean(h, i) for i in place)) for h in range(1, horizon + 1)]
    return known.select("d", F.array(*each).alias("wx"))
