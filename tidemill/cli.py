"""Forecasts from files: python -m tidemill.cli INPUT OUTPUT TARGET [--no-wx] [--partial] [--ead-smooth] [--as-known] [--until DAY] [--end DAY] [--origins FIRST LAST] [--weather FILE] [--forecasts FOLDER FIRST LAST] [--holidays DAY,DAY] [--selection FILE] [WINDOW ...]

INPUT is observations in CSV or Parquet, TARGET the metric to forecast. Writes the ensemble with its selection, its
forecasts of the days after the last one, and the rolling model for each window, and prints their errors. --until holds
the global model's training and selection to days up to DAY, so that the days after it are a holdout; --end holds the
rolling model's selection to DAY; --origins bounds the origins. --weather is observed daily weather, --forecasts a folder
of forecast responses by chunk: each origin sees the forecast of its target's day where there is one, observed weather
only elsewhere. --no-wx leaves weather and holidays out; --partial leaves the rolling model's calendar unpenalised;
--ead-smooth adds the smoothed target to its columns; --selection takes a summary written before instead of selecting.
--as-known fills gaps and corrects skewness by what each origin knows, instead of by all rows.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ForecastConfig
from .functions.scalars import weather_terms
from .operators import daily, evaluate, features, models
from .plans import forecast as plan
from .sources import readers, responses, writers


def options(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemill")
    for flag in ("--no-wx", "--partial", "--ead-smooth", "--as-known"):
        parser.add_argument(flag, action="store_true")
    for name in ("--until", "--end", "--weather", "--selection"):
        parser.add_argument(name)
    parser.add_argument("--origins", nargs=2, metavar=("FIRST", "LAST"))
    parser.add_argument("--forecasts", nargs=3, metavar=("FOLDER", "FIRST", "LAST"))
    parser.add_argument("--holidays", type=lambda days: [d for d in days.split(",") if d], default=[])
    parser.add_argument("windows", nargs="*", type=int)
    return parser.parse_args(args)


def inputs(spark: SparkSession, path: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(daily features by metric and site, target) by noon day, as one series."""
    obs = readers.observations(spark, path)
    rows = daily.by_noon_day(obs.where(F.col("metric") != target), "metric", "site")
    rows = rows.select(F.lit("all").alias("series"), "d", F.concat("metric", F.lit("|"), "site").alias("col_key"), "value")
    y = daily.by_noon_day(obs.where(F.col("metric") == target)).select(F.lit("all").alias("series"), "d", F.col("value").alias("y"))
    return rows, y


def known_weather(spark: SparkSession, m: DataFrame, chosen: argparse.Namespace, cfg: ForecastConfig) -> DataFrame:
    """The matrix with the weather of each horizon, from observed days and stored forecasts."""
    names = ("t_mean", "t_min", "rain", "snow", "wind")
    observed = readers.weather(spark, chosen.weather).toDF("date", *names)
    ahead = responses.forecast_weather(spark, *chosen.forecasts) if chosen.forecasts else None
    terms = weather_terms(*(F.col(c) for c in names))
    # A day without a mean temperature has no forecast, so it falls back as a whole.
    ahead = None if ahead is None else ahead.where("t_mean is not null").select("date", "lead_day", *terms)
    return plan.with_weather(m, observed.select("date", *terms), ahead, horizon=cfg.horizon)


def run(spark: SparkSession, path: str, out: str, target: str, chosen: argparse.Namespace, cfg: ForecastConfig | None = None) -> None:
    cfg = cfg or ForecastConfig()
    if chosen.origins:
        cfg = cfg.with_(origin_start=chosen.origins[0], origin_end=chosen.origins[1])
    work = f"{out.rstrip('/')}/_work-{uuid.uuid4().hex}"

    def once(df: DataFrame, name: str) -> DataFrame:
        """df written beside the results and read again: worked out once, with a short plan for what is built on it."""
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        _run(spark, path, out, target, chosen, cfg, once)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(work)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _run(spark: SparkSession, path: str, out: str, target: str, chosen: argparse.Namespace, cfg: ForecastConfig, once: Callable[[DataFrame, str], DataFrame]) -> None:
    rows, y = inputs(spark, path, target)
    calendar = list(plan.CALENDAR) if chosen.no_wx else [*plan.CALENDAR, *plan.HOLIDAYS]
    dictionary = once(features.predictors(daily.feature_names(rows, "col_key", "series"), calendar), "dictionary")
    m = once(plan.wide_matrix(rows, y, dictionary, None, None if chosen.no_wx else chosen.holidays, ahead=cfg.horizon, as_known=chosen.as_known), "rows")
    weathered = bool(chosen.weather) and not chosen.no_wx
    m = once(known_weather(spark, m, chosen, cfg), "matrix") if weathered else m
    names = [r.predictor for r in dictionary.orderBy(F.desc("penalised"), "ordinal").select("predictor").collect()]
    later = [*calendar, *(plan.WEATHER_NAMES if weathered else [])]
    if chosen.selection:
        selection = once(readers.selected_features(spark, chosen.selection, dictionary), "selection")
        detail = once(plan.numbered_forecast(models.chosen(m, selection)[0], cfg, chosen.until), "detail")
    else:
        found, selection = plan.selected_forecast(m, dictionary, names, cfg, chosen.until, chosen.end)
        detail, selection = once(found, "detail"), once(selection, "selection")
    name = writers.model_name("ensemble", weather=not chosen.no_wx)
    past = detail.where("actual is not null")
    writers.write_forecast(past, f"{out}/{name}")
    writers.write(detail.where("actual is null").drop("coef", "floor", "alpha"), f"{out}/{name}/future")
    writers.write_selection(selection, f"{out}/{name}/selection")
    print(name, writers.summary(evaluate.mse_bands(past if chosen.until is None else evaluate.since(past, chosen.until, False))), sep="\n")
    own, kept = models.chosen(m, selection)
    if chosen.ead_smooth and "mean7_3" not in kept:
        smooth = names.index("mean7_3")
        parts = [c for c in ("op", *models.KNOWN) if c in m.columns]
        own = own.join(m.select("series", "d", *(F.col(c)[smooth].alias(f"_{c}") for c in parts)), ["series", "d"])
        own = own.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(c, F.array(f"_{c}"))) for c in parts}).drop(*(f"_{c}" for c in parts))
        kept = [*kept, "mean7_3"]
    if chosen.windows:
        sweep = once(models.window_sweep(own, cfg, chosen.windows, partial=chosen.partial), "sweep")
    for window in chosen.windows:
        one = sweep.where((F.col("train_win") == window) & F.col("actual").isNotNull())
        one = evaluate.forecast_ids(one)
        name = writers.model_name("partial" if chosen.partial else "basic", window, not chosen.no_wx, chosen.ead_smooth)
        writers.write_forecast(one, f"{out}/{name}", names=[*kept, *later])
        print(name, writers.summary(evaluate.mse_bands(one)), sep="\n")


if __name__ == "__main__":
    session = SparkSession.builder.appName("tidemill").getOrCreate()
    run(session, sys.argv[1], sys.argv[2], sys.argv[3], options(sys.argv[4:]))
