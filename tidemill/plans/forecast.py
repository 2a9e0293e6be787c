"""End-to-end plans: feature matrices, naive forecasts, selection, global predictions, the ensemble, the holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastConfig
from ..functions.scalars import dot, fourier, known_transform, weekday_dummies
from ..operators import evaluate
from ..operators import features as ft
from ..operators import models
from ..operators import weather as wx
from ..operators.kalman import imputed

CALENDAR = [*(f"dow_{i}" for i in range(6)), "sin_1", "cos_1", "sin_2", "cos_2"]
HOLIDAYS = ["is_holiday", "is_day_after_holiday"]
OWN = ["y0", "mean7", "sd7", "lag3", "mean7_3"]
NAMES = [*OWN, *CALENDAR]


WEATHER = ["wx_coldness", "wx_hotness", "wx_coldness2", "wx_below_freezing", "wx_rain_sum", "wx_heavy_rain", "wx_snowfall_sum", "wx_wind_max"]
#: Weather whose mean over the target's day and the two before is a column as well.
SMOOTH = ["wx_coldness", "wx_hotness", "wx_coldness2"]
WEATHER_NAMES = [*WEATHER, *(f"{c}_mean3" for c in SMOOTH)]


def matrix(days: DataFrame, lag: int = 0, ahead: int = 0) -> DataFrame:
    """(series, d, row_idx, y, op, cal) from days (series, d, y): own history and calendar, complete rows only.

    lag: rows whose target isn't reported yet at a row. Own columns then end so many rows before, so days whose y is
    null still make rows. ahead: so many days to come follow each series, with a calendar and nothing else.
    """
    rows = ft.rolling(ft.with_row_index(days, "series"), "y", "series")
    order = Window.partitionBy("series").orderBy("row_idx")
    ends = {"y": lag, "mean7": lag, "sd7": lag, "lag3": lag - 3, "mean7_3": lag - 3}  # the last two end 3 rows before by themselves
    own = [(F.lag(c, n).over(order) if n > 0 else F.col(c)).alias(name) for name, (c, n) in zip(OWN, ends.items())]
    rows = rows.select("series", "d", "y", *own).where(" and ".join(f"{c} is not null" for c in OWN)).select("series", "d", "y", F.array(*OWN).alias("op"))
    return _with_calendar(rows, [*weekday_dummies(F.col("d")), *fourier(F.col("d"))], ahead)


def _with_calendar(rows: DataFrame, cal: list, ahead: int) -> DataFrame:
    rows = ft.with_future(rows, ahead, "series") if ahead else rows
    known = [c for c in models.KNOWN if c in rows.columns]
    return ft.with_row_index(rows.select("series", "d", "y", "op", F.array(*cal).alias("cal"), *known), "series")


def with_weather(m: DataFrame, actual: DataFrame, forecast: DataFrame | None, names: list[str] | None = None, smooth: list[str] | None = None, horizon: int = 10) -> DataFrame:
    """The matrix m with ``wx``, the weather of each horizon as its rows know it (``weather.by_horizon``)."""
    known = wx.by_horizon(m, actual, forecast, WEATHER if names is None else names, SMOOTH if smooth is None else smooth, horizon)
    return m.join(known, "d", "left")


def wide_features(daily: DataFrame, target: DataFrame, dictionary: DataFrame, kalman: bool = False, as_known: bool = False) -> DataFrame:
    """(series, d, ordinal, value, y): every predictor of every day with a target, in long form, skew-corrected.

    daily (series, d, col_key, value) and target (series, d, y) by noon day; dictionary of ``ft.predictors``. Days are
    those of the features; missing values are filled by position before days without a target go, rolling terms come
    after that; days that lack a predictor go. kalman: as the original baseline does it, filled by the smoother of a
    state-space model, and with the sample's skewness. as_known: nothing rests on later rows; gaps take the last value
    before, values aren't corrected, and skew and low, the statistics of the rows up to each, stand beside them.
    """
    days = daily.select("series", "d").distinct().join(target, ["series", "d"], "left")
    base = dictionary.where("kind = 'op' and variant = 'value'").select("series", "col_key", F.col("ordinal").alias("base"))
    # The grid of days and features is the table that models read; it is as large as they need and no larger.
    grid = days.join(base, "series").join(daily, ["series", "d", "col_key"], "left")
    fill = imputed if kalman else ft.carried if as_known else ft.interpolated
    grid = fill(ft.with_row_index(grid, "series", "base"), "value", "series", "base").where("y is not null")
    grid = ft.rolling(ft.with_row_index(grid, "series", "base"), "value", "series", "base").select("series", "d", "base", "value", F.col("mean7").alias("roll_mean7"), F.col("sd7").alias("roll_sd7"))
    own = ft.rolling(ft.with_row_index(days.where("y is not null"), "series"), "y", "series").select("series", "d", "lag3", "mean7_3")
    stacked = grid.select("series", "d", F.col("base"), F.expr("stack(3, 'value', value, 'roll_mean7', roll_mean7, 'roll_sd7', roll_sd7) as (variant, value)"))
    stacked = stacked.unionByName(own.select("series", "d", F.lit(-1).alias("base"), F.expr("stack(2, 'lag3', lag3, 'mean7_3', mean7_3) as (variant, value)")))
    rows = stacked.join(dictionary.where("kind = 'op'").select("series", "base", "variant", "ordinal"), ["series", "base", "variant"])
    whole = ft.complete_days(rows.select("series", "d", "ordinal", "value"), "series")
    if as_known:
        known = ft.so_far(whole, "value", "series", "ordinal", order="d")
        return known.join(target, ["series", "d"]).select("series", "d", "ordinal", "value", *models.KNOWN, "y")
    corrected = ft.skew_corrected(whole, "series", "ordinal", sample=kalman)
    return corrected.join(target, ["series", "d"]).select("series", "d", "ordinal", "value", "y")


def wide_matrix(daily: DataFrame, target: DataFrame, dictionary: DataFrame, weather: DataFrame | None = None, holidays: list | None = None, ahead: int = 0, as_known: bool = False) -> DataFrame:
    """(series, d, row_idx, y, op, cal): the predictors of wide_features as vectors, and the calendar.

    weather (d, wx_...) and holidays add columns to the calendar; where they aren't given (the models without weather),
    it is weekday and season alone. Missing weather is 0, as missing values are in the fits. Weather put here counts as
    known in advance; ``with_weather`` adds what a row knows of it. ahead: days to come, see ``matrix``. as_known: with
    the columns skew and low, by which models transform op as each origin, window or training span knows it; rows and
    forecasts then stay the same when rows are added, for the same dictionary.
    """
    op = ft.as_vectors(wide_features(daily, target, dictionary, as_known=as_known), "series", "y", others=models.KNOWN if as_known else ())
    cal = [*weekday_dummies(F.col("d")), *fourier(F.col("d"))]
    if holidays is not None:
        days = [F.lit(x).cast("date") for x in holidays]
        cal += [F.col("d").isin(*days).cast("double"), F.date_sub("d", 1).isin(*days).cast("double")]
    op = op.withColumnRenamed("features", "op")
    if weather is None:
        return _with_calendar(op, cal, ahead)
    names = [c for c in weather.columns if c.startswith("wx_")]
    rows = ft.with_future(op, ahead, "series") if ahead else op
    return _with_calendar(rows.join(weather, "d", "left"), cal + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names], 0)


def same_day_baseline(daily: DataFrame, target: DataFrame, dictionary: DataFrame, cfg: ForecastConfig, **options) -> DataFrame:
    """Detail of the original baseline (``models.same_day_forecast``): features, their rolling terms and lag 3 of the target, no calendar."""
    own = dictionary.where("variant <> 'mean7_3'")
    return models.same_day_forecast(ft.as_vectors(wide_features(daily, target, own, kalman=True), "series", "y").withColumnRenamed("features", "op"), cfg, **options)


def naive(days: DataFrame, cfg: ForecastConfig, season: int | None = None) -> DataFrame:
    """Forecast detail of the last value, or of the value ``season`` rows before the target."""
    rows = ft.with_row_index(days, "series")
    ahead = ft.targets_ahead(rows, "y", "series", horizon=cfg.horizon)
    value = F.col("y")
    if season is not None:
        back = rows.select("series", F.col("row_idx").alias("src"), F.col("y").alias("_v"))
        src = F.col("row_idx") + F.col("h") - season * F.ceil(F.col("h") / season)
        ahead = ahead.withColumn("src", src.cast("int")).join(back, ["series", "src"], "left")
        value = F.col("_v")
    return ahead.select("series", F.col("d").alias("origin_date"), F.col("h").alias("horizon"), F.col("target_date").alias("forecast_date"), F.col("target").alias("actual"), value.alias("predicted"))


def model_inputs(m: DataFrame, horizon: int = 10) -> DataFrame:
    """(series, origin_date, horizon, forecast_date, actual, op, later): op of the origin, and what it knows of the target:
    the target's calendar and the weather of the horizon. Days to come are targets without an actual, and no origins."""
    ahead = ft.targets_ahead(m, "y", "series", horizon=horizon, others=("cal",)).where("op is not null")
    later = F.col("target_cal")
    if "wx" in m.columns:
        later = F.concat(later, F.transform(F.col("wx")[F.col("h") - 1], lambda x: F.coalesce(x, F.lit(0.0))))
    return ahead.select("series", F.col("d").alias("origin_date"), F.col("h").alias("horizon"), F.col("target_date").alias("forecast_date"), F.col("target").alias("actual"), "op", later.alias("later"))


def global_forecast(m: DataFrame, fitted: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Forecast detail of global models: penalised columns at the origin, calendar columns at the target."""
    # A model is one row for each series and horizon.
    known = [c for c in models.KNOWN if c in fitted.columns]
    rows = model_inputs(m, cfg.horizon).join(fitted.select("series", "horizon", "coef", "intercept", *known), ["series", "horizon"])
    rows = rows.withColumn("op", known_transform(F.col("op"), *map(F.col, known))) if known else rows
    x = F.concat("op", "later")
    return rows.select("series", "origin_date", "horizon", "forecast_date", "actual", dot(x, F.col("coef"), F.col("intercept")).alias("predicted"))


def forecast(m: DataFrame, cfg: ForecastConfig, until: str | None = None, rolling_matrix: DataFrame | None = None, **options) -> DataFrame:
    """The ensemble's forecast detail for a matrix; global models see rows to ``until``.

    rolling_matrix: the rolling model's own columns (those of a second selection), if they differ.
    """
    rolling = models.rolling_forecast(m if rolling_matrix is None else rolling_matrix, cfg, **options)
    return models.ensemble(rolling, global_forecast(m, models.global_models(m, cfg, until), cfg), cfg)


def numbered_forecast(m: DataFrame, cfg: ForecastConfig, until: str | None = None, rolling_matrix: DataFrame | None = None) -> DataFrame:
    """``forecast`` with forecast_id; the origins come from the matrix, so every model is fitted once."""
    return evaluate.forecast_ids(forecast(m, cfg, until, rolling_matrix), models.origins(m, cfg))


def future(m: DataFrame, cfg: ForecastConfig, **options) -> DataFrame:
    """The ensemble's forecasts of days not seen yet: detail without an actual, from a matrix with days to come.

    Origins are the last rows of each series, as many as have a day to come within the horizon.
    """
    last = F.max(F.when(F.col("op").isNotNull(), F.col("row_idx"))).over(Window.partitionBy("series"))
    back = last - F.col("row_idx")
    marked = m.withColumn("origin", F.col("op").isNotNull() & (back < cfg.horizon)).withColumn("_back", back)
    # Each origin's own window and floor, and no row before them.
    recent = marked.where(F.col("_back") < cfg.horizon + max(cfg.train_window, cfg.floor_lookback + max(3, cfg.label_lag))).drop("_back")
    rolling = models.rolling_forecast(recent, cfg, **options)
    found = models.ensemble(rolling, global_forecast(m, models.global_models(m, cfg), cfg), cfg)
    return found.where("actual is null")


def selected_forecast(m: DataFrame, dictionary: DataFrame, names: list[str], cfg: ForecastConfig, until: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forecast detail with forecast_id, selection summary): selection to ``until`` for the global models, to ``end`` for the rolling one.

    Without ``until`` both use one selection; without ``end`` the rolling model's sees all rows. The windows of the first
    are windows of the second as well, so one ledger serves both and no window is fitted twice; it stays cached, a row
    for each window and predictor. ``mean7_3`` always joins.
    """
    rows = m if end is None else m.where(F.col("d") <= F.lit(end).cast("date"))
    ledger = models.selection_ledger(rows, names, cfg).persist()

    def select(last: str | None) -> DataFrame:
        return models.seed_and_expand(models.ledger_counts(ledger, last), dictionary, cfg, ("mean7_3",))

    early = select(until)
    one, _ = models.chosen(m, early)
    two = one if until is None else models.chosen(m, select(None))[0]
    return numbered_forecast(one, cfg, until, two), early


def holdout(m: DataFrame, cfg: ForecastConfig, until: str) -> DataFrame:
    """Error bands of global models refitted to rows up to ``until``, on the origins after it."""
    fitted = models.global_models(m, cfg, until)
    held = F.lit(until).cast("date")
    detail = global_forecast(m, fitted, cfg).where(F.col("origin_date") > held)
    floors = ft.trailing_floor(m, "y", "series", lookback=cfg.floor_lookback, q=cfg.floor_quantile).select("series", F.col("d").alias("origin_date"), "floor")
    ahead = m.withColumn("_n", F.max("row_idx").over(Window.partitionBy("series"))).where((F.col("d") > held) & (F.col("row_idx") < F.col("_n")) & F.col("op").isNotNull())
    origins = ahead.select(F.col("d").alias("origin_date"))
    return evaluate.mse_bands(evaluate.forecast_ids(models.clipped(detail.join(floors, ["series", "origin_date"]), cfg), origins), "series")
