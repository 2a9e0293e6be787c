"""Inputs: observations in long form, weather, forecast detail, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import no_nan, valid
from ..operators.weather import hourly_to_daily

OBSERVATIONS = "dt string, metric_name string, coverage string, value double, coverage_label string, variable_type string"
DETAIL = "forecast_id int, origin_date date, horizon int, forecast_date date, actual double, predicted double"
SELECTION = "predictor string, metric_name string, n_selected long, total_slots long, pct_selected double, seed boolean, expanded boolean, forced boolean, in_model boolean"
COEFFICIENTS = "series string, train_win int, origin_date date, horizon int, predictor string, coefficient double"
ERRORS = "forecast_id int, origin_date date, mse_1_5 double, mse_6_10 double"
HOURLY = "ts timestamp, lead_day int, temp double, rain double, snow double, wind double"
WEATHER = "date date, temperature_2m_mean double, temperature_2m_min double, rain_sum double, snowfall_sum double, wind_speed_10m_max double"


def _read(spark: SparkSession, path: str, schema: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns of schema, found by their names whatever the order in the file, and cast; others are left out.

    A value that doesn't fit its type is null. A column that isn't there raises unless it is optional, which makes it null.
    """
    plain = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") or not _is_csv(spark, path) else spark.read.option("header", True).csv(path)
    wanted = [c.split() for c in schema.split(", ")]
    if missing := [n for n, _ in wanted if n not in plain.columns and n not in optional]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(plain.columns)}")
    return plain.select(*((F.col(f"`{n}`").try_cast(t) if n in plain.columns else F.lit(None).cast(t)).alias(n) for n, t in wanted))


def _is_csv(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the files of a folder that Spark wrote, are CSV by their names."""
    if path.rstrip("/").endswith(".csv"):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
            return True
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return not any(n.endswith(".parquet") for n in names)


# Ways in which times come; a date whose first part can be a month is read month first.
TIME_FORMATS = ["M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d MMM yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy", "d-M-yyyy H:m:s", "d-M-yyyy H:m", "yyyy/M/d H:m:s", "yyyy/M/d H:m"]


def mixed_time(text: Column, day_first: bool = False) -> Column:
    """A timestamp from text in any of several formats, ISO first; null if none fits."""
    formats = sorted(TIME_FORMATS, key=lambda f: f.startswith("M/")) if day_first else TIME_FORMATS
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def observations(spark: SparkSession, path: str, until: str | None = None, until_is_date: bool = False, day_first: bool = False) -> DataFrame:
    """(ts, date, metric, site, value): the sentinel dropped, NaN made null, times of mixed formats, unreadable ones null.

    until cuts at a timestamp, or keeps the whole of that day with until_is_date.
    """
    rows = _read(spark, path, OBSERVATIONS).where(valid(F.col("value")))
    rows = rows.select(mixed_time(F.col("dt"), day_first).alias("ts"), F.col("metric_name").alias("metric"), F.col("coverage").alias("site"), no_nan(F.col("value")).alias("value"))
    rows = rows.select("ts", F.to_date("ts").alias("date"), "metric", "site", "value")
    if until is not None:
        rows = rows.where((F.col("date") if until_is_date else F.col("ts")) <= F.lit(until).cast("date" if until_is_date else "timestamp"))
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def other_errors(spark: SparkSession, path: str) -> DataFrame | None:
    """Error bands that another model has written, or None where there are none."""
    return _read(spark, path, ERRORS) if exists(spark, path) else None


def chunk_bounds(spark: SparkSession, start: str, end: str, months: int = 3) -> DataFrame:
    """(first, last) of the chunks of ``months`` months from start that make up start to end, both inclusive."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {months} months)")).alias("first"))
    last = F.date_sub(F.add_months("first", months), 1)
    return one.select("first", F.least(last, F.lit(end).cast("date")).alias("last"))


def forecast_weather(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Daily forecast weather by lead from hourly files, a file or folder for each chunk; None if none is there.

    A file has (ts, lead_day, temp, rain, snow, wind); hours that two chunks hold count once, as the later path has
    them; rain and snow that are missing count as 0.
    """
    found = [_read(spark, p, HOURLY, ("rain", "snow", "wind")).withColumn("chunk", F.lit(i)) for i, p in enumerate(paths) if exists(spark, p)]
    return hourly_to_daily(once(reduce(DataFrame.unionByName, found), "chunk")) if found else None


def once(hours: DataFrame, chunk: str) -> DataFrame:
    """Hours by time and lead, each as its last chunk has it."""
    value = F.max_by(F.struct("temp", "rain", "snow", "wind"), chunk).alias("v")
    return hours.groupBy("ts", "lead_day").agg(value).select("ts", "lead_day", "v.*")


def weather(spark: SparkSession, path: str) -> DataFrame:
    """Observed daily weather; a file with other columns than the six is refused (``cache.cached`` rebuilds such a one)."""
    names = [c.split()[0] for c in WEATHER.split(", ")]
    found = spark.read.option("header", True).csv(path).columns if _is_csv(spark, path) else spark.read.parquet(path).columns
    if set(found) != set(names):
        raise ValueError(f"weather columns are {found}, not {names}")
    return _read(spark, path, WEATHER)


def forecast_detail(spark: SparkSession, path: str) -> DataFrame:
    """Forecast detail that ``writers.write_forecast`` or another model has written."""
    return _read(spark, path, DETAIL)


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """Weights that ``writers.write_forecast`` has written."""
    return _read(spark, path, COEFFICIENTS, ("series", "train_win"))


def selection(spark: SparkSession, path: str) -> DataFrame:
    """A selection summary; one without seeds and expansion has nulls there."""
    return _read(spark, path, SELECTION, ("seed", "expanded"))


def selected_features(spark: SparkSession, path: str, dictionary: DataFrame) -> DataFrame:
    """A written selection as ``models.chosen`` takes it: each predictor of dictionary (``features.predictors``) with its
    ordinal, counts and flags; predictors that the dictionary doesn't know are left out, those it adds are not in the model."""
    if "predictor" not in dictionary.columns:
        raise ValueError("the dictionary of predictors is needed, rolling terms and lags included, not that of features")
    rows = selection(spark, path).drop("metric_name", "forced")
    found = dictionary.withColumn("forced", F.col("kind") != "op").join(rows, "predictor", "left")
    return found.withColumn("in_model", F.coalesce("in_model", F.col("forced"))).withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as observations; some readings are missing or carry the sentinel, by id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 89 == 0, F.lit(-9999.0)).otherwise(F.col("value"))
    return e.select("event_id", "ts", F.col("event_type").alias("metric"), F.concat(F.lit("site_"), (F.col("user_id") % 3).cast("string")).alias("site"), value.alias("value"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, d, y): mean order value by day, one series; a day without orders has no row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg((F.avg("o_totalprice") / 100000).alias("y")).select(F.lit("orders").alias("series"), "d", "y")


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, d, metric, site, value): order values by priority and market segment, as many metrics of several sites."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(F.lit("orders").alias("series"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("metric"), F.col("c_mktsegment").alias("site"), (F.col("o_totalprice") / 100000).alias("value"))


def priority_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, d, y): mean order value by day, a series for each order priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg((F.avg("o_totalprice") / 100000).alias("y"))
