"""Forecast weather in chunks: stored JSON responses, a partition each, to daily values by lead.

A chunk is a span of days; its response is a file ``<first>_<last>.json`` that a download has left in a folder. The data
source plans one partition for each chunk and hands on the response's text; its parallel arrays are zipped and exploded
by Spark. So many sites and years are many small tasks, and a chunk that isn't there is a row without a text, not an error.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.weather import MAX_LEAD, hourly_to_daily
from .cache import cached
from .readers import once

# The variables of a response, each once for every lead day, and the columns they become.
VARIABLES = {"temp": "temperature_2m", "rain": "rain", "snow": "snowfall", "wind": "wind_speed_10m"}
BODIES = "first date, last date, body string"
DAILY = "date date, lead_day int, t_mean double, t_min double, rain double, snow double, wind double"


def bounds(start: dt.date, end: dt.date, months: int = 3) -> list[tuple[dt.date, dt.date]]:
    """First and last days of the chunks of ``months`` months that make up start to end, both inclusive.

    Chunks begin at start, whatever its day of the month, and lie side by side; a day that a month doesn't have is its last.
    """
    firsts, k = [], 0
    while (first := _months_on(start, k * months)) <= end:
        firsts.append(first)
        k += 1
    return [(a, min(b - dt.timedelta(days=1), end)) for a, b in zip(firsts, [*firsts[1:], end + dt.timedelta(days=1)])]


def _months_on(day: dt.date, months: int) -> dt.date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


class Chunk(InputPartition):
    def __init__(self, first: dt.date, last: dt.date, path: str):
        super().__init__((first, last))
        self.first, self.last, self.path = first, last, path


class ChunkSource(DataSource):
    """Options: path (a folder on any file system that Arrow knows), start, end (ISO days), months."""

    @classmethod
    def name(cls) -> str:
        return "weather_chunks"

    def schema(self) -> str:
        return BODIES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.spans = bounds(dt.date.fromisoformat(options["start"]), dt.date.fromisoformat(options["end"]), int(options.get("months", 3)))

    def partitions(self) -> list[Chunk]:
        return [Chunk(a, b, f"{self.path}/{a}_{b}.json") for a, b in self.spans]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path if ":" in partition.path else f"file://{partition.path}")
        body = None
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as f:
                body = f.read().decode()
        yield partition.first, partition.last, body


def responses(spark: SparkSession, path: str, start: str, end: str, months: int = 3) -> DataFrame:
    """(first, last, body) for each chunk from start to end; body is null where there is no response."""
    spark.dataSource.register(ChunkSource)
    return spark.read.format("weather_chunks").options(path=path, start=start, end=end, months=str(months)).load()


def _key(variable: str, lead: int) -> str:
    return f"{variable}_previous_day{lead}"


def hours(bodies: DataFrame) -> DataFrame:
    """(ts, lead_day, temp, rain, snow, wind, first) of the responses (first, body): arrays zipped, one row an hour and lead.

    A variable that a response lacks, or that ends early, is null there; a text that is no response gives no rows.
    """
    keys = [_key(v, k) for k in range(1, MAX_LEAD + 1) for v in VARIABLES.values()]
    schema = "hourly struct<time: array<string>, " + ", ".join(f"{k}: array<double>" for k in keys) + ">"
    parsed = bodies.where("body is not null").select("first", F.from_json("body", schema).alias("r")).where("r.hourly.time is not null")

    def at(lead: int) -> Column:
        found = [F.get(F.col(f"r.hourly.{_key(v, lead)}"), F.col("_i")).alias(c) for c, v in VARIABLES.items()]
        return F.struct(F.lit(lead).alias("lead_day"), *found)

    each = parsed.select("first", "r", F.posexplode("r.hourly.time").alias("_i", "_t"))
    rows = each.select("first", F.try_to_timestamp("_t").alias("ts"), F.inline(F.array(*(at(k) for k in range(1, MAX_LEAD + 1)))))
    return rows.where("ts is not null").select("ts", "lead_day", *VARIABLES, "first")


def daily_by_lead(bodies: DataFrame) -> DataFrame:
    """(date, lead_day, t_mean, t_min, rain, snow, wind) of the responses; hours that two chunks hold count once, as the later has them."""
    return hourly_to_daily(once(hours(bodies), "first"))


def forecast_weather(spark: SparkSession, path: str, start: str, end: str, months: int = 3, keep: str | None = None) -> DataFrame | None:
    """Daily forecast weather by lead from the responses in a folder, kept at ``keep`` where that is given.

    None if no chunk is there, so that callers fall back to observed weather.
    """

    def build() -> DataFrame | None:
        bodies = responses(spark, path, start, end, months)
        return daily_by_lead(bodies) if bodies.where("body is not null").limit(1).count() else None

    return cached(spark, keep, DAILY, build) if keep else build()
