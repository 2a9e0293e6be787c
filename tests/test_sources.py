"""Readers by name, round trips of what is written, the cache, and weather in chunks."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.config import ForecastConfig
from tidemill.operators import features, models
from tidemill.plans import forecast as plan
from tidemill.sources import cache, readers, responses, writers

WEATHER = {"date": "2024-01-01", "temperature_2m_mean": 1.0, "temperature_2m_min": 2.0, "rain_sum": 3.0, "snowfall_sum": 4.0, "wind_speed_10m_max": 5.0}


@pytest.mark.parametrize("order", [list(WEATHER), list(WEATHER)[::-1], sorted(WEATHER)])
def test_weather_columns_by_name(spark, tmp_path, order):
    (tmp_path / "w.csv").write_text(",".join(order) + "\n" + ",".join(str(WEATHER[c]) for c in order) + "\n")
    r = readers.weather(spark, f"{tmp_path}/w.csv").first()
    assert r.asDict() == WEATHER | {"date": dt.date(2024, 1, 1)}


def test_observations_by_name_and_what_is_missing(spark, tmp_path):
    (tmp_path / "o.csv").write_text("value,more,variable_type,coverage,metric_name,dt,coverage_label\n1.5,x,t,site,m,2024-01-01 10:00:00,l\nbad,x,t,site,m,2024-01-02 10:00:00,l\n-9999,x,t,site,m,2024-01-02,l\n")
    rows = readers.observations(spark, f"{tmp_path}/o.csv").orderBy("ts").collect()
    assert [(r.metric, r.site, r.value, r.date.day) for r in rows] == [("m", "site", 1.5, 1), ("m", "site", None, 2)]
    (tmp_path / "p.csv").write_text("dt,value\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="metric_name"):
        readers.observations(spark, f"{tmp_path}/p.csv")


def small(spark):
    d0 = dt.date(2020, 1, 1)
    y = np.random.default_rng(0).standard_normal(60).tolist()
    return plan.matrix(spark.createDataFrame([("a", d0 + dt.timedelta(days=i), y[i]) for i in range(60)], "series string, d date, y double"), ahead=2)


@pytest.mark.parametrize("csv", [False, True])
def test_what_is_written_reads_back(spark, tmp_path, csv):
    cfg = ForecastConfig(horizon=2, train_window=30, n_alphas=5, rolling_only=1, selection_window=30, stride=10)
    m = small(spark)
    names = [*plan.OWN, *plan.CALENDAR]
    detail = plan.numbered_forecast(m, cfg).persist()
    writers.write_forecast(detail, f"{tmp_path}/f", csv, names)
    got = sorted(map(tuple, readers.forecast_detail(spark, f"{tmp_path}/f/forecast_detail").collect()), key=str)
    want = sorted(map(tuple, detail.select("forecast_id", "origin_date", "horizon", "forecast_date", "actual", "predicted").collect()), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want]) and [r[4] is None for r in got] == [r[4] is None for r in want] and any(r[4] is None for r in got)
    weights = readers.coefficients(spark, f"{tmp_path}/f/coefficients")
    assert weights.count() == models.coefficient_detail(detail, names).count() > 0 and weights.where("predictor is null or coefficient is null").count() == 0
    bands = readers.other_errors(spark, f"{tmp_path}/f/mse_summary")
    assert bands.count() == detail.select("origin_date").distinct().count()
    keys = spark.createDataFrame([("a", i, c, c) for i, c in enumerate(["beds|x", "waits|x"])], "series string, ordinal int, col_key string, feature string")
    dictionary = features.predictors(keys, ["dow_0"])
    counts = dictionary.select("predictor", F.when(F.col("variant") == "roll_mean7", 9).when(F.col("variant") == "value", 6).otherwise(0).cast("long").alias("n_selected"), F.lit(10).cast("long").alias("total_slots"))
    chosen = models.seed_and_expand(counts, dictionary, ForecastConfig(top=2), ("mean7_3",))
    writers.write_selection(chosen, f"{tmp_path}/s", csv)
    back = readers.selection(spark, f"{tmp_path}/s")
    flags = ["predictor", "n_selected", "total_slots", "pct_selected", "seed", "expanded", "forced", "in_model"]
    assert sorted(map(tuple, back.select(*flags).collect())) == sorted(map(tuple, chosen.select(*flags).collect()))
    again = readers.selected_features(spark, f"{tmp_path}/s", dictionary)
    assert {r.predictor for r in again.where("in_model and not forced").collect()} == {r.predictor for r in chosen.where("in_model and not forced").collect()}
    assert "beds|x_roll_mean7" in {r.predictor for r in again.where("in_model").collect()}
    with pytest.raises(ValueError, match="predictors"):
        readers.selected_features(spark, f"{tmp_path}/s", keys)


def test_cache(spark, tmp_path):
    path, built = f"{tmp_path}/kept", []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v"))

        return make

    schema = "k long, v string"
    assert cache.cached(spark, path, schema, lambda: None) is None
    assert cache.cached(spark, path, schema, build(3)).count() == 3 and built == [3]
    assert cache.cached(spark, path, schema, build(4)).count() == 3 and built == [3]
    # A table with other columns is stale: it is rebuilt, or None where that fails.
    wide = "k long, v string, w int"
    assert cache.cached(spark, path, wide, lambda: None) is None and spark.read.parquet(path).count() == 3
    assert cache.cached(spark, path, wide, lambda: spark.range(5).selectExpr("id as k", "'y' as v", "1 as w")).columns == ["k", "v", "w"]
    assert spark.read.parquet(path).count() == 5
    # What a lost run left isn't read.
    half = tmp_path / "half"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"PAR1")
    assert cache.cached(spark, str(half), schema, build(2)).count() == 2 and built == [3, 2]
    with pytest.raises(ValueError, match="built as"):
        cache.cached(spark, f"{tmp_path}/odd", wide, build(1))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["half", "kept"]


def body(first, n_days, value, leads=range(1, 8), short=False):
    times = [f"{first + dt.timedelta(days=i)}T{h:02d}:00" for i in range(n_days) for h in (0, 12)]
    hourly = {"time": times}
    for k in leads:
        hourly[f"temperature_2m_previous_day{k}"] = [value + k + (i % 2) for i in range(len(times) - short)]
        hourly[f"rain_previous_day{k}"] = [None if i % 2 else 1.5 for i in range(len(times))]
        hourly[f"wind_speed_10m_previous_day{k}"] = [float(i) for i in range(len(times))]
    return json.dumps({"hourly": hourly, "latitude": 51.5})


def test_weather_in_chunks(spark, tmp_path):
    day = dt.date
    spans = responses.bounds(day(2023, 11, 15), day(2024, 6, 10), 3)
    assert spans == [(day(2023, 11, 15), day(2024, 2, 14)), (day(2024, 2, 15), day(2024, 5, 14)), (day(2024, 5, 15), day(2024, 6, 10))]
    assert responses.bounds(day(2024, 1, 31), day(2024, 3, 30), 1) == [(day(2024, 1, 31), day(2024, 2, 28)), (day(2024, 2, 29), day(2024, 3, 30))]
    assert responses.bounds(day(2024, 1, 31), day(2024, 1, 31), 1) == [(day(2024, 1, 31), day(2024, 1, 31))]
    folder, ask = f"{tmp_path}/json", ("2023-11-15", "2024-06-10")
    (tmp_path / "json").mkdir()
    assert responses.forecast_weather(spark, folder, *ask) is None
    # The first chunk holds days of the second as well; the second isn't there; the third ends early and has two leads.
    (tmp_path / "json" / "2023-11-15_2024-02-14.json").write_text(body(day(2023, 11, 15), 200, 10.0))
    (tmp_path / "json" / "2024-05-15_2024-06-10.json").write_text(body(day(2024, 5, 15), 27, 50.0, (1, 2), short=True))
    got = responses.responses(spark, folder, *ask)
    assert [(r.first, r.last, r.body is None) for r in got.orderBy("first").collect()] == [(*spans[0], False), (*spans[1], True), (*spans[2], False)]
    assert got.rdd.getNumPartitions() == 3
    daily = {(r.date, r.lead_day): r for r in responses.forecast_weather(spark, folder, *ask, keep=f"{tmp_path}/kept").collect()}
    assert min(daily)[0] == day(2023, 11, 15) and max(daily)[0] == day(2024, 6, 10)
    r = daily[day(2024, 5, 14), 7]  # only in the first chunk
    assert (r.t_mean, r.t_min, r.rain, r.snow) == (17.5, 17.0, 1.5, 0.0)
    r = daily[day(2024, 5, 20), 2]  # in both: the later chunk's
    assert (r.t_mean, r.t_min) == (52.5, 52.0)
    r = daily[day(2024, 6, 10), 1]  # its last hour has no temperature
    assert (r.t_mean, r.wind) == (51.0, 53.0)
    assert daily[day(2024, 6, 9), 5].t_mean is None and daily[day(2024, 6, 9), 5].rain == 0.0
    # Kept: no response is read again.
    (tmp_path / "json" / "2023-11-15_2024-02-14.json").write_text("nonsense")
    again = responses.forecast_weather(spark, folder, *ask, keep=f"{tmp_path}/kept")
    assert again.count() == len(daily)
    assert responses.daily_by_lead(responses.responses(spark, folder, *ask)).where("date < '2024-05-01'").count() == 0
