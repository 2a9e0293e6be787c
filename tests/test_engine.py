import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import scalars as sc
from tidemill.operators import daily, evaluate, features
from tidemill.operators.elastic_net import cross_validated, fit_at, standardise


def test_noon_edges(spark):
    times = ["00:00:00", "11:59:59", "12:00:00", "12:00:00.9", "12:00:01", "23:59:59"]
    rows = spark.createDataFrame([(i, f"2024-01-01 {t}") for i, t in enumerate(times)], "i int, t string").select("i", sc.noon_day(F.to_timestamp("t")).alias("d"))
    assert [r.d.day for r in rows.orderBy("i").collect()] == [1, 1, 1, 1, 2, 2]


def test_sentinel_missing_and_null_keys(spark):
    rows = [(1, "m", "s", -9999.0), (2, "m", "s", None), (3, "m", "s", float("nan")), (4, "m", "s", 1.0), (5, None, "s", 2.0)]
    obs = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 9), m, s, v) for i, m, s, v in rows], "event_id int, ts timestamp, metric string, site string, value double")
    assert [(r.metric, r.value) for r in daily.by_noon_day(obs, "metric", "site").collect()] == [("m", 1.0)]


def test_interpolation_rolling_and_clip(spark):
    gaps = [None, 1.0, None, None, 4.0, None, 7.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(gaps)], "series string, row_idx int, v double")
    assert [r.v for r in features.interpolated(df, "v", "series").orderBy("row_idx").collect()] == [1, 1, 2, 3, 4, 5.5, 7, 7]
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(10)], "series string, row_idx int, y double")
    rows = features.rolling(df, "y", "series").orderBy("row_idx").collect()
    assert [r.mean7 for r in rows[:7]] == [None] * 6 + [4.0] and rows[7].mean7_3 == 3.0 and rows[6].mean7_3 is None
    one = spark.createDataFrame([(None,), (float("nan"),), (53.6,)], "v double").select(sc.clip(F.col("v"), None, 25.0).alias("v"))
    assert sorted((r.v for r in one.collect()), key=str) == [25.0, None, None]


def test_name_clashes(spark):
    keys = spark.createDataFrame([("A 1|x",), ("A 2|x",), ("a|x",)], "col_key string")
    assert [r.feature for r in daily.feature_names(keys).orderBy("ordinal").collect()] == ["a__x", "a__x_1", "a_x"]


def test_repeated_coefficient_raises(spark):
    import pytest

    df = spark.createDataFrame([("p", 1, 0.5), ("p", 1, 0.6)], "predictor string, horizon int, coefficient double")
    with pytest.raises(Exception, match="repeated"):
        evaluate.coefficient_table(df).collect()


def sample(n=80, p=12, seed=1):
    r = np.random.default_rng(seed)
    x = standardise(r.standard_normal((n, p)) @ r.standard_normal((p, p)))[0]
    return x, x @ np.where(np.arange(p) % 3 == 0, r.standard_normal(p), 0) + r.standard_normal(n)


def test_solver_optimality():
    x, y = sample()
    rho = 0.5
    for alpha in (0.01, 0.1, 0.5):
        ((b, a0),) = fit_at([(x, y)], np.array([alpha]), rho)
        g = x.T @ (y - x @ b - a0) / len(y) - alpha * (1 - rho) * b
        on = b != 0
        assert np.allclose(g[on], alpha * rho * np.sign(b[on]), atol=1e-3) and (np.abs(g[~on]) <= alpha * rho + 1e-3).all()


def test_solver_limits():
    x, y = sample()
    ((free, a0),) = fit_at([(x, y)], np.array([0.3]), 0.5, np.zeros(12, bool))
    exact = np.linalg.lstsq(np.c_[x, np.ones(len(y))], y, rcond=None)[0]
    assert np.allclose(free, exact[:-1], atol=1e-2) and np.isclose(a0, exact[-1], atol=1e-2)
    assert not fit_at([(x, y)], np.array([1e3]), 0.5)[0][0].any()
    ridge = fit_at([(x, y)], np.array([0.2]), 1e-9, tol=1e-9)[0][0]
    n = len(y)
    assert np.allclose(ridge, np.linalg.solve(x.T @ x / n + 0.2 * np.eye(12), x.T @ (y - y.mean()) / n), atol=1e-5)
    assert cross_validated([(x, y)], 0.5, 5, 20)[0] > 0


def test_mixed_times(spark):
    from tidemill.sources.readers import mixed_time

    texts = ["2024-01-02 10:00:05", "01/10/2023 00:05", "2 Jan 2024 10:00", "25/12/2023 07:30", "2024/3/4 5:06", "nonsense", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixed_time(F.col("t")).alias("ts"), mixed_time(F.col("t"), True).alias("day"))
    got = rows.orderBy("i").collect()
    assert [str(r.ts) for r in got] == ["2024-01-02 10:00:05", "2023-01-10 00:05:00", "2024-01-02 10:00:00", "2023-12-25 07:30:00", "2024-03-04 05:06:00", "None", "None"]
    assert str(got[1].day) == "2023-10-01 00:05:00"


def test_readers_and_writers(spark, tmp_path):
    from tidemill.sources import readers, writers

    assert readers.other_errors(spark, f"{tmp_path}/none.parquet") is None and readers.forecast_weather(spark, [f"{tmp_path}/none.parquet"]) is None
    for i, hours in enumerate(((1, 2), (2, 3))):  # the second hour is in both chunks
        rows = [(dt.datetime(2024, 1, 1, h), 1, float(h), None, None, 5.0) for h in hours]
        spark.createDataFrame(rows, readers.HOURLY).write.parquet(f"{tmp_path}/c{i}.parquet")
    r = readers.forecast_weather(spark, [f"{tmp_path}/c0.parquet", f"{tmp_path}/c1.parquet"]).first()
    assert (r.t_mean, r.t_min, r.rain, r.snow, r.wind) == (2.0, 1.0, 0.0, 0.0, 5.0)
    w = "date,temperature_2m_mean,temperature_2m_min,rain_sum,snowfall_sum,wind_speed_10m_max\n2024-01-01,1,2,3,4,5\n"
    (tmp_path / "w.csv").write_text(w)
    assert readers.weather(spark, f"{tmp_path}/w.csv").first().rain_sum == 3.0
    assert [writers.model_name("basic", 90), writers.model_name("global", weather=False), writers.model_name("partial", 70, False, True)] == ["basic_w90", "nwx_global", "nwx_partial_esmooth_w70"]


def test_streaming_noon(spark, tmp_path):
    from tidemill.streaming.noon import noon_means

    schema = "ts timestamp, metric string, site string, value double"
    rows = [(dt.datetime(2024, 1, d, h), "m", "s", float(d)) for d in (1, 2, 9) for h in (9, 13)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = noon_means(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("noon").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.d.day, r.value) for r in spark.table("noon").collect()} >= {(1, 1.0), (2, 1.5), (3, 2.0)}
