"""The registered queries of the forecasting engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ForecastConfig
from .functions import scalars as sc
from .operators import daily, evaluate, features, kalman, models, weather
from .plans import forecast as plan
from .sources import responses
from .sources.readers import chunk_bounds, event_observations, order_days, order_observations, priority_days
from .sources.writers import prediction_matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_OBS = """obs AS (SELECT event_id, ts, event_type AS metric, 'site_' || (user_id % 3) AS site,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -9999 ELSE value END AS value FROM events),
good AS (SELECT *, CAST(date_trunc('second', ts) + INTERVAL 43199 SECOND AS DATE) AS nd FROM obs WHERE value IS DISTINCT FROM -9999)"""
_DAYS = """days AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) / 100000 AS y FROM orders GROUP BY 1),
idx AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS row_idx FROM days)"""
_AHEAD = "ahead AS (SELECT a.d AS origin_date, h, b.d AS forecast_date, b.y AS actual, a.y AS predicted FROM idx a, range(1, 11) t(h), idx b WHERE b.row_idx = a.row_idx + h)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather made of readings: one metric for each variable."""
    e = event_observations(spark, sf_dir).where(sc.valid(F.col("value")))
    pick = lambda name: F.when(F.col("metric") == name, F.col("value"))
    names = ["click", "view", "purchase", "error", "signup"]
    return e.groupBy(F.to_date("ts").alias("date")).agg(*(F.avg(pick(n)).alias(n) for n in names))


@query(f"WITH {_OBS} SELECT nd AS d, metric, site, round(avg(value), 6) AS mean_value FROM good WHERE metric IS NOT NULL AND site IS NOT NULL GROUP BY ALL")
def noon_daily_mean(spark, sf_dir):
    return daily.by_noon_day(event_observations(spark, sf_dir), "metric", "site").select("d", "metric", "site", _r("value").alias("mean_value"))


@query(f"WITH {_OBS} SELECT nd AS d, round(avg(value), 6) AS target FROM good WHERE metric = 'error' GROUP BY ALL")
def noon_daily_target(spark, sf_dir):
    return daily.by_noon_day(event_observations(spark, sf_dir).where("metric = 'error'")).select("d", _r("value").alias("target"))


@query(f"WITH {_OBS} SELECT nd AS d, metric, round(avg(value), 6) AS pooled FROM good GROUP BY ALL")
def noon_daily_pooled(spark, sf_dir):
    return daily.by_noon_day(event_observations(spark, sf_dir), "metric").select("d", "metric", _r("value").alias("pooled"))


@query(f"WITH {_OBS} SELECT nd AS d, " + ", ".join(f"round(avg(value) FILTER (site = 'site_{i}'), 6) AS site_{i}" for i in range(3)) + " FROM good GROUP BY ALL")
def daily_wide(spark, sf_dir):
    rows = daily.by_noon_day(event_observations(spark, sf_dir), "site")
    return daily.wide(rows, "site", ["site_0", "site_1", "site_2"]).select("d", *(_r(f"site_{i}").alias(f"site_{i}") for i in range(3)))


@query(
    f"WITH {_OBS}, f AS (SELECT nd AS d, metric, avg(value) AS v FROM good GROUP BY ALL), t AS (SELECT nd AS d, avg(value) AS y FROM good WHERE metric = 'error' GROUP BY ALL)"
    " SELECT f.d, metric, round(v, 6) AS v, round(y, 6) AS y FROM f LEFT JOIN t ON f.d = t.d WHERE metric <> 'error'"
)
def features_with_target(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    t = daily.by_noon_day(obs.where("metric = 'error'")).select("d", F.col("value").alias("y"))
    f = daily.by_noon_day(obs.where("metric <> 'error'"), "metric")
    return f.join(t, "d", "left").select("d", "metric", _r("value").alias("v"), _r("y").alias("y"))


@query(
    f"WITH {_OBS} SELECT CAST(ts AS DATE) AS date, metric, site, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min,"
    " round(coalesce(sum(value), 0), 4) AS sum, round(median(value), 6) AS median FROM good WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL"
)
def get_daily_statistics(spark, sf_dir):
    out = _statistics(spark, sf_dir)
    return out.where(F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))


def _statistics(spark, sf_dir):
    rows = daily.daily_statistics(event_observations(spark, sf_dir))
    return rows.select("date", "metric", "site", *(_r(n, 4 if n == "sum" else 6).alias(n) for n in daily.STATISTICS))


@query(
    f"WITH {_OBS} SELECT CAST(ts AS DATE) AS date, metric, site, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min,"
    " round(coalesce(sum(value), 0), 4) AS sum, round(median(value), 6) AS median FROM good GROUP BY ALL"
)
def get_daily_statistics_all_days(spark, sf_dir):
    """get_daily_statistics, whose SQL holds it to 16 days, over every day."""
    return _statistics(spark, sf_dir)


@query(
    f"WITH {_OBS}, k AS (SELECT *, abs(hour(ts) * 3600 + minute(ts) * 60 + second(ts) - 43200) AS dist FROM good),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY nd, metric, site ORDER BY dist, event_id) AS rn FROM k) SELECT nd AS date, metric, site, round(value, 6) AS value FROM n WHERE rn = 1"
)
def midday_reading(spark, sf_dir):
    return daily.get_daily(event_observations(spark, sf_dir), "midday").select("date", "metric", "site", _r("value").alias("value"))


@query(
    "WITH k AS (SELECT DISTINCT o_orderpriority || '|' || c_mktsegment AS col_key FROM orders JOIN customer ON o_custkey = c_custkey),"
    " o AS (SELECT *, row_number() OVER (ORDER BY col_key) - 1 AS ordinal, trim(lower(regexp_replace(replace(regexp_replace(regexp_replace(col_key, '[0-9()]', '', 'g'), '[ \\-|]', '_', 'g'), '%', 'pct'), '[^A-Za-z_]', '', 'g')), '_') AS name FROM k),"
    " s AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal) - 1 AS n FROM o) SELECT ordinal, col_key, CASE WHEN n > 0 THEN name || '_' || n ELSE name END AS feature FROM s"
)
def feature_dictionary(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderpriority")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    keys = o.join(c, o.o_custkey == c.c_custkey).select(F.concat("o_orderpriority", F.lit("|"), "c_mktsegment").alias("col_key"))
    return daily.feature_names(keys).select("ordinal", "col_key", "feature")


@query(
    f"WITH {_DAYS}, g AS (SELECT *, CASE WHEN row_idx % 7 IN (0, 2, 3) THEN NULL ELSE y END AS v FROM idx),"
    " b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN row_idx END IGNORE NULLS) OVER p AS bi, last_value(v IGNORE NULLS) OVER p AS bv,"
    " first_value(CASE WHEN v IS NOT NULL THEN row_idx END IGNORE NULLS) OVER n AS ai, first_value(v IGNORE NULLS) OVER n AS av FROM g"
    " WINDOW p AS (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    " SELECT d, row_idx, round(CASE WHEN bi IS NULL THEN av WHEN ai IS NULL THEN bv WHEN ai = bi THEN av ELSE bv + (av - bv) * (row_idx - bi) / (ai - bi) END, 6) AS v FROM b"
)
def interpolated_gaps(spark, sf_dir):
    rows = features.with_row_index(order_days(spark, sf_dir), "series").withColumn("v", F.when(~(F.col("row_idx") % 7).isin(0, 2, 3), F.col("y")))
    return features.interpolated(rows, "v", "series").select("d", "row_idx", _r("v").alias("v"))


@query(
    f"WITH {_DAYS} SELECT d, CASE WHEN count(y) OVER w = 7 THEN round(avg(y) OVER w, 6) END AS mean7, CASE WHEN count(y) OVER w = 7 THEN round(stddev_samp(y) OVER w, 6) END AS sd7,"
    " round(lag(y, 3) OVER (ORDER BY row_idx), 6) AS lag3, CASE WHEN count(y) OVER l = 5 THEN round(avg(y) OVER l, 6) END AS mean7_3 FROM idx"
    " WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), l AS (ORDER BY row_idx ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)"
)
def rolling_features(spark, sf_dir):
    rows = features.rolling(features.with_row_index(order_days(spark, sf_dir), "series"), "y", "series")
    return rows.select("d", *(_r(c).alias(c) for c in ("mean7", "sd7", "lag3", "mean7_3")))


@query(
    f"WITH {_DAYS} SELECT d, "
    + ", ".join(f"CAST(isodow(d) - 1 = {i} AS DOUBLE) AS dow_{i}" for i in range(6))
    + ", "
    + ", ".join(f"round({f}(2 * pi() * {k} * dayofyear(d) / 365.25), 6) AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos"))
    + ", d IN (DATE '1996-12-25', DATE '1997-01-01') AS holiday, d IN (DATE '1996-12-26', DATE '1997-01-02') AS after_holiday FROM days"
)
def calendar_features(spark, sf_dir):
    d = F.col("d")
    holidays = [F.lit(x).cast("date") for x in ("1996-12-25", "1997-01-01")]
    rows = order_days(spark, sf_dir).select("d", *sc.weekday_dummies(d), *sc.fourier(d), d.isin(*holidays).alias("holiday"), F.date_sub(d, 1).isin(*holidays).alias("after_holiday"))
    return rows.select("d", *(f"dow_{i}" for i in range(6)), *(_r(f"{f}_{k}").alias(f"{f}_{k}") for k in (1, 2) for f in ("sin", "cos")), "holiday", "after_holiday")


@query(
    f"WITH {_OBS}, f AS (SELECT nd AS d, metric, site, avg(value) AS v FROM good GROUP BY ALL), m AS (SELECT metric, site, avg(v) AS mu, min(v) AS low FROM f GROUP BY ALL),"
    " s AS (SELECT f.metric, f.site, any_value(low) AS low, avg((v - mu) ** 3) / nullif(avg((v - mu) ** 2), 0) ** 1.5 AS skew FROM f JOIN m ON f.metric = m.metric AND f.site = m.site GROUP BY ALL)"
    " SELECT d, f.metric, f.site, round(CASE WHEN skew > 1 AND low > 0 THEN ln(1 + v) WHEN skew > 1 THEN sqrt(v - low + 1) WHEN skew < -1 THEN v * v ELSE v END, 6) AS v FROM f JOIN s ON f.metric = s.metric AND f.site = s.site"
)
def skew_corrected(spark, sf_dir):
    f = daily.by_noon_day(event_observations(spark, sf_dir), "metric", "site")
    return features.skew_corrected(f, "metric", "site").select("d", "metric", "site", _r("value").alias("v"))


@query(
    f"WITH {_OBS}, f AS (SELECT nd AS d, metric, site, avg(value) AS v FROM good GROUP BY ALL), m AS (SELECT metric, site, avg(v) AS mu, min(v) AS low, count(v) AS n FROM f GROUP BY ALL),"
    " s AS (SELECT f.metric, f.site, any_value(low) AS low, avg((v - mu) ** 3) / nullif(avg((v - mu) ** 2), 0) ** 1.5 * ((any_value(n) - 1) / any_value(n)) ** 1.5 AS skew FROM f JOIN m ON f.metric = m.metric AND f.site = m.site GROUP BY ALL)"
    " SELECT d, f.metric, f.site, round(CASE WHEN skew > 1 AND low > 0 THEN ln(1 + v) WHEN skew > 1 THEN sqrt(v - low + 1) WHEN skew < -1 THEN v * v ELSE v END, 6) AS v FROM f JOIN s ON f.metric = s.metric AND f.site = s.site"
)
def sample_skew_corrected(spark, sf_dir):
    """skew_corrected with the sample's skewness."""
    f = daily.by_noon_day(event_observations(spark, sf_dir), "metric", "site")
    return features.skew_corrected(f, "metric", "site", sample=True).select("d", "metric", "site", _r("value").alias("v"))


# Statistics and imputation that don't look ahead.

@query(
    f"WITH {_OBS}, f AS (SELECT nd AS d, metric, site, avg(value) AS v FROM good WHERE metric IS NOT NULL AND site IS NOT NULL GROUP BY ALL),"
    " p AS (SELECT a.d, a.metric, a.site, count(b.v) AS n, avg(b.v) AS mu, min(b.v) AS low FROM f a JOIN f b ON b.metric = a.metric AND b.site = a.site AND b.d <= a.d GROUP BY ALL)"
    " SELECT p.d, p.metric, p.site, any_value(n) AS n, round(any_value(low), 6) AS low, CASE WHEN any_value(n) > 2 THEN round(avg((b.v - mu) ** 3) / nullif(avg((b.v - mu) ** 2), 0) ** 1.5, 6) END AS skew FROM p JOIN f b ON b.metric = p.metric AND b.site = p.site AND b.d <= p.d GROUP BY p.d, p.metric, p.site"
)
def skewness_so_far(spark, sf_dir):
    f = daily.by_noon_day(event_observations(spark, sf_dir), "metric", "site")
    rows = features.so_far(f, "value", "metric", "site", order="d")
    return rows.select("d", "metric", "site", "n", _r("low").alias("low"), F.when(F.col("n") > 2, _r("skew")).alias("skew"))


@query(
    "WITH f AS (SELECT o_orderpriority AS metric, CAST(o_orderdate AS DATE) AS d, power(avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) / 100000, 3) AS v FROM orders GROUP BY ALL),"
    " i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY metric) AS n FROM f),"
    " w AS MATERIALIZED (SELECT DISTINCT metric, s FROM i, range(0, 100000, 28) t(s) WHERE s + 70 <= n), st AS (SELECT w.metric, s, avg(v) AS mu, min(v) AS low FROM w JOIN i ON i.metric = w.metric AND i.r <= s + 59 GROUP BY ALL),"
    " sk AS MATERIALIZED (SELECT st.metric, s, any_value(low) AS low, avg((v - mu) ** 3) / nullif(avg((v - mu) ** 2), 0) ** 1.5 AS skew FROM st JOIN i ON i.metric = st.metric AND i.r <= s + 59 GROUP BY ALL),"
    " x AS (SELECT i.metric, i.d, i.r, sk.s, skew, low, max(k.r) FILTER (k.r <= i.r) AS bi, arg_max(k.v, k.r) FILTER (k.r <= i.r) AS bv, min(k.r) FILTER (k.r >= i.r) AS ai, arg_min(k.v, k.r) FILTER (k.r >= i.r) AS av"
    " FROM sk JOIN i ON i.metric = sk.metric AND i.r BETWEEN sk.s AND sk.s + 59 LEFT JOIN i k ON k.metric = sk.metric AND k.r <= sk.s + 59 AND k.v IS NOT NULL GROUP BY ALL),"
    " l AS (SELECT *, CASE WHEN bi IS NULL THEN av WHEN ai IS NULL THEN bv WHEN ai = bi THEN av ELSE bv + (av - bv) * (r - bi) / (ai - bi) END AS v FROM x)"
    " SELECT metric, d, CAST(s AS INT) AS window_start, round(CASE WHEN skew > 1 AND low > 0 THEN ln(1 + v) WHEN skew > 1 THEN sqrt(v - low + 1) WHEN skew < -1 THEN v * v ELSE v END, 6) AS v FROM l"
)
def windows_so_far(spark, sf_dir):
    """The values of training windows of 60 rows, every 28 rows, filled and transformed as their last row knows them."""
    value = F.pow(F.avg(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))) / 100000, F.lit(3.0))
    f = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("metric"), F.to_date("o_orderdate").alias("d")).agg(value.alias("v"))
    out = features.windows_so_far(features.with_row_index(f, "metric"), "v", "metric", window=60, stride=28)
    return out.select("metric", "d", F.col("window_start").cast("int").alias("window_start"), _r("v").alias("v"))


@query(f"WITH {_DAYS} SELECT d, round(quantile_cont(y, 0.05) OVER (ORDER BY row_idx ROWS BETWEEN 92 PRECEDING AND 3 PRECEDING), 6) AS floor FROM idx")
def trailing_floor(spark, sf_dir):
    return features.trailing_floor(features.with_row_index(order_days(spark, sf_dir), "series"), "y", "series").select("d", _r("floor").alias("floor"))


@query(
    f"WITH {_DAYS}, n AS (SELECT max(row_idx) + 1 AS n FROM idx), w AS (SELECT s AS window_start FROM n, range(0, n - 100 + 1, 14) t(s))"
    " SELECT CAST(window_start AS BIGINT) AS window_start, count(*) AS n_rows, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS sd, stddev_samp(y) > 0 AS usable FROM w JOIN idx ON row_idx BETWEEN window_start AND window_start + 89 GROUP BY window_start"
)
def training_windows(spark, sf_dir):
    rows = features.training_windows(features.with_row_index(order_days(spark, sf_dir), "series"), "series")
    return rows.groupBy(F.col("window_start").cast("long").alias("window_start")).agg(
        F.count("*").alias("n_rows"), _r(F.avg("y")).alias("mean"), _r(F.stddev_pop("y")).alias("sd"), (F.stddev_samp("y") > 0).alias("usable")
    )


_NAIVE = f"WITH {_DAYS}, {_AHEAD}, ids AS (SELECT DISTINCT origin_date FROM ahead), num AS (SELECT origin_date, row_number() OVER (ORDER BY origin_date) AS forecast_id FROM ids)"


def _naive(spark, sf_dir):
    return evaluate.forecast_ids(plan.naive(order_days(spark, sf_dir), ForecastConfig()))


@query(_NAIVE + " SELECT CAST(forecast_id AS INT) AS forecast_id, origin_date, CAST(h AS INT) AS horizon, forecast_date, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM ahead JOIN num USING (origin_date)")
def naive_detail(spark, sf_dir):
    return _naive(spark, sf_dir).select("forecast_id", "origin_date", "horizon", "forecast_date", _r("actual").alias("actual"), _r("predicted").alias("predicted"))


_BANDS = ", bands AS (SELECT forecast_id, origin_date, avg((actual - predicted) ** 2) FILTER (h <= 5) AS mse_1_5, avg((actual - predicted) ** 2) FILTER (h > 5) AS mse_6_10 FROM ahead JOIN num USING (origin_date) GROUP BY ALL)"


@query(_NAIVE + _BANDS + " SELECT CAST(forecast_id AS INT) AS forecast_id, origin_date, round(mse_1_5, 6) AS mse_1_5, round(mse_6_10, 6) AS mse_6_10 FROM bands")
def mse_summary(spark, sf_dir):
    return evaluate.mse_bands(_naive(spark, sf_dir)).select("forecast_id", "origin_date", _r("mse_1_5").alias("mse_1_5"), _r("mse_6_10").alias("mse_6_10"))


@query(_NAIVE + _BANDS + " SELECT " + ", ".join(f"round({n}({c}), 6) AS {m}_{c}" for c in ("mse_1_5", "mse_6_10") for m, n in (("mean", "avg"), ("median", "median"))) + " FROM bands")
def mse_overall(spark, sf_dir):
    out = evaluate.overall(evaluate.mse_bands(_naive(spark, sf_dir)))
    return out.select(*(_r(c).alias(c) for c in out.columns))


@query(_NAIVE + " SELECT CAST(forecast_id AS INT) AS forecast_id, " + ", ".join(f"round(max(predicted) FILTER (h = {h}), 6) AS day_{h}" for h in range(1, 11)) + " FROM ahead JOIN num USING (origin_date) GROUP BY forecast_id")
def forecast_matrix(spark, sf_dir):
    out = prediction_matrix(_naive(spark, sf_dir))
    return out.select("forecast_id", *(_r(f"day_{h}").alias(f"day_{h}") for h in range(1, 11)))


@query(
    f"WITH {_DAYS}, {_AHEAD}, s AS (SELECT a.origin_date, a.h, a.actual, b.y AS predicted FROM ahead a JOIN idx o ON o.d = a.origin_date LEFT JOIN idx b ON b.row_idx = o.row_idx + a.h - 7 * ceil(a.h / 7.0))"
    " SELECT CAST(a.h AS INT) AS horizon, round(avg((a.actual - a.predicted) ** 2), 6) AS w1, round((SELECT avg((actual - predicted) ** 2) FROM s WHERE s.h = a.h), 6) AS w7 FROM ahead a GROUP BY a.h"
)
def horizon_mse(spark, sf_dir):
    days, cfg = order_days(spark, sf_dir), ForecastConfig()
    both = plan.naive(days, cfg).withColumn("train_win", F.lit(1)).unionByName(plan.naive(days, cfg, 7).withColumn("train_win", F.lit(7)))
    return evaluate.horizon_by_window(both, [1, 7]).select("horizon", _r("w1").alias("w1"), _r("w7").alias("w7"))


@query(
    f"WITH {_DAYS}, {_AHEAD} SELECT date, label, round(value, 6) AS value, CAST(ordinal AS INT) AS ordinal FROM (SELECT DISTINCT forecast_date AS date, 'Actual' AS label, actual AS value, 0 AS ordinal FROM ahead"
    " UNION ALL SELECT forecast_date, 'h' || h, predicted, h FROM ahead)"
)
def forecast_series(spark, sf_dir):
    return evaluate.forecast_series(plan.naive(order_days(spark, sf_dir), ForecastConfig())).select("date", "label", _r("value").alias("value"), "ordinal")


_WX = f"WITH {_OBS}, wx AS (SELECT CAST(ts AS DATE) AS date, " + ", ".join(f"avg(value) FILTER (metric = '{m}') AS {m}" for m in ("click", "view", "purchase", "error", "signup")) + " FROM good GROUP BY 1)"


@query(
    _WX + " SELECT date, CASE WHEN click IS NOT NULL THEN round(greatest(45 - click, 0), 6) END AS coldness, CASE WHEN click IS NOT NULL THEN round(greatest(click - 50, 0), 6) END AS hotness,"
    " CAST(coalesce(view < 0, false) AS DOUBLE) AS below, CASE WHEN purchase IS NOT NULL THEN round(least(purchase, 25), 6) END AS rain, CAST(coalesce(purchase > 20, false) AS DOUBLE) AS heavy,"
    " CASE WHEN signup IS NOT NULL THEN round(least(signup, 42), 6) END AS wind FROM wx"
)
def weather_terms(spark, sf_dir):
    c = F.col
    rows = _weather(spark, sf_dir).select("date", *sc.weather_terms(c("click"), c("view"), c("purchase"), c("error"), c("signup"), cold=45, colder=40, hot=50))
    return rows.select(
        "date", _r("wx_coldness").alias("coldness"), _r("wx_hotness").alias("hotness"), c("wx_below_freezing").alias("below"), _r("wx_rain_sum").alias("rain"), c("wx_heavy_rain").alias("heavy"), _r("wx_wind_max").alias("wind")
    )


_FC = ", fc AS (SELECT date, l AS lead_day, click + l AS wx FROM wx, range(1, 8) t(l) WHERE (dayofyear(date) + l) % 3 <> 0), o AS (SELECT date AS d, h FROM wx, range(1, 11) t(h))"
_AT = "(SELECT coalesce(max(f.wx), max(a.click)) FROM wx a LEFT JOIN fc f ON f.date = a.date AND f.lead_day = least(o.h - {k}, 7) WHERE a.date = o.d + CAST(o.h - {k} AS INT))"


def _forecast_weather(spark, sf_dir):
    wx = _weather(spark, sf_dir)
    fc = wx.withColumn("lead_day", F.explode(F.sequence(F.lit(1), F.lit(7)))).where((F.dayofyear("date") + F.col("lead_day")) % 3 != 0)
    origins = wx.select(F.col("date").alias("d")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return wx, fc.select("date", "lead_day", (F.col("click") + F.col("lead_day")).alias("click")), origins


@query(_WX + _FC + f", v AS (SELECT d, h, {_AT.format(k=0)} AS a0, {_AT.format(k=1)} AS a1, {_AT.format(k=2)} AS a2 FROM o) SELECT d, CAST(h AS INT) AS h, round(a0, 6) AS wx, round(list_avg(list_filter([a0, a1, a2], lambda x: x IS NOT NULL)), 6) AS wx_mean3 FROM v")
def weather_at_target(spark, sf_dir):
    wx, fc, origins = _forecast_weather(spark, sf_dir)
    rows = weather.mean3(weather.at_offset(origins, wx, fc, "click"), wx, fc, "click")
    return rows.select("d", "h", _r("wx").alias("wx"), _r("wx_mean3").alias("wx_mean3"))


@query(
    _WX + _FC + " SELECT date, " + ", ".join(f"round(max(wx) FILTER (lead_day = {k}), 6) AS wx_L{k}" for k in range(1, 8)) + " FROM fc GROUP BY date"
)
def weather_by_lead(spark, sf_dir):
    _, fc, _ = _forecast_weather(spark, sf_dir)
    out = weather.lead_wide(fc.withColumnRenamed("click", "wx"), "wx")
    return out.select("date", *(_r(f"wx_L{k}").alias(f"wx_L{k}") for k in range(1, 8)))


@query(
    f"WITH {_DAYS}, {_AHEAD}, p AS (SELECT actual - predicted AS residual, predicted, CAST(h AS DOUBLE) AS horizon FROM ahead), u AS (SELECT 'predicted' AS variable, predicted AS x, residual AS y FROM p UNION ALL SELECT 'horizon', horizon, residual FROM p)"
    " SELECT variable, round(corr(x, y), 6) AS r, count(*) AS n FROM u GROUP BY variable"
)
def residual_correlations(spark, sf_dir):
    rows = plan.naive(order_days(spark, sf_dir), ForecastConfig()).withColumn("residual", F.col("actual") - F.col("predicted"))
    return evaluate.correlations(rows, ["predicted", "horizon"]).select("variable", _r("r").alias("r"), "n")


@query(
    f"WITH {_DAYS}, k AS (SELECT *, greatest(20, (SELECT count(*) FROM idx) // 8) AS w, row_number() OVER (ORDER BY y, d) AS i FROM idx)"
    " SELECT a.d, round(a.y, 6) AS x, round(avg(CAST(b.row_idx AS DOUBLE)), 4) AS trend FROM k a JOIN k b ON b.i BETWEEN a.i - a.w + 1 AND a.i WHERE a.i >= a.w GROUP BY ALL"
)
def trend_by_value(spark, sf_dir):
    rows = features.with_row_index(order_days(spark, sf_dir), "series").withColumn("z", F.col("row_idx").cast("double"))
    out = evaluate.rolling_by_x(rows, "y", "z", "series", tiebreak="d")
    return out.select("d", _r("y").alias("x"), _r("trend", 4).alias("trend"))


_COEF = "WITH c AS (SELECT event_type AS predictor, user_id % 10 + 1 AS horizon, avg(CASE WHEN user_id % 10 + 1 <> 4 OR event_type <> 'error' THEN value END) - 50 AS c FROM events GROUP BY ALL)"


def _coefficients(spark, sf_dir):
    """Weights by predictor and horizon; one is missing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.expr("user_id % 10 + 1 <> 4 or event_type <> 'error'"), F.col("value"))
    return e.groupBy(F.col("event_type").alias("predictor"), (F.col("user_id") % 10 + 1).cast("int").alias("horizon")).agg((F.avg(value) - 50).alias("coefficient"))


@query(_COEF + " SELECT predictor, " + ", ".join(f"round(coalesce(max(c) FILTER (horizon = {h}), 0), 6) AS h{h}" for h in range(1, 11)) + ", round(sum(abs(c)) / 10, 6) AS mean_abs FROM c GROUP BY predictor")
def coefficient_table(spark, sf_dir):
    out = evaluate.coefficient_table(_coefficients(spark, sf_dir))
    return out.select("predictor", *(_r(f"h{h}").alias(f"h{h}") for h in range(1, 11)), _r("mean_abs").alias("mean_abs"))


@query(
    "WITH c AS (SELECT l_returnflag || '|' || l_linenumber AS predictor, l_returnflag AS metric, count(*) FILTER (l_quantity > 30) AS n_selected, (SELECT count(*) FROM lineitem) // 49 AS total_slots FROM lineitem GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (ORDER BY n_selected DESC, predictor) AS rank FROM c), s AS (SELECT DISTINCT metric FROM r WHERE rank <= 5)"
    " SELECT predictor, n_selected, rank <= 5 AS seed, metric IN (SELECT metric FROM s) AND n_selected >= 0.05 * total_slots AS in_model FROM r"
)
def seed_expansion(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_quantity")
    names = li.groupBy(F.concat("l_returnflag", F.lit("|"), F.col("l_linenumber").cast("string")).alias("predictor"), F.col("l_returnflag").alias("metric")).agg(F.count_if(F.col("l_quantity") > 30).alias("n_selected"))
    counts = names.crossJoin(F.broadcast(li.agg(F.floor(F.count("*") / 49).alias("total_slots"))))
    dictionary = names.select("predictor", "metric", F.row_number().over(Window.orderBy("predictor")).alias("ordinal"))
    return models.seed_and_expand(counts, dictionary, ForecastConfig(top=5)).select("predictor", "n_selected", "seed", "in_model")


@query(
    f"WITH {_DAYS}, m AS (SELECT *, avg(y) OVER w AS mean7, stddev_samp(y) OVER w AS sd7, row_idx >= 7 AS ok FROM idx WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),"
    " u AS (SELECT 'mean7' AS feature, mean7 AS v FROM m WHERE ok UNION ALL SELECT 'sd7', sd7 FROM m WHERE ok) SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM u GROUP BY feature"
)
def scaler_statistics(spark, sf_dir):
    m = plan.matrix(order_days(spark, sf_dir)).select(F.posexplode("op").alias("i", "v")).where(F.col("i").isin(1, 2))
    return m.groupBy(F.element_at(F.array(*map(F.lit, plan.NAMES)), F.col("i") + 1).alias("feature")).agg(_r(F.avg("v")).alias("mean"), _r(F.stddev_pop("v")).alias("scale"))


# Selection in order, holdout, comparison, residuals with weather.

_SEL = (
    "WITH c AS (SELECT l_returnflag || '|' || l_linenumber AS predictor, l_returnflag AS metric, count(*) FILTER (l_quantity > 30) AS n_selected, (SELECT count(*) FROM lineitem) // 49 AS total_slots FROM lineitem GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (ORDER BY n_selected DESC, predictor) AS rank FROM c), s AS (SELECT DISTINCT metric FROM r WHERE rank <= 5)"
)


@query(
    _SEL + " SELECT CAST(rank AS INT) AS rank, predictor, metric, n_selected, total_slots, round_even(100.0 * n_selected / total_slots, 2) AS pct_selected, rank <= 5 AS seed,"
    " metric IN (SELECT metric FROM s) AND n_selected >= 0.05 * total_slots AS expanded, false AS forced FROM r"
)
def selection_summary(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_quantity")
    names = li.groupBy(F.concat("l_returnflag", F.lit("|"), F.col("l_linenumber").cast("string")).alias("predictor"), F.col("l_returnflag").alias("metric")).agg(F.count_if(F.col("l_quantity") > 30).alias("n_selected"))
    counts = names.crossJoin(F.broadcast(li.agg(F.floor(F.count("*") / 49).alias("total_slots"))))
    dictionary = names.select("predictor", "metric", F.row_number().over(Window.orderBy("predictor")).alias("ordinal"), F.lit("op").alias("kind"))
    out = models.seed_and_expand(counts, dictionary, ForecastConfig(top=5))
    return out.orderBy("rank").select("rank", "predictor", "metric", "n_selected", "total_slots", "pct_selected", "seed", "expanded", "forced")


@query(_NAIVE + _BANDS + " SELECT CAST(forecast_id AS INT) AS forecast_id, origin_date, round(mse_1_5, 6) AS mse_1_5, round(mse_6_10, 6) AS mse_6_10 FROM bands WHERE origin_date > DATE '2000-09-30'")
def holdout_bands(spark, sf_dir):
    held = evaluate.since(_naive(spark, sf_dir), "2000-09-30", inclusive=False)
    return evaluate.mse_bands(held).select("forecast_id", "origin_date", _r("mse_1_5").alias("mse_1_5"), _r("mse_6_10").alias("mse_6_10"))


@query(
    f"WITH {_DAYS}, {_AHEAD}, b AS (SELECT a.*, l.y AS seasonal FROM ahead a JOIN idx o ON o.d = a.origin_date LEFT JOIN idx l ON l.row_idx = o.row_idx + a.h - 7 * ceil(a.h / 7.0)),"
    " e AS (SELECT origin_date, avg((actual - predicted) ** 2) FILTER (h <= 5) AS n1, avg((actual - predicted) ** 2) FILTER (h > 5) AS n2, avg((actual - seasonal) ** 2) FILTER (h <= 5) AS s1, avg((actual - seasonal) ** 2) FILTER (h > 5) AS s2"
    " FROM b WHERE origin_date >= DATE '1999-01-01' GROUP BY 1) SELECT 'last' AS model, round(avg(n1), 6) AS mean_mse_1_5, round(median(n1), 6) AS median_mse_1_5, round(avg(n2), 6) AS mean_mse_6_10, round(median(n2), 6) AS median_mse_6_10 FROM e"
    " UNION ALL SELECT 'season', round(avg(s1), 6), round(median(s1), 6), round(avg(s2), 6), round(median(s2), 6) FROM e"
)
def model_comparison(spark, sf_dir):
    days, cfg = order_days(spark, sf_dir), ForecastConfig()
    one = evaluate.mse_bands(evaluate.forecast_ids(plan.naive(days, cfg)))
    two = evaluate.mse_bands(evaluate.forecast_ids(evaluate.since(plan.naive(days, cfg, 7), "1999-01-01")))
    out = evaluate.compare(one, two, "last", "season")
    return out.select("model", *(_r(c).alias(c) for c in out.columns if c != "model"))


_OWX = "owx AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 45 - 8 END) AS t_mean FROM orders GROUP BY 1)"


def _order_weather(spark, sf_dir):
    """Daily temperatures made of orders; some days have none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 45 - 8)).alias("t_mean"))


_TERMS = " CASE WHEN t_mean IS NOT NULL THEN round(greatest(10 - t_mean, 0), 6) END AS wx_coldness, CASE WHEN t_mean IS NOT NULL THEN round(greatest(t_mean - 10, 0), 6) END AS wx_hotness, CASE WHEN t_mean IS NOT NULL THEN round(greatest(5 - t_mean, 0), 6) END AS wx_coldness2, CASE WHEN t_mean IS NOT NULL THEN round(greatest(t_mean - 25, 0), 6) END AS wx_hotness2"


@query(f"WITH {_DAYS}, {_AHEAD}, {_OWX} SELECT origin_date, CAST(h AS INT) AS horizon, forecast_date, round(actual - predicted, 6) AS residual,{_TERMS} FROM ahead LEFT JOIN owx ON date = forecast_date")
def residuals_with_weather(spark, sf_dir):
    rows = evaluate.with_weather(plan.naive(order_days(spark, sf_dir), ForecastConfig()), _order_weather(spark, sf_dir))
    rows = rows.select("origin_date", "horizon", "forecast_date", "residual", *sc.residual_terms(F.col("t_mean")))
    return rows.select("origin_date", "horizon", "forecast_date", *(_r(c).alias(c) for c in rows.columns[3:]))


@query(
    f"WITH {_DAYS}, {_AHEAD}, {_OWX}, r AS (SELECT actual - predicted AS residual, greatest(10 - t_mean, 0) AS cold, greatest(t_mean - 10, 0) AS hot FROM ahead JOIN owx ON date = forecast_date WHERE t_mean IS NOT NULL),"
    " u AS (SELECT 'wx_coldness' AS variable, cold AS x, residual AS y FROM r UNION ALL SELECT 'wx_hotness', hot, residual FROM r), k AS (SELECT variable, corr(x, y) AS r, count(*) AS n FROM u GROUP BY 1)"
    " SELECT variable, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM k"
)
def residual_significance(spark, sf_dir):
    rows = evaluate.with_weather(plan.naive(order_days(spark, sf_dir), ForecastConfig()), _order_weather(spark, sf_dir))
    rows = rows.select("residual", *sc.residual_terms(F.col("t_mean")))
    return evaluate.correlations(rows, ["wx_coldness", "wx_hotness"]).select("variable", _r("r").alias("r"), "n", _r("t", 4).alias("t"))


@query(f"WITH {_DAYS}, {_OWX} SELECT d, round(y, 6) AS y, round(t_mean, 6) AS t_mean,{_TERMS} FROM days LEFT JOIN owx ON date = d")
def features_with_weather(spark, sf_dir):
    rows = weather.joined(order_days(spark, sf_dir), _order_weather(spark, sf_dir)).select("d", "y", "t_mean", *sc.residual_terms(F.col("t_mean")))
    return rows.select("d", *(_r(c).alias(c) for c in rows.columns[1:]))


# Forecast weather: hours to days by lead, chunks, derived terms by lead.

_HOURS = "hr AS (SELECT ts, CAST(event_id % 7 + 1 AS INT) AS lead_day, CASE WHEN event_id % 11 <> 0 THEN value - 40 END AS temp, CASE WHEN event_id % 5 <> 0 THEN value / 10 END AS rain, CASE WHEN event_id % 13 = 0 THEN value / 50 END AS snow, value AS wind FROM events)"
_FDAYS = "fd AS (SELECT CAST(ts AS DATE) AS date, lead_day, avg(temp) AS t_mean, min(temp) AS t_min, coalesce(sum(rain), 0) AS rain, coalesce(sum(snow), 0) AS snow, max(wind) AS wind FROM hr GROUP BY ALL)"


def _forecast_days(spark, sf_dir):
    e, v = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value")
    part = lambda cond, value: F.when(F.expr(cond), value)
    hours = e.select(
        "ts", (F.col("event_id") % 7 + 1).cast("int").alias("lead_day"), part("event_id % 11 <> 0", v - 40).alias("temp"), part("event_id % 5 <> 0", v / 10).alias("rain"), part("event_id % 13 = 0", v / 50).alias("snow"), v.alias("wind")
    )
    return weather.hourly_to_daily(hours)


@query(f"WITH {_HOURS}, {_FDAYS} SELECT date, lead_day, round(t_mean, 6) AS t_mean, round(t_min, 6) AS t_min, round(rain, 6) AS rain, round(snow, 6) AS snow, round(wind, 6) AS wind FROM fd")
def hourly_forecast_to_daily(spark, sf_dir):
    return _forecast_days(spark, sf_dir).select("date", "lead_day", *(_r(c).alias(c) for c in ("t_mean", "t_min", "rain", "snow", "wind")))


_BY_LEAD = {
    "wx_coldness": "greatest(10 - t_mean, 0)", "wx_coldness2": "greatest(5 - t_mean, 0)", "wx_hotness": "greatest(t_mean - 25, 0)", "wx_below_freezing": "CAST(t_min < 0 AS DOUBLE)",
    "wx_rain_sum": "least(rain, 25)", "wx_heavy_rain": "CAST(rain > 20 AS DOUBLE)", "wx_snowfall_sum": "snow", "wx_wind_max": "least(wind, 42)",
}


@query(f"WITH {_HOURS}, {_FDAYS} SELECT date, " + ", ".join(f"round(max(CASE WHEN t_mean IS NOT NULL THEN {x} END) FILTER (lead_day = {k}), 6) AS {n}_L{k}" for n, x in _BY_LEAD.items() for k in range(1, 8)) + " FROM fd GROUP BY date")
def forecast_weather_wide(spark, sf_dir):
    out = weather.forecast_wide(_forecast_days(spark, sf_dir).where("t_mean is not null"))
    return out.select("date", *(_r(f"{n}_L{k}").alias(f"{n}_L{k}") for n in _BY_LEAD for k in range(1, 8)))


@query(
    "WITH s AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem), e AS (SELECT min(d) AS lo, max(d) AS hi FROM s), c AS (SELECT CAST(lo + INTERVAL 1 MONTH * (3 * k) AS DATE) AS first, least(CAST(lo + INTERVAL 1 MONTH * (3 * k + 3) AS DATE) - 1, hi) AS last FROM e, range(0, 400) r(k) WHERE lo + INTERVAL 1 MONTH * (3 * k) <= hi)"
    " SELECT first, last, count(d) AS n_rows, count(DISTINCT d) AS n_days FROM c LEFT JOIN s ON d BETWEEN first AND last GROUP BY ALL"
)
def weather_chunks(spark, sf_dir):
    """The chunks of three months that the days of a table make up, and what falls into each."""
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"))
    lo, hi = days.agg(F.min("d"), F.max("d")).first()
    chunks = chunk_bounds(spark, str(lo), str(hi), 3)
    # A chunk names its days, so the range join is a join by day.
    each = chunks.select("first", "last", F.explode(F.sequence("first", "last")).alias("d")).join(days, "d", "left")
    return each.groupBy("first", "last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("n").alias("n_days"))


@query(
    f"WITH {_HOURS}, g AS (SELECT DISTINCT CAST(ts AS DATE) AS date, CAST(l AS INT) AS lead_day FROM hr, range(1, 8) r(l))"
    " SELECT g.date, g.lead_day, round(avg(temp), 6) AS t_mean, round(min(temp), 6) AS t_min, round(coalesce(sum(rain), 0), 6) AS rain, round(coalesce(sum(snow), 0), 6) AS snow, round(max(wind), 6) AS wind"
    " FROM g LEFT JOIN hr ON CAST(ts AS DATE) = g.date AND hr.lead_day = g.lead_day GROUP BY ALL"
)
def weather_responses(spark, sf_dir):
    """Daily weather by lead from JSON responses with parallel arrays, made of a thousand events each."""
    e, v = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value")
    part = lambda cond, value: F.when(F.expr(cond), value)
    values = {"temp": part("event_id % 11 <> 0", v - 40), "rain": part("event_id % 5 <> 0", v / 10), "snow": part("event_id % 13 = 0", v / 50), "wind": v}
    # Keys with a null keep their place in the arrays, so hours are listed as structs first.
    cells = {f"{responses.VARIABLES[c]}_previous_day{k}": F.when(F.col("event_id") % 7 + 1 == k, x) for k in range(1, 8) for c, x in values.items()}
    listed = e.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.min(F.to_date("ts")).alias("first"), F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "event_id", *(x.alias(n) for n, x in cells.items())))).alias("h")
    )
    hourly = F.struct(*(F.col(f"h.{n}").alias(n) for n in ("time", *cells)))
    bodies = listed.select("part", "first", F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))
    out = weather.hourly_to_daily(responses.hours(bodies))
    return out.select("date", "lead_day", *(_r(c).alias(c) for c in ("t_mean", "t_min", "rain", "snow", "wind")))


# Daily values for charts.

@query(f"WITH {_OBS} SELECT CAST(ts AS DATE) AS date, metric, site, round(max(value), 6) AS value FROM good WHERE metric IN ('click', 'view') AND CAST(ts AS DATE) <= '2024-01-25' GROUP BY ALL")
def daily_until_cutoff(spark, sf_dir):
    out = daily.get_daily(event_observations(spark, sf_dir), "max", metrics=["click", "view"], cutoff="2024-01-25", ordered=True)
    return out.select("date", "metric", "site", _r("value").alias("value"))


_LABEL = "SELECT date, CASE WHEN (SELECT count(DISTINCT metric) FROM q) = 1 THEN site WHEN (SELECT count(DISTINCT site) FROM q) = 1 THEN metric ELSE metric || ' \u00b7 ' || site END AS series, round(value, 6) AS value FROM q"


@query(f"WITH {_OBS}, q AS (SELECT CAST(ts AS DATE) AS date, metric, site, avg(value) AS value FROM good GROUP BY ALL) {_LABEL}")
def series_labels(spark, sf_dir):
    return daily.series_labels(daily.get_daily(event_observations(spark, sf_dir))).select("date", "series", _r("value").alias("value"))


@query(f"WITH {_OBS}, q AS (SELECT CAST(ts AS DATE) AS date, metric, site, avg(value) AS value FROM good WHERE metric = 'view' GROUP BY ALL) {_LABEL}")
def series_labels_of_one_metric(spark, sf_dir):
    return daily.series_labels(daily.get_daily(event_observations(spark, sf_dir), metrics=["view"])).select("date", "series", _r("value").alias("value"))


@query(
    f"WITH {_OBS}, q AS (SELECT CAST(ts AS DATE) AS date, metric || '|' || site AS label, avg(value) AS value FROM good WHERE metric IN ('click', 'view') GROUP BY ALL), n AS (SELECT label, row_number() OVER (ORDER BY label) AS ordinal FROM (SELECT DISTINCT label FROM q))"
    " SELECT date, label, round(value, 6) AS value, CAST(ordinal AS INT) AS ordinal FROM q JOIN n USING (label) UNION ALL SELECT CAST(ts AS DATE), 'target', round(avg(value), 6), 0 FROM good WHERE metric = 'error' GROUP BY 1"
)
def target_with_metrics(spark, sf_dir):
    obs = event_observations(spark, sf_dir)
    target = daily.cleaned(obs).where("metric = 'error'").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    return daily.with_target(daily.get_daily(obs, metrics=["click", "view"]), target).select("date", "label", _r("value").alias("value"), "ordinal")


# Coefficients.

_DETAIL = "c AS (SELECT event_type AS predictor, user_id % 10 + 1 AS horizon, user_id % 7 AS forecast_id, CASE WHEN count(*) % 3 <> 0 THEN avg(value) - 50 ELSE 0 END AS c FROM events GROUP BY ALL)"


def _coefficient_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = [F.col("event_type").alias("predictor"), (F.col("user_id") % 10 + 1).cast("int").alias("horizon"), (F.col("user_id") % 7).alias("forecast_id")]
    return e.groupBy(*keys).agg(F.when(F.count("*") % 3 != 0, F.avg("value") - 50).otherwise(0.0).alias("coefficient"))


@query(f"WITH {_DETAIL} SELECT forecast_id, CAST(horizon AS INT) AS horizon, predictor, round(c, 6) AS coefficient FROM c WHERE c <> 0")
def coefficient_detail(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    at = [F.max(F.when(F.col("predictor") == n, F.col("coefficient"))) for n in names]
    wide = _coefficient_rows(spark, sf_dir).groupBy("forecast_id", "horizon").agg(F.array(*(F.coalesce(x, F.lit(0.0)) for x in at)).alias("coef"))
    detail = wide.select(F.lit("s").alias("series"), F.lit(90).alias("train_win"), F.col("forecast_id").alias("origin_date"), "horizon", "coef")
    out = models.coefficient_detail(detail, names)
    return out.select(F.col("origin_date").alias("forecast_id"), "horizon", "predictor", _r("coefficient").alias("coefficient"))


@query(f"WITH {_DETAIL} SELECT CAST(horizon AS INT) AS horizon, round(count(*) / count(DISTINCT forecast_id), 6) AS per_window FROM c WHERE c <> 0 GROUP BY 1")
def nonzero_per_window(spark, sf_dir):
    return evaluate.nonzero_per_window(_coefficient_rows(spark, sf_dir).where("coefficient <> 0"), "horizon").select("horizon", _r("per_window").alias("per_window"))


@query(f"WITH {_DETAIL} SELECT forecast_id, CAST(horizon AS INT) AS horizon, CAST(count(*) FILTER (c <> 0) AS INT) AS n_nonzero FROM c GROUP BY 1, 2")
def nonzero_by_model(spark, sf_dir):
    wide = _coefficient_rows(spark, sf_dir).groupBy("forecast_id", "horizon").agg(F.collect_list("coefficient").alias("coef"))
    return wide.select("forecast_id", "horizon", F.size(F.filter("coef", lambda c: c != 0)).cast("int").alias("n_nonzero"))


@query(_COEF + ", m AS (SELECT predictor, sum(abs(c)) / 10 AS mean_abs FROM c GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY mean_abs DESC, predictor) AS INT) AS rank, predictor, round(mean_abs, 6) AS mean_abs FROM m")
def coefficients_by_magnitude(spark, sf_dir):
    return evaluate.by_magnitude(evaluate.coefficient_table(_coefficients(spark, sf_dir))).select("rank", "predictor", _r("mean_abs").alias("mean_abs"))


# What models are fitted to: the wide matrix, the inputs of a horizon, and the ensemble's arithmetic.

_WIDE = (
    "WITH o AS MATERIALIZED (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS metric, o_orderpriority || '|' || c_mktsegment AS col_key, o_totalprice / 100000 AS value FROM orders JOIN customer ON o_custkey = c_custkey),"
    " f AS (SELECT d, col_key, avg(value) AS v FROM o GROUP BY ALL), t AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END) / 100000 AS y FROM orders GROUP BY 1),"
    " k AS MATERIALIZED (SELECT col_key, any_value(metric) AS metric, row_number() OVER (ORDER BY col_key) - 1 AS base, trim(lower(regexp_replace(replace(regexp_replace(regexp_replace(col_key, '[0-9()]', '', 'g'), '[ \\-|]', '_', 'g'), '%', 'pct'), '[^A-Za-z_]', '', 'g')), '_') AS name FROM o GROUP BY col_key),"
    " dict AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY base) > 1 THEN name || '_' || (row_number() OVER (PARTITION BY name ORDER BY base) - 1) ELSE name END AS feature, (SELECT count(*) FROM k) AS n FROM k)"
)
_PREDICTORS = (
    ", p AS (SELECT base AS ordinal, feature AS predictor, metric, 'op' AS kind, true AS penalised FROM dict UNION ALL SELECT n + 2 * base, feature || '_roll_mean7', metric, 'op', true FROM dict UNION ALL SELECT n + 2 * base + 1, feature || '_roll_sd7', metric, 'op', true FROM dict"
    " UNION ALL SELECT 3 * max(n), 'lag3', 'target', 'op', true FROM dict UNION ALL SELECT 3 * max(n) + 1, 'mean7_3', 'target', 'op', true FROM dict"
)


def _gapped_target(spark, sf_dir):
    """Mean order value by day without each fiftieth order; a day of such orders alone has no target."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.avg(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice"))) / 100000
    return o.groupBy(F.lit("orders").alias("series"), F.to_date("o_orderdate").alias("d")).agg(value.alias("y"))


def _wide(spark, sf_dir, calendar=None):
    """(daily, target, dictionary) of order values by priority and segment; some days have no target."""
    obs = order_observations(spark, sf_dir)
    rows = obs.groupBy("series", "d", F.concat("metric", F.lit("|"), "site").alias("col_key")).agg(F.avg("value").alias("value"))
    target = _gapped_target(spark, sf_dir)
    return rows, target, features.predictors(daily.feature_names(rows, "col_key", "series"), plan.CALENDAR if calendar is None else calendar)


@query(_WIDE + _PREDICTORS + " UNION ALL SELECT i - 1, name, name, CASE WHEN name LIKE 'wx%' THEN 'weather' ELSE 'calendar' END, false FROM (SELECT unnest(" + str([*plan.CALENDAR, "wx_t"]) + ") AS name, unnest(range(1, 12)) AS i)) SELECT CAST(ordinal AS INT) AS ordinal, predictor, metric, kind, penalised FROM p")
def predictor_dictionary(spark, sf_dir):
    return _wide(spark, sf_dir, [*plan.CALENDAR, "wx_t"])[2].select("ordinal", "predictor", "metric", "kind", "penalised")


@query(
    _WIDE + ", days AS MATERIALIZED (SELECT DISTINCT f.d, y FROM f LEFT JOIN t USING (d)), di AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM days), grid AS MATERIALIZED (SELECT di.d, y, i, base, n, v FROM di CROSS JOIN dict LEFT JOIN f ON f.d = di.d AND f.col_key = dict.col_key),"
    " b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS bi, last_value(v IGNORE NULLS) OVER p AS bv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ai, first_value(v IGNORE NULLS) OVER q AS av FROM grid"
    " WINDOW p AS (PARTITION BY base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY base ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
    " g AS (SELECT d, base, n, CASE WHEN bi IS NULL THEN av WHEN ai IS NULL THEN bv WHEN ai = bi THEN av ELSE bv + (av - bv) * (i - bi) / (ai - bi) END AS v FROM b WHERE y IS NOT NULL),"
    " r AS MATERIALIZED (SELECT *, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS m, CASE WHEN count(v) OVER w = 7 THEN stddev_samp(v) OVER w END AS s FROM g WINDOW w AS (PARTITION BY base ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),"
    " own AS (SELECT d, lag(y, 3) OVER (ORDER BY d) AS l, CASE WHEN count(y) OVER z = 5 THEN avg(y) OVER z END AS m FROM days WHERE y IS NOT NULL WINDOW z AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)),"
    " u AS MATERIALIZED (SELECT d, base AS ordinal, v FROM r UNION ALL SELECT d, n + 2 * base, m FROM r UNION ALL SELECT d, n + 2 * base + 1, s FROM r UNION ALL SELECT d, 3 * (SELECT max(n) FROM dict), l FROM own UNION ALL SELECT d, 3 * (SELECT max(n) FROM dict) + 1, m FROM own),"
    " bad AS MATERIALIZED (SELECT DISTINCT d FROM u WHERE v IS NULL), h AS MATERIALIZED (SELECT u.* FROM u ANTI JOIN bad ON u.d = bad.d), mu AS (SELECT ordinal, avg(v) AS mu, min(v) AS low FROM h GROUP BY 1), sk AS (SELECT h.ordinal, any_value(low) AS low, avg((v - mu) ** 3) / nullif(avg((v - mu) ** 2), 0) ** 1.5 AS skew FROM h JOIN mu ON h.ordinal = mu.ordinal GROUP BY 1)"
    " SELECT h.d, CAST(h.ordinal AS INT) AS ordinal, round((CASE WHEN skew > 1 AND low > 0 THEN ln(1 + v) WHEN skew > 1 THEN sqrt(v - low + 1) WHEN skew < -1 THEN v * v ELSE v END) * pi(), 5) AS value_pi, round(y, 6) AS y FROM h JOIN sk ON h.ordinal = sk.ordinal JOIN t ON h.d = t.d"
)
def wide_feature_matrix(spark, sf_dir):
    """Values times pi, so that rounding meets no ties: prices have few decimals."""
    return plan.wide_features(*_wide(spark, sf_dir)).select("d", "ordinal", _r(F.col("value") * F.pi(), 5).alias("value_pi"), _r("y").alias("y"))


@query(
    _WIDE + ", days AS MATERIALIZED (SELECT DISTINCT f.d, y FROM f LEFT JOIN t USING (d)), grid AS MATERIALIZED (SELECT days.d, y, base, n, last_value(v IGNORE NULLS) OVER (PARTITION BY base ORDER BY days.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM days CROSS JOIN dict LEFT JOIN f ON f.d = days.d AND f.col_key = dict.col_key),"
    " r AS MATERIALIZED (SELECT *, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS m, CASE WHEN count(v) OVER w = 7 THEN stddev_samp(v) OVER w END AS s FROM grid WHERE y IS NOT NULL WINDOW w AS (PARTITION BY base ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),"
    " own AS (SELECT d, lag(y, 3) OVER (ORDER BY d) AS l, CASE WHEN count(y) OVER z = 5 THEN avg(y) OVER z END AS m FROM days WHERE y IS NOT NULL WINDOW z AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)),"
    " u AS MATERIALIZED (SELECT d, base AS ordinal, v FROM r UNION ALL SELECT d, n + 2 * base, m FROM r UNION ALL SELECT d, n + 2 * base + 1, s FROM r UNION ALL SELECT d, 3 * (SELECT max(n) FROM dict), l FROM own UNION ALL SELECT d, 3 * (SELECT max(n) FROM dict) + 1, m FROM own),"
    " bad AS MATERIALIZED (SELECT DISTINCT d FROM u WHERE v IS NULL), h AS MATERIALIZED (SELECT u.* FROM u ANTI JOIN bad ON u.d = bad.d), p AS MATERIALIZED (SELECT d, ordinal, v, count(v) OVER w AS k, avg(v) OVER w AS mu, min(v) OVER w AS low FROM h WINDOW w AS (PARTITION BY ordinal ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    " SELECT p.d, CAST(p.ordinal AS INT) AS ordinal, round(any_value(p.v) * pi(), 5) AS value_pi, round(any_value(low) * pi(), 5) AS low_pi, CASE WHEN any_value(k) > 2 AND min(b.v) < max(b.v) THEN round(avg((b.v - mu) ** 3) / avg((b.v - mu) ** 2) ** 1.5, 5) END AS skew FROM p JOIN h b ON b.ordinal = p.ordinal AND b.d <= p.d GROUP BY p.d, p.ordinal"
)
def wide_features_as_known(spark, sf_dir):
    """wide_feature_matrix without a look ahead: gaps carried forward, the statistics of each row's own past beside the values."""
    rows = plan.wide_features(*_wide(spark, sf_dir), as_known=True)
    third = F.row_number().over(Window.partitionBy("series", "ordinal").orderBy("d")) > 2
    skew = F.when(third & ~F.isnan("skew"), _r("skew", 5))  # equal values have none
    return rows.select("d", "ordinal", _r(F.col("value") * F.pi(), 5).alias("value_pi"), _r(F.col("low") * F.pi(), 5).alias("low_pi"), skew.alias("skew"))


_INPUTS = (
    f"WITH {_DAYS}, a AS (SELECT *, lag(y, 3) OVER (ORDER BY row_idx) AS lag3 FROM idx), m AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i FROM a WHERE row_idx >= 7)"
    " SELECT o.d AS origin_date, CAST(h AS INT) AS horizon, t.d AS forecast_date, round(t.y, 6) AS actual, round(o.y, 6) AS y0, round(o.lag3, 6) AS lag3, CAST(isodow(t.d) = 1 AS DOUBLE) AS dow_0, round(sin(2 * pi() * dayofyear(t.d) / 365.25), 6) AS sin_1"
    " FROM m o, range(1, 11) r(h), m t WHERE t.i = o.i + h"
)


@query(_INPUTS)
def model_inputs(spark, sf_dir):
    rows = plan.model_inputs(plan.matrix(order_days(spark, sf_dir)))
    at = lambda a, names, n: F.col(a)[names.index(n)]
    return rows.select(
        "origin_date", "horizon", "forecast_date", _r("actual").alias("actual"), _r(at("op", plan.OWN, "y0")).alias("y0"), _r(at("op", plan.OWN, "lag3")).alias("lag3"), at("later", plan.CALENDAR, "dow_0").alias("dow_0"), _r(at("later", plan.CALENDAR, "sin_1")).alias("sin_1")
    )


@query(
    f"WITH {_DAYS}, {_AHEAD}, fl AS (SELECT d, quantile_cont(y, 0.05) OVER (ORDER BY row_idx ROWS BETWEEN 92 PRECEDING AND 3 PRECEDING) AS floor FROM idx),"
    " b AS (SELECT a.*, l.y AS seasonal, floor FROM ahead a JOIN idx o ON o.d = a.origin_date JOIN fl ON fl.d = a.origin_date LEFT JOIN idx l ON l.row_idx = o.row_idx + a.h - 7 * ceil(a.h / 7.0)),"
    " e AS (SELECT *, CASE WHEN h <= 5 OR seasonal IS NULL THEN predicted ELSE (predicted + seasonal) / 2 END AS p FROM b) SELECT origin_date, CAST(h AS INT) AS horizon, round(least(greatest(p, coalesce(floor, p)), 1.6), 6) AS predicted FROM e"
)
def ensemble_arithmetic(spark, sf_dir):
    days, cfg = order_days(spark, sf_dir), ForecastConfig(cap=1.6)
    floors = features.trailing_floor(features.with_row_index(days, "series"), "y", "series").select("series", F.col("d").alias("origin_date"), "floor")
    one = plan.naive(days, cfg).join(floors, ["series", "origin_date"])
    two = plan.naive(days, cfg, 7).where("predicted is not null")
    return models.ensemble(one, two, cfg).select("origin_date", "horizon", _r("predicted").alias("predicted"))


@query(
    f"WITH {_DAYS}, {_AHEAD}, {_OWX}, r AS (SELECT actual - predicted AS residual, greatest(10 - t_mean, 0) AS cold, greatest(t_mean - 10, 0) AS hot, CAST(h AS DOUBLE) AS h FROM ahead JOIN owx ON date = forecast_date WHERE t_mean IS NOT NULL),"
    " u AS (SELECT 'wx_coldness' AS variable, cold AS x, residual AS y FROM r UNION ALL SELECT 'wx_hotness', hot, residual FROM r UNION ALL SELECT 'horizon', h, residual FROM r), k AS (SELECT variable, corr(x, y) AS r, count(*) AS n FROM u GROUP BY 1)"
    " SELECT variable, n, round(r, 6) AS r, abs(r * sqrt((n - 2) / (1 - r * r))) > 1.9605 AS significant FROM k"
)
def residual_p_values(spark, sf_dir):
    """Whether residuals go with a variable at the 5 % level; the SQL has the t of that level for many rows instead of p.

    Where t is NaN (a variable of equal values) there is no p; the flag is true there, as the SQL has a NaN above every number.
    """
    rows = evaluate.with_weather(plan.naive(order_days(spark, sf_dir), ForecastConfig()), _order_weather(spark, sf_dir))
    rows = rows.where("t_mean is not null").select("residual", F.col("horizon").cast("double").alias("horizon"), *sc.residual_terms(F.col("t_mean")))
    out = evaluate.significance(evaluate.correlations(rows, ["wx_coldness", "wx_hotness", "horizon"]))
    return out.select("variable", "n", _r("r").alias("r"), (F.isnan("t") | F.col("significant")).alias("significant"))


# Days not seen yet, and the weather that an origin knows of each horizon.

_SPINE = (
    f"WITH {_DAYS}, n AS (SELECT max(d) AS last FROM days), s AS (SELECT d, y FROM idx WHERE row_idx >= 7 UNION ALL SELECT CAST(last + CAST(k AS INT) AS DATE), NULL FROM n, range(1, 11) r(k))"
    " SELECT d, round(y, 6) AS y, y IS NULL AS to_come, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS row_idx, CAST(isodow(d) = 1 AS DOUBLE) AS dow_0, CAST(isodow(d) = 6 AS DOUBLE) AS dow_5, round(sin(2 * pi() * dayofyear(d) / 365.25), 6) AS sin_1, round(cos(4 * pi() * dayofyear(d) / 365.25), 6) AS cos_2 FROM s"
)


@query(_SPINE)
def future_spine(spark, sf_dir):
    """The rows that models are given, the days to come with them, and their calendar."""
    at = lambda n: F.col("cal")[plan.CALENDAR.index(n)]
    m = plan.matrix(order_days(spark, sf_dir), ahead=10)
    return m.select("d", _r("y").alias("y"), F.col("op").isNull().alias("to_come"), "row_idx", at("dow_0").alias("dow_0"), at("dow_5").alias("dow_5"), _r(at("sin_1")).alias("sin_1"), _r(at("cos_2")).alias("cos_2"))


@query(
    f"WITH {_DAYS}, l AS (SELECT d, y, row_idx, lag(y, 3) OVER (ORDER BY row_idx) AS y0, avg(y) OVER (ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS mean7,"
    " stddev_samp(y) OVER (ORDER BY row_idx ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS sd7, avg(y) OVER (ORDER BY row_idx ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) AS mean7_3 FROM idx)"
    " SELECT d, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("y0", "mean7", "sd7", "mean7_3")) + ", round(y0, 6) AS lag3 FROM l WHERE row_idx >= 9"
)
def lagged_own_columns(spark, sf_dir):
    """The target's own columns where the last three days aren't reported yet."""
    m = plan.matrix(order_days(spark, sf_dir), lag=3)
    return m.select("d", *(_r(F.col("op")[i]).alias(c) for i, c in enumerate(plan.OWN)))


def _error_days(spark, sf_dir):
    e = event_observations(spark, sf_dir).where("metric = 'error'")
    return daily.cleaned(e).groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("y")).select(F.lit("error").alias("series"), "d", "y")


@query(
    _WX + _FC + f", e AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS y FROM good WHERE metric = 'error' GROUP BY 1), i AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM e),"
    " m AS (SELECT i.d, h, t.d AS forecast_date FROM i, (VALUES (1), (7), (10)) v(h), i t WHERE i.r >= 7 AND t.r = i.r + h),"
    f" v AS (SELECT d, h, forecast_date, {_AT.format(k=0)} AS a0, {_AT.format(k=1)} AS a1, {_AT.format(k=2)} AS a2 FROM m o)"
    " SELECT d AS origin_date, CAST(h AS INT) AS horizon, forecast_date, round(coalesce(a0, 0), 6) AS wx, round(coalesce(list_avg(list_filter([a0, a1, a2], lambda x: x IS NOT NULL)), 0), 6) AS wx_mean3 FROM v"
)
def weather_model_inputs(spark, sf_dir):
    """The weather columns of the models at horizons 1, 7 and 10: forecast over actual, and three-day means."""
    wx, fc, _ = _forecast_weather(spark, sf_dir)
    m = plan.with_weather(plan.matrix(_error_days(spark, sf_dir)), wx, fc, ["click"], ["click"])
    rows = plan.model_inputs(m).where(F.col("horizon").isin(1, 7, 10))
    n = len(plan.CALENDAR)
    return rows.select("origin_date", "horizon", "forecast_date", _r(F.col("later")[n]).alias("wx"), _r(F.col("later")[n + 1]).alias("wx_mean3"))


# Models.

_CFG = ForecastConfig(cap=None)


@query()
def elastic_net_rolling(spark, sf_dir):
    return models.clipped(models.rolling_forecast(plan.matrix(order_days(spark, sf_dir)), _CFG), _CFG)


@query()
def elastic_net_rolling_series(spark, sf_dir):
    """The rolling model for each of five series at once."""
    return models.clipped(models.rolling_forecast(plan.matrix(priority_days(spark, sf_dir)), _CFG), _CFG)


@query()
def elastic_net_selection(spark, sf_dir):
    return models.selection_counts(plan.matrix(order_days(spark, sf_dir)), plan.NAMES, _CFG)


@query()
def elastic_net_global(spark, sf_dir):
    return models.global_models(plan.matrix(order_days(spark, sf_dir)), _CFG)


@query()
def ensemble_forecast(spark, sf_dir):
    return plan.numbered_forecast(plan.matrix(order_days(spark, sf_dir)), _CFG)


@query()
def future_forecast(spark, sf_dir):
    """The ensemble's forecasts of the ten days after the last one, from every origin that reaches them, for each of five series."""
    return plan.future(plan.matrix(priority_days(spark, sf_dir), ahead=10), _CFG)


@query()
def weather_ensemble(spark, sf_dir):
    """The ensemble with the weather that each origin knows of its horizons, forecasts of lead days made of orders."""
    days = order_days(spark, sf_dir)
    actual = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg(F.col("o_custkey") % 45) - 8).alias("t"))
    ahead = actual.withColumn("lead_day", F.explode(F.sequence(F.lit(1), F.lit(7)))).where((F.dayofyear("date") + F.col("lead_day")) % 3 != 0).withColumn("t", F.col("t") + F.col("lead_day") / 10)
    return plan.numbered_forecast(plan.with_weather(plan.matrix(days), actual, ahead, ["t"], ["t"]), _CFG)


@query()
def ensemble_as_known(spark, sf_dir):
    """The ensemble from order values by priority, gaps filled and skewness corrected as each origin knows them; global models learn to 2000-09-30."""
    rows = order_observations(spark, sf_dir).groupBy("series", "d", F.col("metric").alias("col_key")).agg(F.avg("value").alias("value"))
    dictionary = features.predictors(daily.feature_names(rows, "col_key", "series"), plan.CALENDAR)
    return plan.numbered_forecast(plan.wide_matrix(rows, _gapped_target(spark, sf_dir), dictionary, as_known=True), _CFG, "2000-09-30")


@query()
def partial_rolling(spark, sf_dir):
    """The rolling model with an unpenalised calendar."""
    return models.clipped(models.rolling_forecast(plan.matrix(order_days(spark, sf_dir)), _CFG, partial=True), _CFG)


@query()
def baseline_forecast(spark, sf_dir):
    """The baseline: every column at the origin, each tenth window as that method does, nothing clipped."""
    return models.rolling_forecast(plan.matrix(order_days(spark, sf_dir)), _CFG, calendar_at_target=False, stride=10)


@query()
def kalman_imputation(spark, sf_dir):
    """Daily order values by priority and segment, the days without one filled by the state-space smoother."""
    rows = order_observations(spark, sf_dir).groupBy("series", "d", "metric", "site").agg(F.avg("value").alias("value"))
    grid = rows.select("series", "d").distinct().join(rows.select("series", "metric", "site").distinct(), "series")
    grid = grid.join(rows, ["series", "d", "metric", "site"], "left").withColumn("imputed", F.col("value").isNull())
    return kalman.imputed(grid, "value", "metric", "site", order="d").select("d", "metric", "site", "value", "imputed")


@query()
def same_day_baseline(spark, sf_dir):
    """The original baseline from order values by priority: Kalman imputation, ten random folds, one model a window, every window."""
    obs = order_observations(spark, sf_dir)
    rows = obs.groupBy("series", "d", F.col("metric").alias("col_key")).agg(F.avg("value").alias("value"))
    dictionary = features.predictors(daily.feature_names(rows, "col_key", "series"), [])
    return plan.same_day_baseline(rows, _gapped_target(spark, sf_dir), dictionary, _CFG)


@query()
def window_sweep(spark, sf_dir):
    """Errors by horizon for training windows of 70, 90, 110 and 130 rows, from every origin."""
    windows = [70, 90, 110, 130]
    return evaluate.horizon_by_window(models.window_sweep(plan.matrix(order_days(spark, sf_dir)), _CFG, windows), windows)


@query()
def holdout_errors(spark, sf_dir):
    return plan.holdout(plan.matrix(order_days(spark, sf_dir)), _CFG, "2000-09-30")


def _wide_model(spark, sf_dir):
    rows, target, dictionary = _wide(spark, sf_dir)
    names = [r.predictor for r in dictionary.orderBy(F.desc("penalised"), "ordinal").select("predictor").collect()]
    return plan.wide_matrix(rows, target, dictionary), dictionary, names


@query()
def wide_selection(spark, sf_dir):
    """Selection from the wide features: counts over all windows and horizons, seeds, expansion, in order."""
    m, dictionary, names = _wide_model(spark, sf_dir)
    return models.seed_and_expand(models.selection_counts(m, names, _CFG), dictionary, _CFG, ("mean7_3",)).orderBy("forced", "rank")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rolling forecasts of the daily order value."""
    return elastic_net_rolling(spark, sf_dir)
