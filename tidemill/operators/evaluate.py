"""Errors, coefficient tables, residuals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def square() -> Column:
    return F.pow(F.col("actual") - F.col("predicted"), 2)


def mse_bands(detail: DataFrame, *keys: str) -> DataFrame:
    """Mean squared error of horizons 1-5 and 6-10 of each forecast; missing pairs are ignored."""
    return detail.groupBy(*keys, "forecast_id", "origin_date").agg(
        F.avg(F.when(F.col("horizon") <= 5, square())).alias("mse_1_5"), F.avg(F.when(F.col("horizon") > 5, square())).alias("mse_6_10")
    )


def overall(bands: DataFrame, *keys: str) -> DataFrame:
    return bands.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("mse_1_5", "mse_6_10") for n, f in (("mean", F.avg), ("median", F.median))))


def horizon_by_window(detail: DataFrame, windows: list[int]) -> DataFrame:
    """Mean squared error by horizon, one column for each training window."""
    out = detail.groupBy("horizon").pivot("train_win", windows).agg(F.avg(square()))
    return out.withColumnsRenamed({str(w): f"w{w}" for w in windows})


def since(rows: DataFrame, start: str, inclusive: bool = True) -> DataFrame:
    """rows whose origin is on or after a day, or after it: the holdout."""
    day = F.lit(start).cast("date")
    return rows.where(F.col("origin_date") >= day if inclusive else F.col("origin_date") > day)


def compare(bands: DataFrame, other: DataFrame | None, name: str = "own", other_name: str = "other") -> DataFrame:
    """Mean and median errors of two models over the origins that both have, a row each; of one where the other isn't there."""
    if other is None:
        return overall(bands).withColumn("model", F.lit(name))
    mine, theirs = (a.join(b.select("origin_date").distinct(), "origin_date", "left_semi") for a, b in ((bands, other), (other, bands)))
    return overall(mine).withColumn("model", F.lit(name)).unionByName(overall(theirs).withColumn("model", F.lit(other_name)))


def with_weather(detail: DataFrame, weather: DataFrame) -> DataFrame:
    """detail with the weather (date, ...) of its forecast date and the residual."""
    w = weather.withColumnRenamed("date", "_date")
    return detail.join(w, detail.forecast_date == w["_date"], "left").drop("_date").withColumn("residual", F.col("actual") - F.col("predicted"))


def nonzero_per_window(coefficients: DataFrame, *keys: str) -> DataFrame:
    """Weights that aren't 0 for each forecast, on average."""
    return coefficients.groupBy(*keys).agg((F.count("*") / F.countDistinct("forecast_id")).alias("per_window"))


def by_magnitude(table: DataFrame) -> DataFrame:
    """A coefficient table with ``rank``, the largest mean magnitude first, and in that order; one row a predictor."""
    order = Window.orderBy(F.desc("mean_abs"), "predictor")
    return table.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def t_probability(t: float, df: float) -> float:
    """The two-sided probability of a t as large, by the incomplete beta function's continued fraction."""
    if t is None or df <= 0 or math.isnan(t):
        return math.nan
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), 1e-300)
    out = d
    for m in range(1, 300):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def significance(correlated: DataFrame, level: float = 0.05) -> DataFrame:
    """rows of ``correlations`` with p (two-sided) and whether it is under ``level``, both null where t is NaN; a row a variable."""
    p = F.pandas_udf(lambda t, n: pd.Series([t_probability(a, b - 2) for a, b in zip(t, n)]), "double")
    return correlated.withColumn("p", p("t", "n")).withColumn("significant", F.col("p") < level)


def forecast_ids(detail: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """1-based forecast_id over origins by date; the origins are a short list beside the detail.

    origins (origin_date, ...): those that detail has, where they are known without it; detail is then worked out once.
    """
    ids = (detail if origins is None else origins).select("origin_date").distinct().withColumn("forecast_id", F.row_number().over(Window.orderBy("origin_date")))
    return detail.drop("forecast_id").join(ids, "origin_date")


def coefficient_table(coefficients: DataFrame, horizon: int = 10) -> DataFrame:
    """Predictors by horizon (h1 .. h10, missing 0) with their mean magnitude; a repeated pair raises."""
    rows = coefficients.groupBy("predictor", "horizon").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("repeated predictor and horizon"))).otherwise(F.first("coefficient")).alias("c"))
    hs = list(range(1, horizon + 1))
    wide = rows.groupBy("predictor").pivot("horizon", hs).agg(F.first("c")).na.fill(0.0).withColumnsRenamed({str(h): f"h{h}" for h in hs})
    return wide.withColumn("mean_abs", sum((F.abs(f"h{h}") for h in hs), F.lit(0.0)) / horizon)


def forecast_series(detail: DataFrame) -> DataFrame:
    """Long form for charts: the actual once, each model's prediction as a series, in declared order."""
    actual = detail.groupBy(F.col("forecast_date").alias("date")).agg(F.first("actual").alias("value")).select("date", F.lit("Actual").alias("label"), "value", F.lit(0).alias("ordinal"))
    return actual.unionByName(detail.select(F.col("forecast_date").alias("date"), F.concat(F.lit("h"), F.col("horizon").cast("string")).alias("label"), F.col("predicted").alias("value"), F.col("horizon").alias("ordinal")))


def rolling_by_x(rows: DataFrame, x: str, y: str, *keys: str, tiebreak: str) -> DataFrame:
    """Mean of y over the last max(20, n // 8) rows in order of x, full windows only, if x has over 5 values."""
    n = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    size = n.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(x).alias("_k")).where("_k > 5").withColumn("_w", F.greatest(F.lit(20), F.floor(F.col("_n") / 8)))
    w = Window.partitionBy(*keys).orderBy(x, tiebreak)
    r = n.join(size, list(keys)).withColumn("_i", F.row_number().over(w)).withColumn("_s", F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = r.select(*keys, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_s").alias("_t"))
    joined = r.join(back, [*keys, "_i"], "left").where(F.col("_i") >= F.col("_w"))
    return joined.withColumn("trend", (F.col("_s") - F.coalesce("_t", F.lit(0.0))) / F.col("_w")).select(*keys, x, tiebreak, "trend")


def correlations(rows: DataFrame, variables: list[str], y: str = "residual") -> DataFrame:
    """Pearson r, n and t of each variable with y, pairs with a missing side left out.

    Equal values on either side have no correlation: r and t are NaN. A perfect one of over two pairs has an infinite t.
    """
    stack = F.expr("stack(" + str(len(variables)) + ", " + ", ".join(f"'{v}', cast({v} as double)" for v in variables) + ") as (variable, x)")
    pairs = rows.select(stack, F.col(y).alias("y")).where("x is not null and y is not null")
    both = F.stddev_pop("x") * F.stddev_pop("y")  # F.corr divides by it, which fails at 0
    r = F.when(both > 0, F.least(F.greatest(F.covar_pop("x", "y") / both, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(math.nan))
    out = pairs.groupBy("variable").agg(r.alias("r"), F.count("*").alias("n"))
    rest = 1 - F.col("r") * F.col("r")
    return out.withColumn("t", F.when(rest != 0, F.col("r") * F.sqrt((F.col("n") - 2) / rest)).when(F.col("n") > 2, F.col("r") * math.inf).otherwise(F.lit(math.nan)))
