"""Column expressions: noon days, calendar and seasonal terms, clips, names, weather derivations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = -9999.0


def valid(value: Column) -> Column:
    """True but for the sentinel; missing values pass, as a day of missing readings still is a day."""
    return ~value.eqNullSafe(F.lit(SENTINEL))


def no_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def noon_day(ts: Column) -> Column:
    """The day a reading belongs to: today up to 12:00:00, tomorrow after."""
    return F.to_date(F.date_trunc("second", ts) + F.expr("INTERVAL 43199 SECONDS"))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clip(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds that leave missing values missing."""
    v = no_nan(value)
    out = v
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(v.isNotNull(), out)


def weekday_dummies(d: Column) -> list[Column]:
    """Monday to Saturday as 0/1; Sunday is the base."""
    return [(F.weekday(d) == i).cast("double").alias(f"dow_{i}") for i in range(6)]


def fourier(d: Column, harmonics: int = 2, period: float = 365.25) -> list[Column]:
    angle = lambda k: F.lit(2.0 * math.pi * k) * F.dayofyear(d) / F.lit(period)
    return [f(angle(k)).alias(f"{n}_{k}") for k in range(1, harmonics + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]


def clean_name(name: Column) -> Column:
    """A column name: digits and brackets dropped, separators to _, % to pct, other signs dropped, lower case."""
    out = F.regexp_replace(name, r"[0-9()]", "")
    out = F.regexp_replace(out, r"[ \-|]", "_")
    out = F.regexp_replace(out, "%", "pct")
    out = F.lower(F.regexp_replace(out, r"[^A-Za-z_]", ""))
    return F.regexp_replace(out, r"^_+|_+$", "")


def skew_transform(value: Column, skew: Column, low: Column) -> Column:
    """log1p or square root of a right-skewed value, square of a left-skewed one, by the series' own statistics."""
    skew = no_nan(skew)
    return (
        F.when((skew > 1) & (low > 0), F.log1p(value))
        .when(skew > 1, F.sqrt(value - low + 1))
        .when(skew < -1, value * value)
        .otherwise(value)
    )


def known_transform(values: Column, skew: Column, low: Column) -> Column:
    """skew_transform for arrays, by statistics of earlier rows: a value under their minimum counts as it where that matters."""
    rows = F.arrays_zip(values.alias("v"), skew.alias("skew"), low.alias("low"))

    def one(x: Column) -> Column:
        v = F.when(no_nan(x["skew"]) > 1, F.greatest(x["v"], x["low"])).otherwise(x["v"])
        return skew_transform(v, x["skew"], x["low"])

    return F.transform(rows, one)


def weather_terms(
    t_mean: Column, t_min: Column, rain: Column, snow: Column, wind: Column, cold: float = 10, colder: float = 5, hot: float = 25, rain_cap: float = 25, wind_cap: float = 42, heavy: float = 20
) -> list[Column]:
    """Derived daily weather; comparisons with missing values are 0."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        clip(F.lit(cold) - t_mean, 0.0).alias("wx_coldness"),
        clip(t_mean - F.lit(hot), 0.0).alias("wx_hotness"),
        clip(F.lit(colder) - t_mean, 0.0).alias("wx_coldness2"),
        flag(t_min < 0).alias("wx_below_freezing"),
        clip(rain, None, rain_cap).alias("wx_rain_sum"),
        flag(rain > heavy).alias("wx_heavy_rain"),
        no_nan(snow).alias("wx_snowfall_sum"),
        clip(wind, None, wind_cap).alias("wx_wind_max"),
    ]


def residual_terms(t_mean: Column, cold: float = 10, colder: float = 5, hot: float = 10, hotter: float = 25) -> list[Column]:
    """The residual analysis' own temperature terms: two kinks on either side."""
    return [
        clip(F.lit(cold) - t_mean, 0.0).alias("wx_coldness"),
        clip(t_mean - F.lit(hot), 0.0).alias("wx_hotness"),
        clip(F.lit(colder) - t_mean, 0.0).alias("wx_coldness2"),
        clip(t_mean - F.lit(hotter), 0.0).alias("wx_hotness2"),
    ]


def dot(values: Column, weights: Column, intercept: Column) -> Column:
    """Inner product of two arrays plus an intercept."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + intercept
