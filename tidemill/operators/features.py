"""Windows over a series' rows: positions, imputation, rolling and lagged terms, floors, targets ahead.

Every window is partitioned by series (and feature), so series spread over tasks. Offsets count rows, not days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import skew_transform


def with_row_index(df: DataFrame, *keys: str, order: str = "d") -> DataFrame:
    return df.withColumn("row_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def neighbours(df: DataFrame, value: str, *keys: str, order: str = "row_idx") -> DataFrame:
    """df with _b and _a, the nearest rows with a value at or before each row and at or after it, as structs (i, v)."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.select("*", before.alias("_b"), after.alias("_a"))


def on_line(order: str = "row_idx", until: str | None = None) -> Column:
    """The value between the ``neighbours`` of a row, at an edge that of the nearest.

    until: the column of the last row that may be known; a neighbour beyond it counts as not there.
    """
    after = F.col("_a") if until is None else F.when(F.col("_a.i") <= F.col(until), F.col("_a"))
    b, ai, av = F.col("_b"), after.getField("i"), after.getField("v")
    line = b["v"] + (av - b["v"]) * (F.col(order) - b["i"]) / (ai - b["i"])
    return F.when(b.isNull(), av).when(after.isNull(), b["v"]).when(ai == b["i"], av).otherwise(line)


def interpolated(df: DataFrame, value: str, *keys: str, order: str = "row_idx") -> DataFrame:
    """value with gaps filled on a line between the nearest rows that have one, edges with the nearest."""
    return neighbours(df, value, *keys, order=order).withColumn(value, on_line(order)).drop("_a", "_b")


def carried(df: DataFrame, value: str, *keys: str, order: str = "row_idx") -> DataFrame:
    """value with gaps filled by the last value before; null before the first. A row's value never rests on later rows."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(before))


def _full(f: Column, value: str, w, n: int) -> Column:
    """f over w, or null where fewer than n rows have a value."""
    return F.when(F.count(value).over(w) == n, f.over(w))


def rolling(df: DataFrame, value: str, *keys: str, width: int = 7, order: str = "row_idx") -> DataFrame:
    """mean and sample deviation over the last ``width`` rows, lag 3, and the mean of lags 3 to 7."""
    base = Window.partitionBy(*keys).orderBy(order)
    w, late = base.rowsBetween(1 - width, 0), base.rowsBetween(-7, -3)
    return df.select(
        "*",
        _full(F.avg(value), value, w, width).alias(f"mean{width}"),
        _full(F.stddev_samp(value), value, w, width).alias(f"sd{width}"),
        F.lag(value, 3).over(base).alias("lag3"),
        _full(F.avg(value), value, late, 5).alias("mean7_3"),
    )


def trailing_floor(df: DataFrame, value: str, *keys: str, lookback: int = 90, q: float = 0.05, order: str = "row_idx", late: int = 3) -> DataFrame:
    """The interpolated q-quantile of the ``lookback`` rows that end ``late`` before each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - lookback - late, -late)
    return df.withColumn("floor", F.expr(f"percentile({value}, {q})").over(w))


def targets_ahead(df: DataFrame, value: str, *keys: str, horizon: int = 10, order: str = "row_idx", others: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row and horizon whose target row exists: h, target, target_date, and target_x of each x of others."""
    base = Window.partitionBy(*keys).orderBy(order)
    taken = {"target": value, "target_date": "d", **{f"target_{c}": c for c in others}}
    ahead = [F.struct(F.lit(h).alias("h"), *(F.lead(c, h).over(base).alias(n) for n, c in taken.items())) for h in range(1, horizon + 1)]
    rows = df.select("*", F.array(*ahead).alias("_ahead"))
    return rows.select(*df.columns, F.inline("_ahead")).where("target_date is not null")


def with_future(rows: DataFrame, ahead: int, *keys: str) -> DataFrame:
    """rows with ``ahead`` more for each of keys: the calendar days after its last one, all other columns null."""
    last = rows.groupBy(*keys).agg(F.max("d").alias("_last"))
    days = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("_k"), "_last").select(*keys, F.date_add("_last", F.col("_k")).alias("d"))
    return rows.unionByName(days, allowMissingColumns=True)


def training_windows(df: DataFrame, *keys: str, window: int = 90, horizon: int = 10, stride: int = 14) -> DataFrame:
    """Each window's rows: window_start beside the row, for starts 0, stride, ... while window and horizon fit.

    A row names the windows it belongs to, so the range join needs no join at all.
    """
    last = F.max("row_idx").over(Window.partitionBy(*keys)) + 1 - (window + horizon)
    low = F.greatest(F.ceil((F.col("row_idx") - (window - 1)) / stride), F.lit(0)).cast("int")
    high = F.floor(F.least(F.col("row_idx"), F.col("_last")) / stride).cast("int")
    rows = df.withColumn("_last", last).where("_last >= 0").withColumn("_lo", low).withColumn("_hi", high).where("_hi >= _lo")
    starts = F.transform(F.sequence("_lo", "_hi"), lambda k: k * stride)
    return rows.select(*df.columns, F.explode(starts).alias("window_start"))


def skew_corrected(daily: DataFrame, *keys: str, value: str = "value", sample: bool = False) -> DataFrame:
    """Values transformed by the skewness and minimum of their own feature; (keys, d, value).

    sample: the skewness over the sample variance (that of n rows shrinks by ((n - 1) / n) ** 1.5).
    """
    skew = F.skewness(value)
    if sample:
        skew = skew * F.pow((F.count(value) - 1) / F.count(value), F.lit(1.5))
    stats = daily.groupBy(*keys).agg(skew.alias("skew"), F.min(value).alias("low"))
    return daily.join(stats, list(keys)).withColumn(value, skew_transform(F.col(value), F.col("skew"), F.col("low")))


def so_far(df: DataFrame, value: str, *keys: str, order: str = "row_idx") -> DataFrame:
    """df with n, skew and low of value over its feature's rows up to each row: statistics that don't look ahead.

    Moments of a prefix follow from those of the prefix before, so one pass over a feature's rows gives all of them.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.count(value).over(w).alias("n"), F.skewness(value).over(w).alias("skew"), F.min(value).over(w).alias("low"))


def windows_so_far(df: DataFrame, value: str, *keys: str, window: int = 90, horizon: int = 10, stride: int = 14) -> DataFrame:
    """``training_windows`` with value filled and transformed as its window's last row knows it; (keys, d, row_idx, window_start, value).

    df (keys, d, row_idx, value) has gaps. What is imputed at a window's end rests on rows up to it: a gap that is still
    open there keeps its last value, and one before the first value that the window knows stays null. Skewness and
    minimum are those of the feature's values, not filled, from its first row to the window's end; so a window never
    changes when rows are added, unlike with ``interpolated`` and ``skew_corrected``, which follow the published method.
    """
    known = so_far(neighbours(df, value, *keys), value, *keys)
    spread = training_windows(known, *keys, window=window, horizon=horizon, stride=stride).withColumn("_end", F.col("window_start") + window - 1)
    # A window's last row has the statistics for all its rows.
    last = Window.partitionBy(*keys, "window_start").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at_end = spread.select("*", F.last("skew").over(last).alias("_skew"), F.last("low").over(last).alias("_low"))
    return at_end.select(*keys, "d", "row_idx", "window_start", skew_transform(on_line(until="_end"), F.col("_skew"), F.col("_low")).alias(value))


def predictors(names: DataFrame, calendar: list[str]) -> DataFrame:
    """The feature dictionary (series, ordinal, predictor, metric, kind, col_key, base, variant, penalised).

    names: (series, ordinal, col_key, feature) of ``daily.feature_names``. First come the features, then their rolling
    terms, two each, then the target's own lags; calendar columns have ordinals of their own. base is the ordinal of
    the feature that a term is made of (-1 for the target's), variant what it is, and only kind "op" is penalised.
    """
    each = Window.partitionBy("series")
    base = names.select("series", "col_key", "feature", F.col("ordinal").alias("base"), F.count("*").over(each).alias("n"), F.substring_index("col_key", "|", 1).alias("metric"))

    def term(ordinal: Column, predictor: Column, metric: Column, key: Column, of: Column, variant: str, kind: str = "op") -> Column:
        fields = {"ordinal": ordinal.cast("int"), "predictor": predictor, "metric": metric, "kind": F.lit(kind), "col_key": key.cast("string"), "base": of.cast("int"), "variant": F.lit(variant)}
        return F.struct(*(c.alias(name) for name, c in fields.items()))

    own = [F.col(c) for c in ("metric", "col_key", "base")]
    terms = [
        term(F.col("base"), F.col("feature"), *own, "value"),
        term(F.col("n") + 2 * F.col("base"), F.concat("feature", F.lit("_roll_mean7")), *own, "roll_mean7"),
        term(F.col("n") + 2 * F.col("base") + 1, F.concat("feature", F.lit("_roll_sd7")), *own, "roll_sd7"),
    ]
    none = [F.lit(None), F.lit(-1)]
    once = [term(3 * F.col("n") + i, F.lit(name), F.lit("target"), *none, name) for i, name in enumerate(("lag3", "mean7_3"))]
    once += [term(F.lit(i), F.lit(name), F.lit(name), *none, name, "weather" if name.startswith("wx_") else "calendar") for i, name in enumerate(calendar)]
    # What a series has once stands beside its first feature.
    rows = base.select("series", F.inline(F.when(F.col("base") == 0, F.array(*terms, *once)).otherwise(F.array(*terms))))
    return rows.withColumn("penalised", F.col("kind") == "op")


def complete_days(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, d, ordinal, value) of the days that have every predictor; one without any value is no predictor."""
    used = rows.groupBy(*keys, "ordinal").agg(F.count("value").alias("_k")).where("_k > 0").groupBy(*keys).agg(F.count("*").alias("_n"))
    have = rows.where("value is not null")
    full = have.groupBy(*keys, "d").agg(F.count("*").alias("_m")).join(used, list(keys)).where("_m = _n").select(*keys, "d")
    return have.join(full, [*keys, "d"], "left_semi")


def as_vectors(rows: DataFrame, *keys: str, others: tuple[str, ...] = ()) -> DataFrame:
    """(keys, d, features array<double>) of rows (keys, d, ordinal, value), in the order of the ordinals; others likewise."""
    out = rows.groupBy(*keys, "d").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value", *others))).alias("x"))
    return out.select(*keys, "d", F.col("x.value").alias("features"), *(F.col(f"x.{c}").alias(c) for c in others))
