"""Kalman imputation, the same-day baseline and statistics that don't look ahead, against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.config import ForecastConfig
from tidemill.operators import features, kalman, models
from tidemill.operators.elastic_net import fit_scaled
from test_models import slow_enet

START = dt.date(2020, 1, 1)


def dense(y, variances, diffuse):
    """(levels given the known values, deviance) from the joint Gaussian of all disturbances, diffuse start included."""
    noise, level, slope = variances
    n = len(y)
    cov = np.diag([diffuse, diffuse] + [level, slope] * n)
    state, rows = np.hstack([np.eye(2), np.zeros((2, 2 * n))]), []
    for t in range(n):
        rows.append(state[0])
        state = np.array([[1.0, 1.0], [0.0, 1.0]]) @ state
        state[0, 2 + 2 * t] += 1
        state[1, 3 + 2 * t] += 1
    joint = np.array(rows) @ cov @ np.array(rows).T
    ok = ~np.isnan(y)
    g, r = joint[np.ix_(ok, ok)] + noise * np.eye(ok.sum()), y[ok] - y[ok][0]
    return y[ok][0] + joint[:, ok] @ np.linalg.solve(g, r), np.linalg.slogdet(g)[1] + r @ np.linalg.solve(g, r)


def gappy(seed, n=40):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.standard_normal(n)) + rng.standard_normal(n)
    y[rng.random(n) < 0.3] = np.nan
    return (y - np.nanmean(y)) / np.nanstd(y)


@pytest.mark.parametrize("seed", range(4))
def test_smoother_and_deviance_equal_the_dense_gaussian(seed):
    y = gappy(seed)
    for variances in ([0.3, 0.1, 0.01], [0.5, 1e-8, 1e-4], [1e-6, 0.4, 1e-8]):
        mean, deviance = dense(y, variances, kalman.DIFFUSE)
        assert np.allclose(kalman.smoothed(y, np.array(variances)), mean, atol=1e-4)
        assert np.isclose(kalman.deviance(y, np.array([variances]))[0], deviance, atol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_fit_is_not_beaten_by_other_variances(seed):
    y = gappy(seed)
    best = kalman.deviance(y, kalman.fit(y)[None])[0]
    others = 10 ** np.random.default_rng(seed).uniform(kalman.LOW, kalman.HIGH, (3000, 3))
    assert best <= kalman.deviance(y, others).min() + 0.01


def test_imputed_series(spark):
    line = [float(i) if i not in (3, 4, 9) else None for i in range(10)]
    rows = [("line", i, v, "x") for i, v in enumerate(line)]
    rows += [("few", 0, None, "x"), ("few", 1, 2.0, "x"), ("few", 2, 5.0, None)]
    rows += [("same", i, None if i == 0 else 7.0, "x") for i in range(5)]
    rows += [("whole", i, float(i * i), "x") for i in range(4)] + [("nan", i, float("nan") if i == 2 else 1.0 + i, "x") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, row_idx int, value double, _v string")
    df = df.withColumnRenamed("_v", "other")
    out = kalman.imputed(df, "value", "k")
    assert out.columns == df.columns
    got = {(r.k, r.row_idx): r for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(10):
        assert abs(got["line", i].value - i) < 1e-3
    assert got["few", 0].value is None and got["few", 1].value == 2.0 and got["few", 2].other is None
    assert got["same", 0].value == 7.0 and got["whole", 3].value == 9.0
    assert abs(got["nan", 2].value - 3.0) < 1e-3
    assert kalman.imputed(df.limit(0), "value", "k").count() == 0


def plain_scaled(x, y, fold, rho, n_alphas):
    """One problem at a time by proximal gradient, in the units of each fit's own deviations."""
    def at(x, y, a):
        sd = x.std(axis=0)
        sd = np.where(sd > 0, sd, 1)
        b, _ = slow_enet(x / sd, y / y.std(), a / y.std(), rho)
        b = b / sd * y.std()
        return b, y.mean() - x.mean(axis=0) @ b

    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    grid = np.abs(z.T @ (y - y.mean())).max() / len(y) / rho * np.logspace(0, -4, n_alphas)
    error = np.zeros(n_alphas)
    for k in set(fold):
        for i, a in enumerate(grid):
            b, c = at(x[fold != k], y[fold != k], a)
            error[i] += ((y[fold == k] - x[fold == k] @ b - c) ** 2).sum()
    a = grid[error.argmin()]
    return (*at(x, y, a), a)


def problem(seed, n=60, p=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) * rng.uniform(0.5, 4, p)
    return x, 3 + x @ (rng.standard_normal(p) * (rng.random(p) < 0.6)) + 2 * rng.standard_normal(n), rng.permutation(n) % 10


def test_scaled_fits_against_plain_solver():
    made = [problem(s) for s in range(3)]
    fits = fit_scaled([(x, y) for x, y, _ in made], [f for *_, f in made], 0.5, 8)
    for (x, y, fold), (coef, intercept, alpha) in zip(made, fits):
        b, c, a = plain_scaled(x, y, fold, 0.5, 8)
        assert np.isclose(alpha, a) and np.allclose(coef, b, atol=1e-5) and np.isclose(intercept, c, atol=1e-5)


def test_scaled_fit_of_a_constant():
    x, _, fold = problem(0)
    ((coef, intercept, _),) = fit_scaled([(x, np.full(60, 4.0))], [fold], 0.5, 8)
    assert not coef.any() and intercept == 4.0


def same_day(spark, n=75, series=("a", "b"), parts=1):
    rows = []
    for s, name in enumerate(series):
        x, y, _ = problem(s, n)
        x[:, 2] = 1.5  # never varies
        rows += [(name, START + dt.timedelta(days=i), float(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "series string, d date, y double, op array<double>").repartition(parts)


def test_same_day_forecast(spark):
    cfg = ForecastConfig(train_window=40, horizon=3, n_alphas=8)
    keys = ["series", "origin_date", "horizon"]
    out = models.same_day_forecast(same_day(spark), cfg).toPandas().sort_values(keys, ignore_index=True)
    assert len(out) == 2 * 3 * (75 - 40 - 3 + 1)
    again = models.same_day_forecast(same_day(spark, parts=7), cfg).toPandas().sort_values(keys, ignore_index=True)
    assert np.allclose(out.predicted, again.predicted)
    other = models.same_day_forecast(same_day(spark), cfg, seed=5).toPandas()
    assert len(other) == len(out)
    data = same_day(spark).select("*", F.xxhash64(F.lit(123), "series", "d").alias("key")).where("series = 'b'").orderBy("d").toPandas()
    x, y = np.array(data.op.tolist()), data.y.to_numpy()
    for origin in (39, 50, 71):
        window = slice(origin - 39, origin + 1)
        fold = np.empty(40, int)
        fold[np.argsort(data.key[window].to_numpy())] = np.arange(40) % 10
        b, c, a = plain_scaled(x[window], y[window], fold, 0.5, 8)
        mine = out[(out.series == "b") & (out.origin_date == data.d[origin])]
        assert np.allclose(mine.predicted, x[origin + 1 : origin + 4] @ b + c, atol=1e-5)  # the columns of the days themselves
        assert np.allclose(mine.actual, y[origin + 1 : origin + 4]) and np.allclose(mine.alpha, a)
        assert mine.coef.iloc[0][2] == 0.0 and np.allclose(mine.coef.iloc[0], b * x[window].std(axis=0, ddof=1), atol=1e-5)


def test_same_day_leaves_out_rows_without_y_and_steps(spark):
    cfg = ForecastConfig(train_window=40, horizon=3, n_alphas=4)
    gaps = same_day(spark).withColumn("y", F.when(F.dayofyear("d") != 10, F.col("y")))
    assert models.same_day_forecast(gaps, cfg).count() == 2 * 3 * (74 - 40 - 3 + 1)
    assert models.same_day_forecast(same_day(spark), cfg, stride=10).count() == 2 * 3 * 4
    assert models.same_day_forecast(same_day(spark, n=30), cfg).count() == 0


def long_rows(spark, n):
    rng = np.random.default_rng(3)
    v = rng.standard_normal(200) ** 4
    v[rng.random(200) < 0.3] = np.nan
    v[:5] = np.nan
    pdf = pd.DataFrame({"k": "a", "d": [START + dt.timedelta(days=i) for i in range(n)], "value": v[:n]})
    df = spark.createDataFrame(pdf, "k string, d date, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return features.with_row_index(df, "k")


def test_windows_so_far_do_not_look_ahead(spark):
    keys = ["window_start", "row_idx"]
    one, two = (features.windows_so_far(long_rows(spark, n), "value", "k", window=40, stride=7).toPandas().sort_values(keys) for n in (120, 200))
    assert len(one) and len(two) > len(one)
    both = one.merge(two, on=keys)
    assert len(both) == len(one) and np.allclose(both.value_x, both.value_y)


def test_windows_so_far_edges(spark):
    rows = spark.createDataFrame([("a", START, i, v) for i, v in enumerate([None, None, 4.0, None, 8.0, None])], "k string, d date, row_idx int, value double")
    out = features.windows_so_far(rows, "value", "k", window=2, horizon=0, stride=1).orderBy("window_start", "row_idx").collect()
    # The window of rows 0 and 1 knows nothing; row 3 keeps 4 until row 4 is known, and is then on the line.
    assert [r.value for r in out] == [None, None, 4.0, 4.0, 4.0, 4.0, 6.0, 8.0, 8.0, 8.0]
