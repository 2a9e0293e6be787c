"""Fits on statistics that don't look ahead: forecasts stay when rows are added, and equal a plain version."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from test_models import scaled, slow_alpha, slow_enet
from tidemill.config import ForecastConfig
from tidemill.functions.scalars import known_transform
from tidemill.operators import daily, features, models
from tidemill.plans import forecast as plan

CFG = ForecastConfig(cap=None, n_alphas=6, horizon=2, train_window=30, selection_window=30, stride=15, rolling_only=1, floor_lookback=20)
START = dt.date(2021, 1, 1)


def tables(spark, n):
    """A right-skewed feature with gaps, a left-skewed one, and a target; the days after 70 change the statistics much."""
    r = np.random.default_rng(7)
    a, b, y = np.exp(r.standard_normal(120)), 5 - np.exp(r.standard_normal(120) / 2), 3 + r.standard_normal(120) / 3
    a[70:] = -4 + a[70:] / 9
    b[70:] += 30
    rows = [("s", START + dt.timedelta(days=i), k, float(v[i])) for i in range(n) for k, v in (("a", a), ("b", b)) if not (k == "a" and i % 9 == 4)]
    days = [("s", START + dt.timedelta(days=i), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series string, d date, col_key string, value double"), spark.createDataFrame(days, "series string, d date, y double")


def matrix(spark, n):
    rows, target = tables(spark, n)
    dictionary = features.predictors(daily.feature_names(rows, "col_key", "series"), plan.CALENDAR)
    return plan.wide_matrix(rows, target, dictionary, as_known=True).persist(), dictionary


@pytest.fixture(scope="module")
def both(spark):
    return matrix(spark, 72)[0], *matrix(spark, 95)


def plain_skew(x):
    c = x - x.mean(axis=0)
    with np.errstate(invalid="ignore"):
        return np.nan_to_num((c**3).mean(axis=0) / (c**2).mean(axis=0) ** 1.5)


def plain_transform(x, past):
    """Columns of x by the statistics of past, column by column and value by value."""
    out = x.copy()
    for j, (s, low) in enumerate(zip(plain_skew(past), past.min(axis=0))):
        for i in range(len(x)):
            v = x[i, j]
            if s > 1:
                v = max(v, low)
                v = np.log(1 + v) if low > 0 else (v - low + 1) ** 0.5
            elif s < -1:
                v = v * v
            out[i, j] = v
    return out


def test_gaps_take_the_last_value(spark):
    rows, target = tables(spark, 40)
    dictionary = features.predictors(daily.feature_names(rows, "col_key", "series"), plan.CALENDAR)
    got = plan.wide_features(rows, target, dictionary, as_known=True).where("ordinal = 0").toPandas().set_index("d")
    first = {r.d: r.value for r in rows.where("col_key = 'a'").collect()}
    for d, row in got.iterrows():
        assert row.value == first.get(d, first.get(d - dt.timedelta(days=1)))
        assert row.low == min(got.value[got.index <= d])


def test_forecasts_stay_when_rows_are_added(both):
    keys = ["origin_date", "horizon"]
    short, long, _ = both
    one, two = (models.rolling_forecast(m, CFG).toPandas().set_index(keys).sort_index() for m in (short, long))
    assert len(one) and len(two) > len(one)
    two = two.loc[one.index]
    assert np.allclose(one.predicted, two.predicted) and np.allclose(one.alpha, two.alpha)
    ledgers = [models.selection_ledger(m, [str(i) for i in range(8)] + plan.CALENDAR, CFG).toPandas().set_index(["window_start", "predictor"]).n for m in (short, long)]
    assert len(ledgers[0]) and (ledgers[1].loc[ledgers[0].index] == ledgers[0]).all()
    until = "2021-03-05"
    one, two = (plan.global_forecast(m, models.global_models(m, CFG, until), CFG).toPandas().set_index(keys).sort_index() for m in (short, long))
    assert np.allclose(one.predicted, two.loc[one.index].predicted)


def test_rolling_and_global_against_plain_version(both):
    _, m, _ = both
    pdf = m.orderBy("row_idx").toPandas()
    op, cal, y = np.array(pdf.op.tolist()), np.array(pdf.cal.tolist()), pdf.y.to_numpy()
    detail = models.rolling_forecast(m, CFG).toPandas().set_index(["origin_date", "horizon"])
    changed = 0
    for o in (40, 68, 80):
        own = plain_transform(op[o - 29 : o + 1], op[: o + 1])
        changed += (own != op[o - 29 : o + 1]).any()
        for h in (1, 2):
            z, mean, sd = scaled(np.hstack([own[: 30 - h], cal[o - 29 + h : o + 1]]))
            t = y[o - 29 + h : o + 1]
            b, c = slow_enet(z, t, slow_alpha(z, t, 6))
            want = (np.concatenate([own[-1], cal[o + h]]) - mean) / sd @ b + c
            assert np.isclose(detail.loc[(pdf.d[o], h)].predicted, want, atol=1e-3)
    assert changed
    end = 60
    until = str(pdf.d[end])
    fitted = models.global_models(m, CFG, until)
    told = plan.global_forecast(m, fitted, CFG).toPandas().set_index(["origin_date", "horizon"]).predicted
    model = {r.horizon: r for r in fitted.collect()}
    assert np.allclose(model[1].skew, plain_skew(op[: end + 1])) and np.allclose(model[1].low, op[: end + 1].min(axis=0))
    for o in (50, 90 - 8):
        own = plain_transform(op[o : o + 1], op[: end + 1])[0]
        for h in (1, 2):
            want = np.concatenate([own, cal[o + h]]) @ np.array(model[h].coef) + model[h].intercept
            assert np.isclose(told.loc[(pdf.d[o], h)], want)


def test_values_below_what_is_known(spark):
    df = spark.createDataFrame([([0.5, -9.0, 3.0, 7.0], [2.0, 2.0, -2.0, float("nan")], [1.0, -1.0, 0.0, 0.0])], "v array<double>, s array<double>, l array<double>")
    (got,) = df.select(known_transform(df.v, df.s, df.l)).first()
    assert np.allclose(got, [np.log(2), 1.0, 9.0, 7.0])
    assert np.allclose(models._transformed(np.array([[0.5, -9.0, 3.0, 7.0]]), np.array([2.0, 2.0, -2.0, 0.0]), np.array([1.0, -1.0, 0.0, 0.0])), [got])


def test_selected_columns_keep_their_statistics(spark, both):
    _, m, _ = both
    picked = spark.createDataFrame([(3, "x", 5, True, False), (1, "y", 4, True, False)], "ordinal int, predictor string, n_selected long, in_model boolean, forced boolean")
    own, names = models.chosen(m, picked)
    a, b = m.orderBy("row_idx").toPandas(), own.orderBy("row_idx").toPandas()
    assert names == ["x", "y"]
    for c in ("op", "skew", "low"):
        assert np.allclose(np.array(b[c].tolist(), dtype=float), np.array(a[c].tolist(), dtype=float)[:, [3, 1]], equal_nan=True)
