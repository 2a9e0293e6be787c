"""Model queries against a plain solver that shares no code with the engine's."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.config import ForecastConfig
from tidemill.operators import evaluate, models
from tidemill.operators.elastic_net import alpha_grid, fit_at, fit_many, fold_edges, partial_cross_validated, standardise
from tidemill.plans import forecast as plan

CFG = ForecastConfig(cap=1.9, n_alphas=8, horizon=3, train_window=40, selection_window=40, stride=20, rolling_only=1, floor_lookback=30)


def slow_enet(x, y, a, rho=0.5, free=None, rounds=4000):
    """Proximal gradient steps until nothing moves; columns in free are not penalised."""
    pen = np.ones(x.shape[1]) if free is None else 1.0 - free
    xm, ym = x.mean(axis=0), y.mean()
    x, y = x - xm, y - ym
    step = 1 / (np.linalg.eigvalsh(x.T @ x / len(y)).max() + a)
    b = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = x.T @ (x @ v - y) / len(y) + a * (1 - rho) * pen * v
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * a * rho * pen, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, b, t = new + (t - 1) / t2 * (new - b), new, t2
    return b, ym - xm @ b


def slow_alpha(x, y, n_alphas, folds=5, rho=0.5):
    top = np.abs((x - x.mean(axis=0)).T @ (y - y.mean())).max() / (len(y) * rho)
    grid = np.exp(np.linspace(np.log(top), np.log(top * 1e-3), n_alphas))
    sizes = np.full(folds, len(y) // folds)
    sizes[: len(y) % folds] += 1
    err, at = np.zeros(n_alphas), 0
    for s in sizes:
        out = np.zeros(len(y), bool)
        out[at : at + s] = True
        at += s
        for i, a in enumerate(grid):
            b, c = slow_enet(x[~out], y[~out], a, rho)
            err[i] += ((y[out] - x[out] @ b - c) ** 2).mean()
    return grid[err.argmin()]


def scaled(x):
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), x.mean(axis=0), np.where(sd > 0, sd, 1)


def days(spark, n=95, series="a"):
    y = 2 + np.sin(np.arange(n) / 5) / 2 + np.random.default_rng(0).standard_normal(n) / 5
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame(pd.DataFrame({"series": series, "d": [start + dt.timedelta(days=i) for i in range(n)], "y": y}), "series string, d date, y double")


@pytest.fixture(scope="module")
def history(spark):
    m = plan.matrix(days(spark)).persist()
    pdf = m.orderBy("row_idx").toPandas()
    return m, np.array(pdf.op.tolist()), np.array(pdf.cal.tolist()), pdf.y.to_numpy(), pdf.d.tolist()


def test_folds_and_grid():
    assert np.diff(fold_edges(89, 5)).tolist() == [18, 18, 18, 18, 17]
    r = np.random.default_rng(1)
    x, y = r.standard_normal((30, 4)), r.standard_normal(30)
    mask = np.array([True, True, False, True])
    want = np.abs(x[:, mask].T @ (y - y.mean()) - x[:, mask].mean(axis=0) * (y - y.mean()).sum()).max() / 15
    assert np.isclose(alpha_grid(x, y, 0.5, 50, mask)[0], want) and np.isclose(alpha_grid(x, y, 0.5, 50, mask)[-1], want / 1000)


def test_many_fits_against_plain_solver():
    r = np.random.default_rng(3)
    xs = [r.standard_normal((n, 12)) @ r.standard_normal((12, 12)) for n in (60, 59, 58)]
    xs[1][:, 3] = 5.0  # a constant column
    ys = [x @ np.where(np.arange(12) % 3 == 0, 1, 0) + r.standard_normal(len(x)) * 4 for x in xs]
    for x, y, (coef, intercept, alpha, b) in zip(xs, ys, fit_many(xs, ys, 0.5, 5, 10)):
        z, mean, sd = scaled(x)
        assert np.isclose(alpha, slow_alpha(z, y, 10))
        want, c = slow_enet(z, y, alpha)
        assert np.allclose(b, want, atol=1e-4) and np.allclose(x @ coef + intercept, z @ want + c, atol=1e-3)
        assert ((b != 0) == (np.abs(want) > 1e-6)).all()


def test_wide_fit_against_plain_solver():
    r = np.random.default_rng(5)
    x = standardise(r.standard_normal((40, 150)))[0]
    y = x[:, :4].sum(axis=1) + r.standard_normal(40)
    (b, c), = fit_at([(x, y)], np.array([0.2]), 0.5)
    want, _ = slow_enet(x, y, 0.2)
    assert np.allclose(b, want, atol=1e-4)


def test_partial_fit_against_plain_solver():
    r = np.random.default_rng(4)
    x = standardise(r.standard_normal((70, 8)))[0]
    y = x @ r.standard_normal(8) + r.standard_normal(70)
    mask = np.arange(8) < 5
    (b, c), = fit_at([(x, y)], np.array([0.3]), 0.5, mask)
    want, _ = slow_enet(x, y, 0.3, free=(~mask).astype(float))
    assert np.allclose(b, want, atol=1e-4) and np.isclose(c, y.mean())
    assert partial_cross_validated(x, y, mask, n_alphas=10) in alpha_grid(x, y, 0.5, 10, mask)


def test_rolling_against_plain_solver(spark, history):
    m, op, cal, y, d = history
    got = {(r.origin_date, r.horizon): r for r in models.rolling_forecast(m, CFG).collect()}
    origins = range(39, len(y) - 3)
    assert set(got) == {(d[o], h) for o in origins for h in (1, 2, 3)}
    for o in (39, 60, len(y) - 4):
        for h in (1, 3):
            x = np.hstack([op[o - 39 : o + 1 - h], cal[o - 39 + h : o + 1]])
            t = y[o - 39 + h : o + 1]
            z, mean, sd = scaled(x)
            b, c = slow_enet(z, t, slow_alpha(z, t, 8))
            r = got[d[o], h]
            assert np.isclose(r.predicted, (np.append(op[o], cal[o + h]) - mean) / sd @ b + c, atol=2e-3)
            assert r.forecast_date == d[o + h] and np.isclose(r.actual, y[o + h])
            assert np.isclose(r.floor, np.quantile(y[max(0, o - 32) : o - 2], 0.05))


def test_global_and_ensemble_against_plain_solver(spark, history):
    m, op, cal, y, d = history
    fitted = {r.horizon: r for r in models.global_models(m, CFG).collect()}
    alphas, predict = [], {}
    for h in (1, 2, 3):
        x = np.hstack([op[: len(y) - h], cal[h:]])
        z, mean, sd = scaled(x)
        cv = slow_alpha(z, y[h:], 8)
        alphas.append(max(cv, alphas[0] if alphas else cv))
        b, c = slow_enet(z, y[h:], alphas[-1], free=np.r_[np.zeros(op.shape[1]), np.ones(cal.shape[1])])
        r = fitted[h]
        assert np.isclose(r.cv_alpha, cv) and np.isclose(r.alpha, alphas[-1])
        predict[h] = lambda v, b=b, c=c, mean=mean, sd=sd: (v - mean) / sd @ b + c
        new = np.append(op[50], cal[50 + h])
        assert np.isclose(new @ np.array(r.coef) + r.intercept, predict[h](new), atol=2e-3)
        assert r.n_nonzero == (np.array(r.scaled)[: op.shape[1]] != 0).sum()
    rolling = {(r.origin_date, r.horizon): r for r in models.rolling_forecast(m, CFG).collect()}
    for r in plan.forecast(m, CFG).collect():
        o = d.index(r.origin_date)
        p = rolling[r.origin_date, r.horizon]
        want = p.predicted if r.horizon <= 1 else (p.predicted + predict[r.horizon](np.append(op[o], cal[o + r.horizon]))) / 2
        assert np.isclose(r.predicted, min(max(want, p.floor), 1.9), atol=2e-3)


def test_selection_against_plain_solver(spark, history):
    m, op, cal, y, _ = history
    names = plan.NAMES
    cfg = CFG.with_(horizon=2)
    got = {r.predictor: r for r in models.selection_counts(m, names, cfg).collect()}
    x, count, slots = np.hstack([op, cal]), np.zeros(len(names), int), 0
    for i in range(0, len(y) - 42 + 1, 20):
        for h in (1, 2):
            z, _, _ = scaled(x[i : i + 40 - h])
            t = y[i + h : i + 40]
            count += np.abs(slow_enet(z, t, slow_alpha(z, t, 8))[0]) > 1e-6
            slots += 1
    assert {n: got[n].n_selected for n in names} == dict(zip(names, count.tolist())) and {r.total_slots for r in got.values()} == {slots}


def test_label_lag_reads_nothing_later(spark):
    """The days themselves change, so own columns change as well where they look too far."""
    cfg = ForecastConfig(cap=None, n_alphas=10, horizon=2, train_window=60, label_lag=3, origin_start="2020-03-20", origin_end="2020-03-20")
    a = days(spark)
    b = a.withColumn("y", F.when(F.col("d") > F.lit("2020-03-17").cast("date"), F.col("y") + 9).otherwise(F.col("y")))
    c = a.withColumn("y", F.when(F.col("d") <= F.lit("2020-03-17").cast("date"), F.col("y")))  # not reported yet at all
    pa, pb, pc = ({r.horizon: r.predicted for r in models.rolling_forecast(plan.matrix(x, lag=3), cfg).collect()} for x in (a, b, c.where("d <= '2020-03-22'")))
    assert len(pa) == 2 and all(abs(pa[h] - pb[h]) < 1e-9 for h in pa)
    assert pc == {} and plan.matrix(c, lag=3).where("y is null").count() == 3
    ahead = plan.matrix(c.where("d <= '2020-03-20'"), lag=3, ahead=2)
    pd_ = {r.horizon: r.predicted for r in models.rolling_forecast(ahead, cfg).collect()}
    assert all(abs(pa[h] - pd_[h]) < 1e-9 for h in pa)


def test_days_to_come_against_plain_solver(spark, history):
    _, op, cal, y, d = history
    m = plan.matrix(days(spark), ahead=3)
    full = m.orderBy("row_idx").toPandas()
    assert full.d.tolist() == d + [d[-1] + dt.timedelta(days=i) for i in (1, 2, 3)] and full.op.isna().sum() == 3
    late = np.array(full.cal.tolist())
    assert np.allclose(late[: len(y)], cal) and late[-1][:6].tolist() == [float(full.d.iloc[-1].weekday() == i) for i in range(6)]
    got = {(r.origin_date, r.horizon): r for r in plan.future(m, CFG).collect()}
    n = len(y)
    assert set(got) == {(d[n - 1 - k], h) for k in range(3) for h in range(k + 1, 4)}
    models_of = {r.horizon: r for r in models.global_models(plan.matrix(days(spark)), CFG).collect()}
    for (origin, h), r in got.items():
        o = d.index(origin)
        x = np.hstack([op[o - 39 : o + 1 - h], cal[o - 39 + h : o + 1]])
        z, mean, sd = scaled(x)
        b, c = slow_enet(z, y[o - 39 + h : o + 1], slow_alpha(z, y[o - 39 + h : o + 1], 8))
        new = np.append(op[o], late[o + h])
        want = (new - mean) / sd @ b + c
        if h > 1:
            want = (want + new @ np.array(models_of[h].coef) + models_of[h].intercept) / 2
        assert r.actual is None and r.forecast_date == origin + dt.timedelta(days=h)
        assert np.isclose(r.predicted, min(max(want, r.floor), 1.9), atol=2e-3)
    plain = {(r.origin_date, r.horizon): r.predicted for r in models.rolling_forecast(plan.matrix(days(spark)), CFG).collect()}
    same = {(r.origin_date, r.horizon): r.predicted for r in models.rolling_forecast(m, CFG).collect() if r.origin_date <= d[n - 4]}
    assert same == pytest.approx(plain)


def test_weather_by_horizon(spark, history):
    m, op, cal, y, d = history
    from tidemill.operators import weather

    r = np.random.default_rng(6)
    every = [d[0] + dt.timedelta(days=i) for i in range(-3, len(d) + 4)]
    actual = {x: [float(v), float(v) * 2] for x, v in zip(every, r.standard_normal(len(every))) if r.random() > 0.1}
    ahead = {(x, k): [float(r.standard_normal()), None] for x in every for k in range(1, 8) if r.random() > 0.3}
    a = spark.createDataFrame([(x, *v) for x, v in actual.items()], "date date, one double, two double")
    f = spark.createDataFrame([(x, k, *v) for (x, k), v in ahead.items()], "date date, lead_day int, one double, two double")

    def at(day, k):
        none = [None, None]
        x, z = actual.get(day + dt.timedelta(days=k), none), ahead.get((day + dt.timedelta(days=k), min(k, 7)), none) if k > 0 else none
        return [q if q is not None else p for p, q in zip(x, z)]

    def known(day, h):
        three = [v for v in (at(day, h - j)[0] for j in range(3)) if v is not None]
        return [*at(day, h), np.mean(three) if three else None]

    got = {x.d: x.wx for x in weather.by_horizon(m, a, f, ["one", "two"], ["one"], 9).collect()}
    for day in d:
        for h in range(1, 10):
            assert [None if v is None else round(v, 9) for v in got[day][h - 1]] == [None if v is None else round(v, 9) for v in known(day, h)]
    both = plan.with_weather(m, a, f, ["one", "two"], ["one"], 3)
    rows = {(x.origin_date, x.horizon): x for x in models.rolling_forecast(both, CFG, stride=15).collect()}
    fitted = {x.horizon: x for x in models.global_models(both, CFG).collect()}
    whole = {(x.origin_date, x.horizon): x.predicted for x in plan.global_forecast(both, models.global_models(both, CFG), CFG).collect()}
    wx = np.array([[[0.0 if v is None else v for v in known(day, h)] for h in (1, 2, 3)] for day in d])
    for o in (39, 54):
        for h in (1, 3):
            x = np.hstack([op[o - 39 : o + 1 - h], cal[o - 39 + h : o + 1], wx[o - 39 : o + 1 - h, h - 1]])
            z, mean, sd = scaled(x)
            t = y[o - 39 + h : o + 1]
            b, c = slow_enet(z, t, slow_alpha(z, t, 8))
            new = np.concatenate([op[o], cal[o + h], wx[o, h - 1]])
            assert np.isclose(rows[d[o], h].predicted, (new - mean) / sd @ b + c, atol=2e-3)
            assert len(fitted[h].coef) == len(new) and np.isclose(whole[d[o], h], new @ np.array(fitted[h].coef) + fitted[h].intercept)
    # Changing the observed weather of a later day changes nothing where there is a forecast of it.
    full = spark.createDataFrame([(x, k, 1.0, 1.0) for x in every for k in range(1, 8)], f.schema)
    moved = a.withColumn("one", F.when(F.col("date") > F.lit(d[54]), F.col("one") + 9).otherwise(F.col("one")))
    one, two = ({x.d: x.wx for x in weather.by_horizon(m, w, full, ["one", "two"], ["one"], 9).collect()}[d[54]] for w in (a, moved))
    assert one == two


def fits_of(df):
    """Grouped fits in the physical plan, without those that a cache holds."""
    return df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas")


def test_every_model_is_fitted_once(spark, history):
    m, *_ = history
    assert fits_of(plan.numbered_forecast(m, CFG)) == 3  # rolling; penalties and weights of the global models
    assert fits_of(plan.holdout(m, CFG, "2020-03-01")) == 2
    assert fits_of(models.window_sweep(m, CFG, [30, 40])) == 1
    dictionary = spark.createDataFrame([(i, n, n, "op" if n in plan.OWN else "calendar") for i, n in enumerate(plan.NAMES)], "ordinal int, predictor string, metric string, kind string")
    assert fits_of(models.seed_and_expand(models.selection_counts(m, plan.NAMES, CFG), dictionary, CFG)) == 1


def test_ledger_serves_both_phases(spark, history):
    m, op, cal, y, d = history
    cfg = CFG.with_(horizon=2, stride=7)
    ledger = models.selection_ledger(m, plan.NAMES, cfg).persist()
    show = lambda df: sorted((r.predictor, r.n_selected, r.total_slots) for r in df.collect())
    assert show(models.ledger_counts(ledger)) == show(models.selection_counts(m, plan.NAMES, cfg))
    cut = d[60]
    early = m.where(F.col("d") <= F.lit(cut))
    assert show(models.ledger_counts(ledger, str(cut))) == show(models.selection_counts(early, plan.NAMES, cfg))
    old = models.selection_ledger(early, plan.NAMES, cfg).persist()
    done = old.agg(F.max("window_start")).first()[0]
    new = models.selection_ledger(m, plan.NAMES, cfg, done)
    assert new.count() > 0 and sorted(map(tuple, old.unionByName(new).collect())) == sorted(map(tuple, ledger.collect()))
    ahead = models.selection_ledger(plan.matrix(days(spark), ahead=10), plan.NAMES, cfg)
    assert sorted(map(tuple, ahead.collect())) == sorted(map(tuple, ledger.collect()))


def test_seeds_and_expansion(spark):
    rows = [(0, "a1", "a", "op", 50), (1, "a2", "a", "op", 5), (2, "a3", "a", "op", 4), (3, "b1", "b", "op", 3), (4, "c1", "c", "op", None), (5, "cal", "cal", "calendar", 99), (6, "m", "t", "op", 1)]
    counts = spark.createDataFrame([(p, n, 100) for _, p, _, _, n in rows if n is not None], "predictor string, n_selected long, total_slots long")
    names = spark.createDataFrame([r[:4] for r in rows], "ordinal int, predictor string, metric string, kind string")
    cfg = CFG.with_(top=4, min_frequency=0.05)
    got = {r.predictor: (r.seed, r.expanded, r.in_model, r.forced) for r in models.seed_and_expand(counts, names, cfg, ("m",)).collect()}
    yes, no = True, False
    assert got == {"a1": (yes, yes, yes, no), "a2": (yes, yes, yes, no), "a3": (yes, no, no, no), "b1": (yes, no, no, no), "c1": (no, no, no, no), "cal": (no, no, yes, yes), "m": (no, no, yes, no)}
    bare = {r.predictor: r.in_model for r in models.seed_and_expand(counts, names.drop("kind"), cfg.with_(top=1)).collect()}
    assert bare["cal"] and not bare["a1"]


def test_several_series_do_not_mix(spark, history):
    m, *_ = history
    both = m.unionByName(m.withColumn("series", F.lit("b")).withColumn("y", F.col("y") * 2))
    one = {(r.origin_date, r.horizon): r.predicted for r in models.rolling_forecast(m, CFG).collect()}
    two = {(r.origin_date, r.horizon): r.predicted for r in models.rolling_forecast(both, CFG).where("series = 'a'").collect()}
    assert one == pytest.approx(two)


def test_sweep_baseline_partial_and_holdout(spark, history):
    m, op, cal, y, d = history
    sweep = models.window_sweep(m, CFG, [30, 40], stride=10)
    assert {r.train_win for r in sweep.select("train_win").distinct().collect()} == {30, 40}
    base = models.rolling_forecast(m, CFG, calendar_at_target=False, stride=10).collect()
    assert {d.index(r.origin_date) for r in base} == set(range(39, len(y) - 3, 10))
    partial = models.rolling_forecast(m, CFG, partial=True, stride=20).collect()
    assert all((np.array(r.coef)[op.shape[1] :] != 0).any() for r in partial)
    out = plan.holdout(m, CFG, str(d[60])).collect()
    assert {r.origin_date for r in out} == set(d[61 : len(y) - 1])
    rows = models.coefficient_detail(models.rolling_forecast(m, CFG, stride=20), plan.NAMES)
    assert rows.where("coefficient = 0").count() == 0 and {r.predictor for r in rows.collect()} <= set(plan.NAMES)


def test_t_probability():
    # Two-sided probabilities from tables: t(10) = 2.228 and t(30) = 2.042 at 5 %, t(5) = 4.032 at 1 %.
    assert [round(evaluate.t_probability(t, n), 4) for t, n in ((2.2281, 10), (2.0423, 30), (4.0321, 5), (0.0, 7))] == [0.05, 0.05, 0.01, 1.0]


def test_correlations_of_equal_values(spark):
    rows = spark.createDataFrame([(0.0, float(i), float(i * i), 2.0 * i) for i in range(9)], "flat double, x double, square double, residual double")
    got = {r.variable: r for r in evaluate.significance(evaluate.correlations(rows, ["flat", "x", "square"])).collect()}
    assert np.isnan(got["flat"].r) and np.isnan(got["flat"].t) and got["flat"].n == 9 and got["flat"].significant is None
    assert got["x"].r == pytest.approx(1) and got["x"].t > 1e6 and got["x"].significant
    r = np.corrcoef(np.arange(9), np.arange(9) ** 2)[0, 1]
    assert (got["square"].r, got["square"].t) == pytest.approx((r, r * np.sqrt(7 / (1 - r * r))))
    assert np.isnan(evaluate.correlations(rows.limit(1), ["x"]).first().r)  # one pair
    assert np.isnan(evaluate.correlations(rows.limit(2), ["x"]).first().t)  # two pairs leave no freedom


def test_command_line(spark, tmp_path):
    from tidemill import cli

    start = dt.datetime(2024, 1, 1, 9)
    r = np.random.default_rng(2)
    rows = [((start + dt.timedelta(days=i)).strftime("%m/%d/%Y %H:%M"), m, s, float(2 + np.sin(i / 4) + r.standard_normal() / 5), s, "x") for i in range(90) for m in ("deaths", "beds", "waits") for s in ("one", "two")]
    spark.createDataFrame(rows, "dt string, metric_name string, coverage string, value double, coverage_label string, variable_type string").write.option("header", True).csv(f"{tmp_path}/in.csv")
    cfg = ForecastConfig(horizon=2, train_window=40, selection_window=40, stride=20, n_alphas=6)
    cli.run(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", "deaths", cli.options(["--no-wx", "--until", "2024-03-10", "--end", "2024-03-20", "40"]), cfg)
    assert spark.read.parquet(f"{tmp_path}/out/nwx_ensemble/pred_matrix").count() > 10
    assert spark.read.parquet(f"{tmp_path}/out/nwx_basic_w40/mse_summary").count() > 10
    assert "forced" in spark.read.parquet(f"{tmp_path}/out/nwx_ensemble/selection").columns
    ahead = spark.read.parquet(f"{tmp_path}/out/nwx_ensemble/future").collect()
    assert {(str(r.origin_date), r.horizon, str(r.forecast_date)) for r in ahead} == {("2024-03-29", 2, "2024-03-31"), ("2024-03-30", 1, "2024-03-31"), ("2024-03-30", 2, "2024-04-01")}
    # With weather: observed and, from a stored response, forecast; holidays, a window, an origin range, the selection from before.
    days_ = [start.date() + dt.timedelta(days=i) for i in range(90)]
    (tmp_path / "w.csv").write_text("rain_sum,date,temperature_2m_mean,temperature_2m_min,snowfall_sum,wind_speed_10m_max\n" + "".join(f"{i % 9},{x},{5 + i % 12},{i % 4 - 2},0,{i % 50}\n" for i, x in enumerate(days_)))
    hours = [f"{start.date() + dt.timedelta(days=i)}T12:00" for i in range(95)]
    hourly = {"time": hours} | {f"{v}_previous_day{k}": [float(i % 11) for i in range(95)] for v in ("temperature_2m", "rain", "snowfall", "wind_speed_10m") for k in range(1, 8)}
    (tmp_path / "fc").mkdir()
    (tmp_path / "fc" / "2024-01-01_2024-03-31.json").write_text(json.dumps({"hourly": hourly}))
    args = ["--weather", f"{tmp_path}/w.csv", "--forecasts", f"{tmp_path}/fc", "2024-01-01", "2024-04-05", "--holidays", "2024-01-01,2024-03-29", "--partial", "--ead-smooth"]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_work")]
    args += ["--origins", "2024-03-01", "2024-03-12", "--selection", f"{tmp_path}/out/nwx_ensemble/selection", "45", "50"]
    cli.run(spark, f"{tmp_path}/in.csv", f"{tmp_path}/two", "deaths", cli.options(args), cfg)
    assert spark.read.parquet(f"{tmp_path}/two/ensemble/mse_summary").count() == 12
    for w in (45, 50):
        weights = spark.read.parquet(f"{tmp_path}/two/partial_esmooth_w{w}/coefficients")
        assert {r.predictor for r in weights.select("predictor").distinct().collect()} & set(plan.WEATHER_NAMES)
        assert spark.read.parquet(f"{tmp_path}/two/partial_esmooth_w{w}/pred_matrix").count() > 0
