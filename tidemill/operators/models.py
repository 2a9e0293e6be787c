"""Fits over many (series, origin, horizon) groups: rolling and global models, selection, ensemble.

A matrix is (series, d, row_idx, y, op, cal): ``op`` is known at the row, ``cal`` (calendar) in advance, so models take
``op`` at row t and ``cal`` at the target's row t + h. A matrix may have ``wx`` as well, the weather of its horizons:
element h - 1 is what row t knows of the target's day (``weather.by_horizon``), so those columns change with h. Rows with
a null ``op`` are days to come: targets, but no origins. Rows with a null ``y`` teach nothing; an origin may be one. A
boolean ``origin``, where there is one, says which rows are forecast from. Where there are ``skew`` and ``low``, each
row's statistics of op's columns up to it, op isn't transformed yet: a rolling fit transforms it as its origin knows it,
a selection window as its last row does, a global model as the last row it learns from does.

A group of work is a block of consecutive origins of a series with the rows their windows need, so a row is copied a few
times however many origins, windows and horizons use it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastConfig
from ..functions.scalars import clip, known_transform
from .elastic_net import cross_validated, fit_scaled, fit_at, fit_many, standardise
from .features import trailing_floor, with_row_index

DETAIL = "series string, train_win int, origin_date date, horizon int, forecast_date date, actual double, predicted double, floor double, alpha double, coef array<double>"
#: Statistics beside op.
KNOWN = ("skew", "low")
#: Origins of a block, and origins whose fits run at once.
BLOCK, AT_ONCE = 32, 16
#: Tasks for each shuffle partition of the session: fits are long and groups few, so that small tasks fill the cores evenly.
TASKS = 4


def _blocks(rows: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """rows with ``block``: each block's ``size`` rows, ``before`` rows before and ``after`` behind them, dealt to all tasks.

    Blocks are few and their fits long, so they aren't to be merged by their bytes.
    """
    low = F.greatest(F.ceil((F.col("row_idx") - after - size + 1) / size), F.lit(0)).cast("int")
    high = F.floor((F.col("row_idx") + before) / size).cast("int")
    spread = rows.withColumn("block", F.explode(F.sequence(low, high)))
    return _dealt(spread, "series", "block")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _matrix(values: pd.Series) -> np.ndarray:
    """Rows of equally long arrays as a matrix; a null row, and a null element, is 0."""
    width = next((len(v) for v in values if v is not None), 0)
    none = np.zeros(width)
    return np.nan_to_num(np.array([none if v is None else np.asarray(v, dtype=float) for v in values], dtype=float).reshape(len(values), width))


def _transformed(x: np.ndarray, skew: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Rows of op by the statistics of a row at or after them all."""
    held = np.maximum(x, low)
    return np.select([(skew > 1) & (low > 0), skew > 1, skew < -1], [np.log1p(np.maximum(held, 0.0)), np.sqrt(held - low + 1), x * x], x)


class _Rows:
    """A group's rows in order: op, cal, wx (rows, horizons, columns), y, and which rows can be origins."""

    def __init__(self, pdf: pd.DataFrame):
        self.op, self.cal, self.y = _matrix(pdf.op), _matrix(pdf.cal), pdf.y.to_numpy(dtype=float)
        self.real = pdf.op.notna().to_numpy()
        self.known = [_matrix(pdf[c]) for c in KNOWN] if KNOWN[0] in pdf.columns else None
        self.wx = None
        if "wx" in pdf.columns:
            flat = _matrix(pdf.wx.map(lambda v: None if v is None else np.concatenate([np.asarray(x, dtype=float) for x in v])))
            self.wx = flat.reshape(len(pdf), -1 if flat.size else 1, len(next((v[0] for v in pdf.wx if v is not None), [])))

    def until(self, start: int, at: int) -> np.ndarray:
        """op from row start to row at, as row at knows it."""
        return self.op[start : at + 1] if self.known is None else _transformed(self.op[start : at + 1], *(v[at] for v in self.known))

    def later(self, rows: slice, h: int, at_target: bool = True) -> np.ndarray:
        """What rows know of their targets h rows on: the calendar, and the weather of the horizon."""
        cal = self.cal[rows.start + h : rows.stop + h] if at_target else self.cal[rows]
        return cal if self.wx is None else np.hstack([cal, self.wx[rows, h - 1]])


def _inputs(matrix: DataFrame, *names: str) -> DataFrame:
    return matrix.select(*names, *(c for c in ("wx", "origin", *KNOWN) if c in matrix.columns))


def origins(matrix: DataFrame, cfg: ForecastConfig, windows: tuple[int, ...] = (), stride: int = 1) -> DataFrame:
    """(series, origin_date) of the rows that ``rolling_forecast`` forecasts from, without a fit."""
    shortest = min(windows, default=cfg.train_window)
    rows = matrix.withColumn("_n", F.max("row_idx").over(Window.partitionBy("series")))
    due = [(F.col("row_idx") >= w - 1) & ((F.col("row_idx") - w + 1) % stride == 0) for w in windows or (shortest,)]
    rows = rows.where(F.col("op").isNotNull() & (F.col("row_idx") + cfg.horizon <= F.col("_n")) & reduce(lambda a, b: a | b, due))
    if "origin" in matrix.columns:
        rows = rows.where("origin")
    if cfg.origin_start:
        rows = rows.where(F.col("d") >= F.lit(cfg.origin_start).cast("date"))
    if cfg.origin_end:
        rows = rows.where(F.col("d") <= F.lit(cfg.origin_end).cast("date"))
    return rows.select("series", F.col("d").alias("origin_date"))


def rolling_forecast(matrix: DataFrame, cfg: ForecastConfig, partial: bool = False, calendar_at_target: bool = True, stride: int = 1, windows: tuple[int, ...] = ()) -> DataFrame:
    """Forecast detail of the rolling model, not clipped yet: for each origin and horizon a fit on its own window.

    Columns that don't vary in the window get no weight. ``partial`` leaves calendar and weather unpenalised; without
    ``calendar_at_target`` all columns are taken at the row (the baseline). ``coef`` is that of standardised columns,
    op first, then calendar, then weather. Origins are rows with a full window behind and a row for every horizon
    ahead, every ``stride`` of them. Several ``windows`` (cfg.train_window if none is given) share one pass over the
    rows. Days to come have no actual.
    """
    windows = tuple(windows) or (cfg.train_window,)
    horizon, lag = cfg.horizon, cfg.label_lag

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        rows = _Rows(pdf)
        op, y = rows.op, rows.y
        extra = rows.cal.shape[1] + (0 if rows.wx is None else rows.wx.shape[2])
        mask = np.arange(op.shape[1] + extra) < op.shape[1] if partial and calendar_at_target else None
        first = int(pdf.row_idx[0])
        able = rows.real & (pdf.row_idx // BLOCK == pdf.block[0]).to_numpy()
        if "origin" in pdf.columns:
            able &= pdf.origin.to_numpy(dtype=bool)
        if cfg.origin_start:
            able &= (pdf.d >= pd.Timestamp(cfg.origin_start).date()).to_numpy()
        if cfg.origin_end:
            able &= (pdf.d <= pd.Timestamp(cfg.origin_end).date()).to_numpy()
        able = [o for o in np.flatnonzero(able) if o + horizon < len(pdf) and pdf.row_idx[o + horizon] == first + o + horizon]
        todo = [(w, o) for w in windows for o in able if pdf.row_idx[o] >= w - 1 and (pdf.row_idx[o] - w + 1) % stride == 0]
        out = []
        for at in range(0, len(todo), AT_ONCE):
            keys, xs, ys, news = [], [], [], []
            for w, o in todo[at : at + AT_ONCE]:
                start = o - w + 1
                own = rows.until(start, o)
                own = np.where(own.std(axis=0) > 0, own, 0.0)
                for h in range(1, horizon + 1):
                    known = o + 1 - lag  # targets up to the origin less the lag
                    train = slice(start, known - h)
                    use = ~np.isnan(y[start + h : known])
                    keys.append((w, o, h))
                    xs.append(np.hstack([own[: train.stop - start], rows.later(train, h, calendar_at_target)])[use])
                    ys.append(y[start + h : known][use])
                    news.append(np.concatenate([own[-1], rows.later(slice(o, o + 1), h, calendar_at_target)[0]]))
            for (w, o, h), x, (coef, intercept, alpha, scaled) in zip(keys, news, fit_many(xs, ys, cfg.l1_ratio, cfg.folds, cfg.n_alphas, mask)):
                out.append((pdf.series[0], w, pdf.d[o], h, pdf.d[o + h], y[o + h], float(x @ coef + intercept), pdf.floor[o], alpha, scaled.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DETAIL.split(", ")])

    rows = trailing_floor(matrix, "y", "series", lookback=cfg.floor_lookback, q=cfg.floor_quantile, late=max(3, lag))
    dealt = _blocks(_inputs(rows, "series", "d", "row_idx", "y", "op", "cal", "floor"), max(windows) - 1, horizon, BLOCK)
    return dealt.groupBy("series", "block").applyInPandas(run, DETAIL)


def same_day_forecast(matrix: DataFrame, cfg: ForecastConfig, folds: int = 10, seed: int = 123, stride: int = 1) -> DataFrame:
    """Forecast detail of the original baseline: one model a window, applied to the later days' own columns.

    That model explains a day's y by the same day's ``op``, so its detail is a nowcast and no real forecast: predictions
    need the columns of the days they are for. Folds are random but follow a hash of (seed, series, day): a window's rows
    in the order of their hash take the folds in turn, so a rerun, or another partitioning, gives the same ones. Columns
    that don't vary in the window get no weight; ``coef`` is that of columns divided by their sample deviation. Rows
    without op or y are left out first; nothing is clipped, and there is no floor. A constant y is forecast as it is.
    """
    window, horizon = cfg.train_window, cfg.horizon

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        op, y, key = _matrix(pdf.op), pdf.y.to_numpy(dtype=float), pdf.key.to_numpy()
        index = pdf.row_idx.to_numpy()
        mine = (index // BLOCK == pdf.block[0]) & (index >= window - 1) & ((index - window + 1) % stride == 0)
        todo = [o for o in np.flatnonzero(mine) if o + horizon < len(pdf)]
        out = []
        for at in range(0, len(todo), AT_ONCE):
            problems, dealt, varies = [], [], []
            for o in todo[at : at + AT_ONCE]:
                x = op[o - window + 1 : o + 1]
                deviation = x.std(axis=0, ddof=1)
                varies.append(np.where(deviation > 1e-12 * np.maximum(1, np.abs(x.mean(axis=0))), deviation, 0.0))
                fold = np.empty(window, dtype=int)
                fold[np.argsort(key[o - window + 1 : o + 1], kind="stable")] = np.arange(window) % folds
                problems.append((np.where(varies[-1] > 0, x, 0.0), y[o - window + 1 : o + 1]))
                dealt.append(fold)
            for o, sd, (coef, intercept, alpha) in zip(todo[at : at + AT_ONCE], varies, fit_scaled(problems, dealt, cfg.l1_ratio, cfg.n_alphas)):
                told = op[o + 1 : o + 1 + horizon] @ coef + intercept
                weights = (coef * sd).tolist()
                out += [(pdf.series[0], window, pdf.d[o], h, pdf.d[o + h], y[o + h], float(told[h - 1]), None, alpha, weights) for h in range(1, horizon + 1)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in DETAIL.split(", ")])

    rows = with_row_index(matrix.where("op is not null and y is not null"), "series")
    rows = rows.select("series", "d", "row_idx", "y", "op", F.xxhash64(F.lit(seed), "series", "d").alias("key"))
    return _blocks(rows, window - 1, horizon, BLOCK).groupBy("series", "block").applyInPandas(run, DETAIL)


def clipped(detail: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """The predictions held to [floor, cap]; a missing floor or cap holds nothing."""
    p = F.greatest(F.col("predicted"), F.coalesce("floor", "predicted"))
    return detail.withColumn("predicted", clip(p, None, cfg.cap))


def window_sweep(matrix: DataFrame, cfg: ForecastConfig, windows: list[int], **options) -> DataFrame:
    """Clipped forecast detail for each training window, told apart by train_win; one pass over the rows for all."""
    return clipped(rolling_forecast(matrix, cfg, windows=tuple(windows), **options), cfg)


def coefficient_detail(detail: DataFrame, names: list[str]) -> DataFrame:
    """(series, train_win, origin_date, horizon, predictor, coefficient): the weights of detail that aren't 0."""
    rows = detail.select("series", "train_win", "origin_date", "horizon", F.posexplode("coef").alias("i", "coefficient")).where("coefficient <> 0")
    predictor = F.array(*map(F.lit, names))[F.col("i")]
    return rows.select("series", "train_win", "origin_date", "horizon", predictor.alias("predictor"), "coefficient")


def selection_ledger(matrix: DataFrame, names: list[str], cfg: ForecastConfig, done: int | None = None) -> DataFrame:
    """(series, window_start, window_end, predictor, n, slots): how often each window's fits keep a predictor, over horizons.

    names: those of op, then of cal; all columns are taken at the row, and a window's fits see its own rows only, so a
    window's part never changes when days are added. window_end is the day of the last row that the window asks for (its
    horizons included). Windows up to the start ``done`` are left out: a ledger that is kept has them. Windows that start
    at rows without op, or reach beyond the last y, don't count.
    """
    span, block = cfg.selection_window, 2 * cfg.stride
    each = Window.partitionBy("series")
    rows = matrix.where("op is not null and y is not null")
    known = [c for c in KNOWN if c in rows.columns]
    rows = rows.select("series", "row_idx", "d", "y", "op", "cal", *known, (F.max("row_idx").over(each) + 1 - span - cfg.horizon).alias("last"))
    ends = F.lead("d", span + cfg.horizon - 1).over(each.orderBy("row_idx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        rows = _Rows(pdf)
        y = rows.y
        starts = (pdf.row_idx // block == pdf.block[0]) & (pdf.row_idx % cfg.stride == 0) & (pdf.row_idx <= pdf["last"])
        if done is not None:
            starts &= pdf.row_idx > done
        out = []
        for i in np.flatnonzero(starts):
            x = np.hstack([rows.until(i, i + span - 1), rows.cal[i : i + span]])
            train = np.where(x.std(axis=0) > 0, x, 0.0)
            hs = range(1, cfg.horizon + 1)
            fits = fit_many([train[: span - h] for h in hs], [y[i + h : i + span] for h in hs], cfg.l1_ratio, cfg.folds, cfg.n_alphas)
            kept = sum((b != 0).astype(np.int64) for _, _, _, b in fits)
            out += [(pdf.series[0], int(pdf.row_idx[i]), pdf.end[i], name, int(n), len(fits)) for name, n in zip(names, kept)]
        return pd.DataFrame(out, columns=["series", "window_start", "window_end", "predictor", "n", "slots"])

    found = _blocks(rows.withColumn("end", ends), 0, span - 1, block).groupBy("series", "block")
    return found.applyInPandas(run, "series string, window_start int, window_end date, predictor string, n long, slots long")


def ledger_counts(ledger: DataFrame, until: str | None = None) -> DataFrame:
    """(series, predictor, n_selected, total_slots) over a ledger's windows that end by ``until``; never kept ones have 0."""
    rows = ledger if until is None else ledger.where(F.col("window_end") <= F.lit(until).cast("date"))
    return rows.groupBy("series", "predictor").agg(F.sum("n").alias("n_selected"), F.sum("slots").alias("total_slots"))


def selection_counts(matrix: DataFrame, names: list[str], cfg: ForecastConfig) -> DataFrame:
    """(series, predictor, n_selected, total_slots): how often each predictor is kept over windows and horizons."""
    return ledger_counts(selection_ledger(matrix, names, cfg))


def seed_and_expand(counts: DataFrame, dictionary: DataFrame, cfg: ForecastConfig, always: tuple[str, ...] = ()) -> DataFrame:
    """Every predictor of dictionary (ordinal, predictor, metric, kind) with counts, seed, forced, expanded and in_model.

    The most frequent predictors of kind "op" are seeds; all variants of a seed's metric in at least min_frequency of
    the slots join, the seed itself too only if it reaches that; other kinds are forced, and ``always`` names predictors
    that join in any case. Without ``kind`` all are "op". rank numbers the predictors by frequency. The dictionary is as
    small as the number of metrics, so one window ranks it; the counts are read once.
    """
    one = Window.partitionBy(F.lit(1))
    kind = F.col("kind") if "kind" in dictionary.columns else F.lit("op")
    rows = dictionary.withColumn("forced", kind != "op").join(counts.select("predictor", "n_selected", "total_slots"), "predictor", "left")
    rows = rows.withColumn("n_selected", F.coalesce("n_selected", F.lit(0))).withColumn("total_slots", F.coalesce("total_slots", F.max("total_slots").over(one)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("forced").orderBy(F.desc("n_selected"), "ordinal")))
    out = ranked.withColumn("seed", ~F.col("forced") & (F.col("rank") <= cfg.top) & (F.col("n_selected") > 0))
    seeded = F.max(F.col("seed").cast("int")).over(Window.partitionBy("metric")) == 1
    enough = ~F.col("forced") & (F.col("n_selected") >= cfg.min_frequency * F.col("total_slots"))
    out = out.withColumn("expanded", F.coalesce(enough & seeded & F.col("metric").isNotNull(), F.lit(False)))
    out = out.withColumn("in_model", F.col("forced") | F.col("expanded") | F.col("predictor").isin(*always))
    return out.withColumn("pct_selected", F.bround(100 * F.col("n_selected") / F.col("total_slots"), 2))


def chosen(matrix: DataFrame, selection: DataFrame) -> tuple[DataFrame, list[str]]:
    """matrix with only the selected columns of op, by frequency, and their names; the list is as short as a model."""
    rows = selection.where("in_model and not forced").orderBy(F.desc("n_selected"), "ordinal").select("ordinal", "predictor").collect()
    at = F.array(*[F.lit(int(r.ordinal)) for r in rows]).cast("array<int>")

    def picked(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.transform(at, lambda i: F.col(c)[i]))

    return matrix.withColumns({c: picked(c) for c in ("op", *KNOWN) if c in matrix.columns}), [r.predictor for r in rows]


def global_models(matrix: DataFrame, cfg: ForecastConfig, until: str | None = None) -> DataFrame:
    """(series, horizon, alpha, cv_alpha, intercept, coef, scaled, n_nonzero): one partially penalised model per horizon over all rows to ``until``.

    The penalty is the fully penalised model's by cross-validation and that of horizon 1 at least. A group is a horizon
    of a series: first its penalty is found, then, with the penalties of its series known, it is fitted.
    """
    rows = matrix.where("op is not null and y is not null")
    rows = rows if until is None else rows.where(F.col("d") <= F.lit(until).cast("date"))
    known = [c for c in KNOWN if c in matrix.columns]
    if known:  # a row for each series
        last = rows.groupBy("series").agg(*(F.max_by(c, "row_idx").alias(c) for c in known))
        rows = rows.drop(*known).join(last, "series").withColumn("op", known_transform(F.col("op"), *map(F.col, known)))
    weather = F.col("wx")[F.col("h") - 1] if "wx" in matrix.columns else F.array().cast("array<double>")
    spread = rows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))))
    spread = _dealt(spread.select("series", "h", "row_idx", "y", "op", "cal", weather.alias("wh")), "series", "h")

    def problem(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        h, op, cal, wx, y = int(pdf.h[0]), _matrix(pdf.op), _matrix(pdf.cal), _matrix(pdf.wh), pdf.y.to_numpy(dtype=float)
        z, mean, scale = standardise(np.hstack([op[: len(y) - h], cal[h:], wx[: len(y) - h]]))
        return h, z, y[h:], mean, scale, np.arange(z.shape[1]) < op.shape[1]

    def penalty(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) - pdf.h[0] >= cfg.folds:
            h, z, y, *_ = problem(pdf)
            out = [(pdf.series[0], h, float(cross_validated([(z, y)], cfg.l1_ratio, cfg.folds, cfg.n_alphas)[0]))]
        return pd.DataFrame(out, columns=["series", "h", "cv_alpha"])

    schema = "series string, horizon int, alpha double, cv_alpha double, intercept double, coef array<double>, scaled array<double>, n_nonzero int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h, z, y, mean, scale, mask = problem(pdf)
        ((b, intercept),) = fit_at([(z, y)], pdf.alpha.to_numpy()[:1], cfg.l1_ratio, mask)
        coef = b / scale
        row = (pdf.series[0], h, pdf.alpha[0], pdf.cv_alpha[0], float(intercept - coef @ mean), coef.tolist(), b.tolist(), int((b[mask] != 0).sum()))
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    found = spread.groupBy("series", "h").applyInPandas(penalty, "series string, h int, cv_alpha double")
    least = F.max(F.when(F.col("h") == 1, F.col("cv_alpha"))).over(Window.partitionBy("series"))
    penalties = found.withColumn("alpha", F.greatest("cv_alpha", least))
    fitted = spread.join(penalties, ["series", "h"]).groupBy("series", "h").applyInPandas(fit, schema)
    return fitted.join(last, "series") if known else fitted


def ensemble(rolling: DataFrame, general: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Rolling up to horizon rolling_only, beyond it the mean of rolling and global predictions; then held to [floor, cap]."""
    keys = ["series", "origin_date", "horizon"]
    joined = rolling.join(general.select(*keys, F.col("predicted").alias("g")), keys, "left")
    alone = (F.col("horizon") <= cfg.rolling_only) | F.col("g").isNull()
    mixed = joined.withColumn("predicted", F.when(alone, F.col("predicted")).otherwise((F.col("g") + F.col("predicted")) / 2))
    return clipped(mixed.drop("g"), cfg)
