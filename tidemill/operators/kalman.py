"""Imputation by a state-space model: local linear trend, variances by likelihood, fixed-interval smoother.

The level moves by a slope and a disturbance, the slope by a disturbance of its own, and a value is the level with noise.
A group is one series' rows in order, one step each, so series spread over tasks; a series is as long as its days. The
three variances are searched together: a filter pass works on all candidates of a round at once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variance of the first level and slope, in units of the values' variance.
DIFFUSE = 1e6
#: Bounds of the variances' decimal logarithms (values scaled to variance 1), first grid, and the finest step.
LOW, HIGH, GRID, FINEST = -8.0, 1.0, (-6.0, -3.0, -1.5, 0.0), 0.02
#: Rounds at one step at most; a guard only, as each better round lowers the likelihood's negative.
ROUNDS = 200


def deviance(y: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Minus twice the log likelihood (without its constant) of y for variances (candidates, 3) of noise, level and slope."""
    noise, level, slope = np.asarray(variances, dtype=float).T
    a, s, out = np.full(len(noise), y[~np.isnan(y)][0]), np.zeros(len(noise)), np.zeros(len(noise))
    p00, p01, p11 = np.full(len(noise), DIFFUSE), np.zeros(len(noise)), np.full(len(noise), DIFFUSE)
    for value in y:
        if value == value:
            f = p00 + noise
            v, kept, gain = value - a, noise / f, p01 / f
            out += np.log(f) + v * v / f
            a, s = value - kept * v, s + gain * v
            p00, p01, p11 = p00 * kept, p01 * kept, p11 - gain * p01
        a, p00, p01, p11 = a + s, p00 + 2 * p01 + p11 + level, p01 + p11, p11 + slope
    return out


def fit(y: np.ndarray) -> np.ndarray:
    """The variances (noise, level, slope) of least deviance: a coarse grid, then the best of all neighbours at ever finer steps."""
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=3)), dtype=float)
    around = np.array(list(itertools.product(GRID, repeat=3)))
    best = around[deviance(y, 10**around).argmin()]
    step = 1.0
    while step >= FINEST:
        for _ in range(ROUNDS):
            around = np.clip(best + step * steps, LOW, HIGH)
            found = deviance(y, 10**around)
            if found.min() >= found[len(steps) // 2]:
                break
            best = around[found.argmin()]
        step /= 2
    return 10**best


def smoothed(y: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """The level's mean at each row given all of y: the filter forward, then the weighted innovations backward."""
    noise, level, slope = map(float, variances)
    a, s, p00, p01, p11 = float(y[~np.isnan(y)][0]), 0.0, DIFFUSE, 0.0, DIFFUSE
    seen = []
    for value in y.tolist():
        if value == value:
            f = p00 + noise
            seen.append((a, p00, p01, (value - a) / f, noise / f, p01 / f))
            v, kept, gain = value - a, noise / f, p01 / f
            a, s = value - kept * v, s + gain * v
            p00, p01, p11 = p00 * kept, p01 * kept, p11 - gain * p01
        else:
            seen.append((a, p00, p01, 0.0, 1.0, 0.0))
        a, p00, p01, p11 = a + s, p00 + 2 * p01 + p11 + level, p01 + p11, p11 + slope
    out, r0, r1 = np.empty(len(y)), 0.0, 0.0
    for i in range(len(y) - 1, -1, -1):
        a, p00, p01, u, kept, gain = seen[i]
        r1 = r0 + r1  # back over the step
        r0 = u + kept * r0 - gain * r1  # back over the value
        out[i] = a + p00 * r0 + p01 * r1
    return out


def filled(y: np.ndarray) -> np.ndarray:
    """y with its gaps smoothed; as it is with fewer than three values, and their own value where all are equal."""
    known = y[~np.isnan(y)]
    if len(known) < 3 or len(known) == len(y):
        return y
    scale = known.std()
    if scale <= 1e-12 * max(1.0, abs(known[0])):
        return np.where(np.isnan(y), known[0], y)
    z = (y - known.mean()) / scale
    return np.where(np.isnan(y), smoothed(z, fit(z)) * scale + known.mean(), y)


def imputed(df: DataFrame, value: str, *keys: str, order: str = "row_idx") -> DataFrame:
    """value (double) with its gaps filled by the smoothed level of the series of ``keys``; other columns stay.

    keys and order tell rows apart and aren't null. A NaN is a gap as well. A series with fewer than three values keeps
    its gaps (null), one whose values are all equal gets that value, one without a gap isn't fitted.
    """
    rows = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        y = pdf["_v"].to_numpy(dtype=float)
        gaps = np.isnan(y)
        pdf["_v"] = filled(y)
        return pdf[gaps]

    at, v = F.col(order).alias("_at"), F.col(value).alias("_v")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    lone = rows.select(*named, at, v)
    found = lone.groupBy(*(f"_k{i}" for i in range(len(keys)))).applyInPandas(run, lone.schema)
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col(order) == F.col("_at")]
    return rows.join(found, same, "left").select(*(F.coalesce(F.nanvl("_v", F.lit(None).cast("double")), value).alias(value) if c == value else F.col(c) for c in df.columns))
