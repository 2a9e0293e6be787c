"""Elastic net in numpy, for the many small fits that run inside grouped tasks.

Objective: 1/(2n) |y - Xb|^2 + a*rho*|b|_1 + a*(1-rho)/2*|b|^2, intercept by centring. Columns outside the penalty mask
are unpenalised and fitted by least squares. All paths work on Gram matrices, for many problems of equally many columns
at once, and are exact at every penalty: the columns in use and their signs of the penalty before are the first guess,
the linear equations of the columns in use are solved, a column whose sign would turn leaves on the way there, and once
all signs hold, the column that breaks its optimality condition most joins. Each step lowers the objective, so a set
never comes back, and between neighbouring penalties it seldom changes by more than a few columns. A problem whose
conditions hold rests while others go on.
"""

from __future__ import annotations

import numpy as np

#: Bytes of Gram matrices worked on at once.
GRAM_BYTES = 64 << 20
#: Optimality conditions are met up to this share of the largest product of a column with y.
TOL = 1e-9
#: Changes of the columns in use at one penalty, for each column; a guard only.
CHANGES = 4


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns to mean 0 and population deviation 1 (a constant column is only centred)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 1.0)
    return (x - mean) / scale, mean, scale


def alpha_grid(x: np.ndarray, y: np.ndarray, rho: float, n: int, mask: np.ndarray | None = None) -> np.ndarray:
    """n penalties, log-spaced from the smallest that zeroes all penalised columns (by themselves) to a thousandth of it."""
    pen = x if mask is None else x[:, mask]
    top = max(np.abs((pen - pen.mean(axis=0)).T @ (y - y.mean())).max(initial=0.0) / (len(y) * rho), 1e-12)
    return np.logspace(np.log10(top), np.log10(top * 1e-3), n)


def fold_edges(n: int, folds: int) -> np.ndarray:
    """Borders of contiguous folds; where n doesn't divide, the first folds are one longer."""
    return np.concatenate([[0], np.cumsum([n // folds + (i < n % folds) for i in range(folds)])])


def _descend(gram: np.ndarray, xy: np.ndarray, b: np.ndarray, sign: np.ndarray, l1: np.ndarray, l2: np.ndarray, slack: np.ndarray) -> None:
    """Minimises in place: gram (problems, p, p); xy, b and the signs of the columns in use (problems, p); the rest by problem."""
    go = np.arange(len(b))
    for _ in range(CHANGES * b.shape[1] + 8):
        on = sign[go] != 0
        n = on.sum(axis=1)
        use = np.argsort(~on, axis=1, kind="stable")[:, : n.max(initial=0)]
        real = np.arange(use.shape[1]) < n[:, None]  # a problem with fewer columns in use is filled up with 0 = 0
        row = go[:, None]
        x, s, a1, a2 = b[row, use], np.where(real, sign[row, use], 0.0), l1[row], l2[row]
        equations = gram[go[:, None, None], use[:, :, None], use[:, None, :]] * (real[:, :, None] & real[:, None, :])
        np.einsum("mii->mi", equations)[...] += np.where(real, a2 + 1e-12, 1.0)
        aim = np.linalg.solve(equations, np.where(real, xy[row, use] - a1 * s, 0.0)[:, :, None])[:, :, 0]
        turns = real & (aim * s <= 0)
        reach = np.full(aim.shape, np.inf)
        np.divide(x, x - aim, out=reach, where=turns & (x != aim))
        step = np.minimum(reach.min(axis=1, initial=np.inf), 1.0)[:, None]
        x += step * (aim - x)
        leave = turns & (reach <= step)
        x[leave] = 0.0
        b[row, use] = np.where(real, x, 0.0)
        sign[row, use] = np.where(leave, 0.0, s)
        whole = ~leave.any(axis=1)
        at = go[whole]
        if len(at):
            broken = np.abs(xy[at] - np.matmul(gram[at], b[at][:, :, None])[:, :, 0])
            broken = np.where(sign[at] != 0, -np.inf, broken - l1[at, None])
            worst = broken.argmax(axis=1)
            more = broken[np.arange(len(at)), worst] > slack[at]
            at, worst = at[more], worst[more]
            sign[at, worst] = np.sign(xy[at, worst] - np.einsum("mp,mp->m", gram[at, worst], b[at]))
        go = np.concatenate([go[~whole], at])
        if not len(go):
            return


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices (parts, p, p) and products with y (parts, p), all centred."""
    p = parts[0][0].shape[1]
    gram, xy = np.empty((len(parts), p, p)), np.empty((len(parts), p))
    for i, (x, y) in enumerate(parts):
        c = x - x.mean(axis=0)
        gram[i], xy[i] = c.T @ c / len(y), c.T @ (y - y.mean()) / len(y)
    return gram, xy


def _path_many(parts: list[tuple[np.ndarray, np.ndarray]], alphas: np.ndarray, rho: float, tol: float) -> np.ndarray:
    """Coefficients (alphas, p, parts) of centred problems for penalties (alphas, parts), each started from the one before."""
    p = parts[0][0].shape[1]
    out = np.empty((len(alphas), p, len(parts)))
    some = max(1, GRAM_BYTES // (8 * p * p))
    for at in range(0, len(parts), some):
        gram, xy = _sums(parts[at : at + some])
        b, sign = np.zeros_like(xy), np.zeros_like(xy)
        slack = tol * np.maximum(np.abs(xy).max(axis=1, initial=0.0), 1e-12)
        for i, a in enumerate(alphas[:, at : at + some]):
            _descend(gram, xy, b, sign, a * rho, a * (1 - rho), slack)
            out[i, :, at : at + some] = b.T
    return out


def cross_validated(problems: list[tuple[np.ndarray, np.ndarray]], rho: float, folds: int, n_alphas: int, tol: float = TOL) -> np.ndarray:
    """The penalty of least mean error over contiguous folds, of each (x, y); all columns penalised, x standardised."""
    m = len(problems)
    alphas = np.array([alpha_grid(x, y, rho, n_alphas) for x, y in problems]).T
    train, test = [], []
    for f in range(folds):
        for x, y in problems:
            edges = fold_edges(len(y), folds)
            out = np.zeros(len(y), bool)
            out[edges[f] : edges[f + 1]] = True
            train.append((x[~out], y[~out]))
            test.append((x[out], y[out]))
    coef = _path_many(train, np.tile(alphas, folds), rho, tol)
    errors = np.zeros((n_alphas, m))
    for k, ((x, y), (xt, yt)) in enumerate(zip(train, test)):
        b = coef[:, :, k]
        intercept = y.mean() - b @ x.mean(axis=0)
        errors[:, k % m] += ((yt[:, None] - xt @ b.T - intercept) ** 2).mean(axis=0)
    return alphas[errors.argmin(axis=0), np.arange(m)]


def fit_at(problems: list[tuple[np.ndarray, np.ndarray]], alphas: np.ndarray, rho: float, mask: np.ndarray | None = None, tol: float = TOL) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of each (x, y) at its penalty, by a path down to it."""
    free = np.zeros(problems[0][0].shape[1], bool) if mask is None else ~mask
    left = []
    for x, y in problems:  # the unpenalised columns are profiled out of the others and of y
        pen, yc = x[:, ~free] - x[:, ~free].mean(axis=0), y - y.mean()
        if free.any():
            f = x[:, free] - x[:, free].mean(axis=0)
            both = np.c_[pen, yc]
            both = both - f @ np.linalg.lstsq(f, both, rcond=None)[0]
            pen, yc = both[:, :-1], both[:, -1]
        left.append((pen, yc))
    down = np.array([np.maximum(alpha_grid(x, y, rho, 30), a) for (x, y), a in zip(left, alphas)]).T
    coef = _path_many(left, np.concatenate([down, [alphas]]), rho, tol)[-1] if left[0][0].shape[1] else np.zeros((0, len(left)))
    out = []
    for i, (x, y) in enumerate(problems):
        b = np.zeros(x.shape[1])
        b[~free] = coef[:, i]
        if free.any():
            f = x[:, free] - x[:, free].mean(axis=0)
            b[free] = np.linalg.lstsq(f, y - y.mean() - (x[:, ~free] - x[:, ~free].mean(axis=0)) @ coef[:, i], rcond=None)[0]
        out.append((b, float(y.mean() - x.mean(axis=0) @ b)))
    return out


def fit_scaled(problems: list[tuple[np.ndarray, np.ndarray]], folds: list[np.ndarray], rho: float, n_alphas: int, tol: float = TOL) -> list[tuple[np.ndarray, float, float]]:
    """(coefficients, intercept, penalty) of each (x, y), everything scaled to deviation 1 in each fit and y with it.

    folds: each row's fold. The penalty is that of the least squared error over all held-out rows, on a grid down to a
    ten-thousandth of the largest (a hundredth with fewer rows than columns); penalties are in units of y, so a fold
    whose y varies less is held to as much. A constant y gets its mean and no weight.
    """
    parts, alphas = [], []

    def scaled(x: np.ndarray, y: np.ndarray) -> tuple:
        z, mean, scale = standardise(x)
        spread = y.std()
        spread = spread if spread > 1e-12 * max(1.0, abs(y.mean())) else np.inf
        return (z, (y - y.mean()) / spread), mean, scale, spread

    whole = [scaled(x, y) for x, y in problems]
    for ((z, t), *_, spread), (x, y), f in zip(whole, problems, folds):
        top = np.abs(z.T @ t).max(initial=0.0) / (len(y) * rho)
        grid = np.logspace(0, -4 if len(y) > x.shape[1] else -2, n_alphas) * max(top, 1e-12)
        alphas.append(grid * (spread if np.isfinite(spread) else 1.0))
        for k in np.unique(f):
            parts.append((len(alphas) - 1, f == k, scaled(x[f != k], y[f != k])))
    down = np.array([alphas[i] / s[3] if np.isfinite(s[3]) else np.ones(n_alphas) for i, _, s in parts]).T
    paths = _path_many([s[0] for _, _, s in parts], down, rho, tol)
    errors = np.zeros((len(problems), n_alphas))
    for k, (i, out, (_, mean, scale, spread)) in enumerate(parts):
        x, y = problems[i]
        told = (x[out] - mean) / scale @ paths[:, :, k].T * (spread if np.isfinite(spread) else 0.0)
        errors[i] += ((y[out, None] - y[~out].mean() - told) ** 2).sum(axis=0)
    least = errors.argmin(axis=1)
    best = np.array([a[j] for a, j in zip(alphas, least)])
    full = np.array([a / (w[3] if np.isfinite(w[3]) else 1.0) for a, w in zip(alphas, whole)]).T
    coefs = _path_many([w[0] for w in whole], full, rho, tol)
    result = []
    for i, ((_, mean, scale, spread), (x, y)) in enumerate(zip(whole, problems)):
        coef = coefs[least[i], :, i] / scale * (spread if np.isfinite(spread) else 0.0)
        result.append((coef, float(y.mean() - coef @ mean), float(best[i])))
    return result


def partial_cross_validated(x: np.ndarray, y: np.ndarray, mask: np.ndarray, rho: float = 0.5, folds: int = 5, n_alphas: int = 50) -> float:
    """The penalty of least mean error for a partially penalised model; folds of n // folds rows, the last takes the rest."""
    alphas = alpha_grid(x, y, rho, n_alphas, mask)
    edges = [*(i * (len(y) // folds) for i in range(folds)), len(y)]
    errors = np.zeros(n_alphas)
    for a, b in zip(edges, edges[1:]):
        out = np.zeros(len(y), bool)
        out[a:b] = True
        fits = fit_at([(x[~out], y[~out])] * n_alphas, alphas, rho, mask)
        errors += [((y[out] - x[out] @ c - i) ** 2).mean() for c, i in fits]
    return float(alphas[errors.argmin()])


def fit_many(xs: list[np.ndarray], ys: list[np.ndarray], rho: float, folds: int, n_alphas: int, mask: np.ndarray | None = None) -> list[tuple[np.ndarray, float, float, np.ndarray]]:
    """(coefficients, intercept, penalty, coefficients of standardised columns) of each problem.

    Columns are standardised, the penalty is that of the fully penalised model by cross-validation, and the fit at it
    leaves the columns outside ``mask`` unpenalised. Constant columns get 0.
    """
    scaled = [standardise(x) for x in xs]
    problems = [(np.where(x.std(axis=0) > 1e-12 * np.maximum(1, np.abs(mean)), z, 0.0), y) for x, (z, mean, _), y in zip(xs, scaled, ys)]
    best = cross_validated(problems, rho, folds, n_alphas)
    out = []
    for (b, _), a, (_, mean, scale), y in zip(fit_at(problems, best, rho, mask), best, scaled, ys):
        coef = b / scale
        out.append((coef, float(y.mean() - coef @ mean), float(a), b))
    return out
