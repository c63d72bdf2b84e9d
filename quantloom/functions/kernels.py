"""Quantification kernels: an ion x sample matrix of log2 values (NaN: missing) to one value per sample.

All take one entity's matrix, so they run inside the tasks of a grouped map; nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAD_FACTOR = 1.4826  # fixed value: makes the MAD estimate a normal standard deviation
TINY = 1e-10
TIES = 10  # digits of a residual by which a weighted polish tells values apart: a sweep makes ties that differ by rounding only


def _quiet(f: Callable) -> Callable:
    def run(*a, **b):
        with np.errstate(all="ignore"):
            return f(*a, **b)

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


def nanmedian(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Median without NaN; NaN where there is nothing, without a warning."""
    if axis is None:
        x = x[~np.isnan(x)]
        return np.median(x) if len(x) else np.nan
    x = np.sort(x if axis == 1 else x.T, axis=1)
    n = (~np.isnan(x)).sum(1)
    rows = np.arange(len(x))
    low, high = x[rows, np.maximum((n - 1) // 2, 0)], x[rows, np.minimum(n // 2, x.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Sorted by (value, weight): where the cumulative weight C first reaches half of W, (C v[p] + (W - C) v[p+1]) / W; the last value as it is."""
    order = np.lexsort((weights, values))
    v, c = values[order], np.cumsum(weights[order])
    p = int(np.argmax(2 * c >= c[-1]))
    return v[p] if p == len(v) - 1 else (c[p] * v[p] + (c[-1] - c[p]) * v[p + 1]) / c[-1]


def components(x: np.ndarray) -> np.ndarray:
    """A label for every sample, from 0 in the order of first samples; samples that share an ion are linked."""
    ok = ~np.isnan(x)
    linked = (ok.T.astype(np.int64) @ ok) > 0
    label, found = np.full(x.shape[1], -1), 0
    for s in range(x.shape[1]):
        if label[s] < 0:
            reach = np.zeros(x.shape[1], bool)
            reach[s] = True
            while True:
                more = reach | linked[reach].any(0)
                if (more == reach).all():
                    break
                reach = more
            label[reach] = found
            found += 1
    return label


def _pair_medians(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """r[i, j]: median over shared ions of x[:, j] - x[:, i]; NaN without any."""
    n = x.shape[1]
    r = np.full((n, n), np.nan)
    for i in range(n - 1):
        d = x[:, i + 1 :] - x[:, i : i + 1]
        if weights is None:
            m = nanmedian(d, axis=0)
        else:
            m = np.array([weighted_median(c[k], weights[k]) if (k := ~np.isnan(c)).any() else np.nan for c in d.T])
        r[i, i + 1 :], r[i + 1 :, i] = m, -m
    return r


def solve_ratios(r: np.ndarray, mean: float) -> np.ndarray:
    """Least squares values of one component with pair medians r, and the given mean."""
    known = ~np.isnan(r)
    laplacian = np.diag(known.sum(1)) - known
    b = -np.where(known, r, 0).sum(1)
    return np.linalg.solve(laplacian + 1 / len(r), b) + mean


def conjugate_ratios(r: np.ndarray, mean: float) -> np.ndarray:
    """The same by conjugate gradients from zero, until the squared residual is below TINY or for N + 1 rounds."""
    known = ~np.isnan(r)
    degree, x = known.sum(1), np.zeros(len(r))
    rest = -np.where(known, r, 0).sum(1)
    way, size = rest.copy(), rest @ rest
    for _ in range(len(r) + 1):
        if size < TINY:
            break
        image = degree * way - known @ way
        step = size / (way @ image)
        x, rest = x + step * way, rest - step * image
        size, before = rest @ rest, size
        way = rest + size / before * way
    return x - x.mean() + mean


def annotation(estimate: np.ndarray, label: np.ndarray) -> str:
    """Empty if all quantified samples share a component; else their labels from 1; "NA" if nothing is quantified."""
    ok = ~np.isnan(estimate)
    if not ok.any():
        return "NA"
    if len(set(label[ok].tolist())) == 1:
        return ""
    return ";".join(str(k + 1) if o else "NA" for k, o in zip(label.tolist(), ok.tolist(), strict=True))


@_quiet
def maxlfq(x: np.ndarray, weights: np.ndarray | None = None, solve: Callable = solve_ratios) -> tuple[np.ndarray, str]:
    """Values whose differences fit the pair medians best, with each component's mean kept, and the annotation."""
    if np.isnan(x).all():
        return np.full(x.shape[1], np.nan), "NA"
    if len(x) == 1:
        return x[0].copy(), ""
    label, out = components(x), np.full(x.shape[1], np.nan)
    for k in range(label.max() + 1):
        own = np.flatnonzero(label == k)
        part = x[:, own]
        out[own] = nanmedian(part) if len(own) == 1 else solve(_pair_medians(part, weights), np.nanmean(part))
    return out, annotation(out, label)


def _sweep(x: np.ndarray, eps: float, rounds: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Median polish: the columns' effects plus the overall one. weights: of the rows, for the columns' medians."""
    res = x.copy()
    rows, cols, overall, before = np.zeros(len(x)), np.zeros(x.shape[1]), 0.0, 0.0
    empty_cols = np.isnan(x).all(0)
    for _ in range(rounds):
        step = nanmedian(res, axis=1)
        res, rows = res - step[:, None], rows + step
        shift = nanmedian(cols)
        cols, overall = cols - shift, overall + shift
        if weights is None:
            step = nanmedian(res, axis=0)
        else:
            step = np.array([weighted_median(np.round(c[k], TIES), weights[k]) if (k := ~np.isnan(c)).any() else np.nan for c in res.T])
        res, cols = res - step[None], cols + step
        shift = nanmedian(rows)
        rows, overall = rows - shift, overall + shift
        total = np.nansum(np.abs(res))
        if total == 0 or abs(total - before) < eps * total:
            break
        before = total
    return np.where(empty_cols, np.nan, overall + cols)


@_quiet
def median_polish_short(x: np.ndarray, eps: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Tukey's median polish with the usual ten rounds at most."""
    return _sweep(x, eps, rounds)


def _residual_scale(res: np.ndarray) -> float:
    own = res[~np.isnan(res)]
    return MAD_FACTOR * np.median(np.abs(own - np.median(own)))


def _two_way_fit(x: np.ndarray, weights: np.ndarray, cols: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares of x = rows + cols, alternating, rows first, from the given column effects.

    Stops once the sum of absolute residuals moves by less than TINY of itself. A round is linear in the column
    effects, so a block of rounds is made on these alone, and the sums of all its rounds are taken together. A row of
    one value fits it by the effects before; what is left of it is how far its column has moved since.
    """
    ok = ~np.isnan(x)
    w, v = np.where(ok, weights, 0), np.where(ok, x, 0)
    several = ok.sum(1) > 1
    single = ok[~several].sum(0)
    i, j = np.nonzero(ok[several])
    values = v[several][i, j]
    by_row, by_col = (w / np.where(n > 0, n, 1) for n in (w.sum(1, keepdims=True), w.sum(0)))
    level = (by_row * v).sum(1)
    step, shift = by_col.T @ by_row, (by_col * (v - level[:, None])).sum(0)
    most = max(1, min(128, (1 << 20) // max(1, len(values))))
    before, made, block = np.inf, 0, min(8, most)
    while made < rounds:
        path = [cols]
        for _ in range(min(block, rounds - made)):
            path.append(shift + step @ path[-1])
        path = np.array(path).T
        rows = level[several, None] - by_row[several] @ path[:, :-1]
        sums = np.abs(values[:, None] - rows[i] - path[j, 1:]).sum(0) + single @ np.abs(np.diff(path))
        last = np.concatenate([[before], sums[:-1]])
        stop = np.flatnonzero((sums == 0) | (np.abs(last - sums) < TINY * last))
        at = stop[0] if len(stop) else len(sums) - 1
        rows, cols = level - by_row @ path[:, at], path[:, at + 1]
        before, made, block = sums[-1], made + len(sums), min(most, 2 * block)
        if len(stop):
            break
    return rows, cols


def _direct_fit(x: np.ndarray, weights: np.ndarray, start: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same fit from its normal equations: where the alternating one from the column effects `start` (zero) would end.

    Each component (label) of linked samples has a constant that the data leave open. Alternating keeps the sum of the
    column effects, each times its column's weights, so the constant is that of the start. This is the exact minimum. The
    alternating fit may stop before it: its rule watches the sum of absolute residuals, which can stand still while
    the effects still move (0.04 away on a matrix of 2 x 2 in the tests).
    """
    ok = ~np.isnan(x)
    there = ok.any(0)
    w, v = np.where(ok, weights, 0)[:, there], np.where(ok, x, 0)[:, there]
    _, own = np.unique((components(x) if label is None else label)[there], return_inverse=True)
    total = w.sum(0)
    part = np.where(own.ravel()[:, None] == np.arange(own.max() + 1), total[:, None], 0)
    keep = part / part.sum(0)
    share = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    system = np.diag(total) - w.T @ share + part @ keep.T
    right = (w * v).sum(0) - share.T @ (w * v).sum(1)
    if start is not None:
        right = right + part @ (keep.T @ start[there])
    cols = np.zeros(x.shape[1])
    cols[there] = np.linalg.solve(system, right)
    rows = (share * (v - cols[there])).sum(1)
    return rows, cols


def _robust_fit(x: np.ndarray, k: float, rounds: int, prior: np.ndarray | None = None, direct: bool = False) -> np.ndarray:
    """Huber M-estimate of the two-way model; prior: weights of rows that multiply Huber's. direct: exact minimum in each round."""
    ok = ~np.isnan(x)
    label = components(x)
    fit = (lambda w, c: _direct_fit(x, w, c, label)) if direct else lambda w, c: _two_way_fit(x, w, c, rounds)
    rows, cols = fit(np.ones_like(x), np.zeros(x.shape[1]))
    for _ in range(rounds):
        res = x - rows[:, None] - cols
        scale = _residual_scale(res)
        if scale < TINY:
            break
        weights = np.minimum(1, k / np.maximum(np.abs(res / scale), 1e-300))
        if prior is not None:
            weights = weights * prior[:, None]
        new_rows, new_cols = fit(weights, cols)
        done = np.abs(new_rows - rows).max() <= TINY and np.abs(new_cols - cols).max() <= TINY
        rows, cols = new_rows, new_cols
        if done:
            break
    return np.where(ok.any(0), cols, np.nan)


@_quiet
def row_weights(x: np.ndarray, fit: np.ndarray, k: float = 1.345) -> np.ndarray:
    """Huber weights of ions by how far each strays from the fitted profile."""
    diff = x - fit
    shared = (~np.isnan(diff)).sum(1)
    centred = diff - np.nanmean(diff, axis=1, keepdims=True)
    d = np.sqrt(x.shape[1] / shared * np.nansum(centred**2, axis=1))
    d[shared < 2] = np.nan
    scale = MAD_FACTOR * nanmedian(np.abs(d - nanmedian(d)))
    if np.isnan(scale) or scale < TINY:
        return np.ones(len(x))
    u = np.abs(d / scale)
    return np.where(np.isnan(u) | (u <= k), 1.0, k / u)


def rescale(estimate: np.ndarray, x: np.ndarray, method: str) -> np.ndarray:
    """Shifts each component to the level of its data: "median-mean", "median-median", "mean-mean", "sum", "sum_exact".

    A component of one sample takes the median, median, mean or sum of its data. "sum" adds (sum of data - mean
    of estimates) / n; "sum_exact" makes the estimates add up to the sum.
    """
    level = {"median-mean": (nanmedian, np.nanmean, np.nanmean), "median-median": (nanmedian, nanmedian, nanmedian), "mean-mean": (np.nanmean, np.nanmean, np.nanmean), "sum": (np.nansum, np.nansum, np.nanmean), "sum_exact": (np.nansum, np.nansum, np.nansum)}
    if method not in level:
        raise ValueError(f"no rescaling method '{method}'")
    single, whole, own = level[method]
    label, out = components(x), estimate.astype(float).copy()
    for k in range(label.max() + 1):
        at = label == k
        if np.isnan(out[at]).all():
            continue
        if at.sum() == 1:
            out[at] = single(x[:, at])
        else:
            gap = whole(x[:, at]) - own(out[at])
            out[at] += gap / (~np.isnan(out[at])).sum() if method.startswith("sum") else gap
    return out


def _level(estimate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Shifted so that the mean of the estimates is the mean of all data."""
    return estimate + np.nanmean(x) - np.nanmean(estimate)


def top_n(x: np.ndarray, n: int = 3, log_space: bool = True) -> np.ndarray:
    """Mean per sample of the n ions with the largest means (ties: first ion)."""
    if len(x) == 1:
        return x[0].copy()
    v = x if log_space else 2.0**x
    mean = np.nanmean(v, axis=1)
    best = np.argsort(np.where(np.isnan(mean), np.inf, -mean), kind="stable")[:n]
    out = np.nanmean(v[best], axis=0)
    return out if log_space else np.log2(out)


def mean_intensity(x: np.ndarray, log_space: bool = True) -> np.ndarray:
    return top_n(x, len(x), log_space)


METHODS = ("maxlfq", "maxlfq_bit", "weighted_maxlfq", "median_polish", "weighted_median_polish", "rlm", "weighted_rlm", "rlm_direct", "weighted_rlm_direct")


@_quiet
def process_matrix(x: np.ndarray, method: str = "maxlfq_bit", k: float = 1.345, min_m: int = 15, p1: float | None = None, p2: float | None = None) -> np.ndarray:
    """One value per sample by a named method, shifted to the mean of all data.

    k, min_m: constant and least number of ions of the weighted methods. p1, p2: constant (1.345) and rounds (1000)
    of the robust methods, tolerance (1e-4) and rounds (1000) of the polish. A matrix of one row is its own result.
    """
    if method not in METHODS:
        raise ValueError(f"no method '{method}'")
    if len(x) == 1:
        return x[0].copy()
    if np.isnan(x).all():
        return np.full(x.shape[1], np.nan)
    weighted, kind = method.startswith("weighted_") and len(x) >= min_m, method.removeprefix("weighted_")
    rounds = int(1000 if p2 is None else p2)
    if kind == "maxlfq_bit":
        out = rescale(maxlfq(x, solve=conjugate_ratios)[0], x, "median-mean")
    elif kind == "maxlfq":
        out = maxlfq(x)[0]
        if weighted:
            out = maxlfq(x, row_weights(x, out, k))[0]
    elif kind == "median_polish":
        eps = 1e-4 if p1 is None else p1
        out = _sweep(x, eps, rounds)
        if weighted:
            out = _sweep(x, eps, rounds, row_weights(x, out, k))
    else:
        huber, direct = 1.345 if p1 is None else p1, kind == "rlm_direct"
        out = _robust_fit(x, huber, rounds, None, direct)
        if weighted:
            out = _robust_fit(x, huber, rounds, row_weights(x, out, k), direct)
    return _level(out, x)
