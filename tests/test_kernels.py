"""Golden matrices, equivalences and properties of the numerical kernels."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.functions import kernels as K

NA = np.nan
M1 = np.array([[10, 12, NA], [12, NA, 10]])
M2 = np.array([[10, 12, NA, NA, NA], [11, 13.5, NA, NA, NA], [NA, NA, 20, NA, NA]])
M3 = np.array([[10, NA], [12, 14], [11, 11.0]])
M4 = np.array([[10, 11, 12], [12, 13.1, 14], [9, 10, 15], [11, 12.2, 13]])


def close(a, b, tol=1e-6):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), atol=tol, equal_nan=True)


def test_maxlfq_golden():
    close(K.maxlfq(M1)[0], [11, 13, 9])
    close(K.process_matrix(M1, "maxlfq_bit"), [11, 13, 9])
    close(K.maxlfq(M4)[0], [10.841667, 11.891667, 12.841667])
    out, note = K.maxlfq(M2)
    close(out, [10.5, 12.75, 20, NA, NA])
    assert note == "1;1;2;NA;NA"
    assert K.components(M2).tolist() == [0, 0, 1, 2, 3]
    close(K.process_matrix(M2, "maxlfq"), [9.383333, 11.633333, 18.883333, NA, NA])


def test_nothing_and_one_ion():
    out, note = K.maxlfq(np.full((2, 3), NA))
    assert note == "NA" and np.isnan(out).all()
    out, note = K.maxlfq(np.array([[5, NA, 7.0]]))
    close(out, [5, NA, 7])
    assert note == ""
    for method in K.METHODS:
        close(K.process_matrix(np.array([[5, NA, 7.0]]), method), [5, NA, 7])
        assert np.isnan(K.process_matrix(np.full((2, 3), NA), method)).all()


def test_polish_and_robust_golden():
    close(K.median_polish_short(M1), [11, 12.998046875, 9.001953125], 1e-9)
    close(K.process_matrix(M1, "median_polish"), [11, 13, 9], 1e-3)
    close(K.process_matrix(M4, "median_polish"), [10.841667, 11.891667, 12.841667], 1e-5)
    close(K.process_matrix(M4, "rlm"), [10.831702, 11.891667, 12.851631], 1e-5)


def test_top_n_golden():
    close(K.top_n(M3, 2), [11.5, 12.5])
    close(K.top_n(M3, 2, False), [11.584963, 13.169925])
    close(K.mean_intensity(M3), [11, 12.5])
    close(K.mean_intensity(M3, False), [11.222392, 13.169925])
    close(K.top_n(M3, 1), [12, 14])


@pytest.mark.parametrize(("v", "w", "out"), [([1, 2, 4], [1, 1, 1], 2.666667), ([1, 2], [1, 1], 1.5), ([1, 5], [3, 1], 2.0), ([1, 2, 3, 4, 5], [1] * 5, 3.4)])
def test_weighted_median_golden(v, w, out):
    close(K.weighted_median(np.array(v, float), np.array(w, float)), out)


def test_rescale():
    close(K.rescale(np.array([11.0, 13, 9]), M1, "sum"), [22, 24, 20])
    for method in ("median-mean", "mean-mean"):
        close(K.rescale(np.array([0.0, 2, 4]), M4, method).mean(), M4.mean())
    close(K.rescale(np.array([0.0, 2, 4]), M4, "sum_exact").sum(), M4.sum())
    with pytest.raises(ValueError):
        K.rescale(np.zeros(3), M4, "other")


def test_weights_single_out_the_odd_ion():
    rng = np.random.default_rng(0)
    x = rng.normal(20, 2, (20, 1)) + rng.normal(0, 1, (1, 6)) + rng.normal(0, 0.02, (20, 6))
    x[3] += np.array([5, -5, 5, -5, 5, -5])
    fit = K.process_matrix(x, "maxlfq")
    w = K.row_weights(x, fit)
    assert w.argmin() == 3 and w[3] < 0.1
    assert (K.row_weights(x[:2] * 0 + fit, fit) == 1).all()
    for method in ("weighted_maxlfq", "weighted_median_polish", "weighted_rlm"):
        out = K.process_matrix(x, method)
        close(out.mean(), x.mean())
        assert not np.allclose(out, K.process_matrix(x, method, min_m=21)) or method != "weighted_maxlfq"


def augmented(x):
    """The dense (K+1) system of one connected component."""
    r = K._pair_medians(x)
    known = ~np.isnan(r)
    n = len(r)
    a = np.zeros((n + 1, n + 1))
    a[:n, :n] = 2 * (np.diag(known.sum(1)) - known)
    a[n, :n] = a[:n, n] = 1
    b = np.append(-2 * np.where(known, r, 0).sum(1), n * np.nanmean(x))
    return np.linalg.solve(a, b)[:n]


matrices = st.tuples(st.integers(2, 7), st.integers(2, 6), st.integers(0, 10**6), st.sampled_from([0.0, 0.2, 0.5, 0.8]))


def matrix(m, n, seed, missing):
    rng = np.random.default_rng(seed)
    x = rng.normal(20, 2, (m, n))
    x[rng.random((m, n)) < missing] = NA
    return x


@settings(max_examples=60, deadline=None)
@given(matrices)
def test_properties(shape):
    x = matrix(*shape)
    out, note = K.maxlfq(x)
    close(K.maxlfq(x + 3)[0], out + 3)
    if len(x) > 1:
        close(K.maxlfq(x[::-1])[0], out)
        close(K.maxlfq(x, solve=K.conjugate_ratios)[0], out, 1e-4)
        close(K.maxlfq(x[:, ::-1])[0][::-1], out)
    label = K.components(x)
    if label.max() == 0 and len(x) > 1:
        close(augmented(x), out)
    quantified = ~np.isnan(out)
    assert (quantified == (~np.isnan(x)).any(0)).all()
    if not np.isnan(x).all() and len(x) > 1:
        for method in K.METHODS:
            y = K.process_matrix(x, method)
            close(np.nanmean(y), np.nanmean(x))
            assert (np.isnan(y) == ~quantified).all()


@settings(max_examples=40, deadline=None)
@given(matrices)
def test_direct_fit_is_no_worse_than_alternating_fit(shape):
    """The alternating fit stops by its sum of absolute residuals, which may be before the minimum; so only losses compare."""
    x = matrix(*shape)
    ok = ~np.isnan(x)
    if not ok.any():
        return
    rng = np.random.default_rng(shape[2])
    w, start = rng.uniform(0.2, 1, x.shape), rng.normal(0, 1, x.shape[1])
    with np.errstate(all="ignore"):
        a, b = K._two_way_fit(x, w, start, 100_000), K._direct_fit(x, w, start)
    fit = [np.where(ok, r[:, None] + c, 0) for r, c in (a, b)]
    loss = [(np.where(ok, w * (x - f) ** 2, 0)).sum() for f in fit]
    assert loss[1] <= loss[0] + 1e-9
    res = np.where(ok, w * (x - fit[1]), 0)  # the normal equations
    close(res.sum(0), np.zeros(x.shape[1]))
    close(res.sum(1), np.zeros(len(x)))
    label, level = K.components(x), np.where(ok, w, 0).sum(0)
    for k in set(label[ok.any(0)].tolist()):  # what alternating keeps of its start
        own = (label == k) & ok.any(0)
        close((level * (b[1] - start))[own].sum(), 0)


def plain_alternating_fit(x, w, cols, rounds):
    """The rule as written: one round after the other, each with its sum of absolute residuals."""
    ok, before = ~np.isnan(x), None
    w, v = np.where(ok, w, 0), np.where(ok, x, 0)
    for _ in range(rounds):
        rows = np.array([(a * (b - cols)).sum() / a.sum() if a.sum() else 0 for a, b in zip(w, v, strict=True)])
        cols = np.array([(a * (b - rows)).sum() / a.sum() if a.sum() else 0 for a, b in zip(w.T, v.T, strict=True)])
        total = np.abs((v - rows[:, None] - cols) * ok).sum()
        if total == 0 or before is not None and abs(before - total) < K.TINY * before:
            break
        before = total
    return rows, cols


@settings(max_examples=40, deadline=None)
@given(matrices, st.sampled_from([1, 2, 7, 8, 9, 300]))
def test_alternating_fit_in_blocks_of_rounds(shape, rounds):
    x = matrix(*shape)
    if np.isnan(x).all():
        return
    rng = np.random.default_rng(shape[2])
    w, start = rng.uniform(0.2, 1, x.shape), rng.normal(0, 1, x.shape[1])
    for got, want in zip(K._two_way_fit(x, w, start, rounds), plain_alternating_fit(x, w, start, rounds), strict=True):
        close(got, want, 1e-5)


def test_alternating_fit_stops_by_its_own_rule():
    """On this matrix the residuals' sum stands still from the first round on, so two rounds are made, not more."""
    x = matrix(2, 2, 2, 0.0)
    w = np.random.default_rng(2).uniform(0.2, 1, x.shape)
    two, many = K._two_way_fit(x, w, np.zeros(2), 2), K._two_way_fit(x, w, np.zeros(2), 1000)
    close(np.add.outer(*two), np.add.outer(*many))
    close(np.add.outer(*many), np.add.outer(*K._direct_fit(x, w)), 0.05)
