"""Whitening against exact rational arithmetic, on data that defeats plain sums, and on odd inputs."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n long"


def reference(rows: list[tuple]) -> tuple[int, list[int], np.ndarray, dict]:
    """n, sums, covariance from exact fractions, and (vec_id -> x) of the remaining rows."""
    kept = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    d = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums, strict=True)] for x in distinct]
    cov = np.array([[float(sum(v[i] * v[j] for v in d) / n) for j in range(len(sums))] for i in range(len(sums))])
    return n, sums, cov, kept


def check(spark, rows, width, tolerance=1e-9):
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    clean = whitening.fixed_point(table)
    found = whitening.whiten(clean, whitening.fit(clean)).toPandas()
    n, sums, cov, kept = reference(rows)
    assert len(found) == len(kept) * width
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:width], vectors[:, ::-1][:, :width]
    assert (found["n"] == n).all() and (found["identity_error"] <= 1e-8).all()
    for k in range(1, width + 1):
        own = found[found["component"] == k].sort_values(["vec_id", "deviation", "whitened"])
        assert np.allclose(own["explained"], values[k - 1] / np.trace(cov), rtol=1e-9)
        want = []
        for i, x in kept:
            d = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)])
            want.append((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), d @ vectors[:, k - 1] / math.sqrt(values[k - 1])))
        for sign in (1, -1):
            off = np.abs(own["whitened"].to_numpy() - np.array([w for _, _, w in sorted((i, v, sign * w) for i, v, w in want)])).max()
            if off < tolerance:
                break
        assert off < tolerance, (k, off)
        assert own["deviation"].tolist() == [v for _, v, _ in sorted(want)]


def test_against_fractions(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(500 + i, rows[0][1]) for i in range(120)]  # a hot vector counts once
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [])]
    check(spark, rows, 16)


def test_far_from_zero(spark):
    """Values far from zero with small differences: products that are not centred would lose them all."""
    rng = np.random.default_rng(3)
    rows = [(i, (2.0**17 + rng.integers(-3, 4, size=4) / 64).tolist()) for i in range(80)]
    check(spark, rows, 4)


def test_scales_apart(spark):
    """Components whose variances are 10**12 apart keep their relative precision."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * [30000, 1, 0.05]).astype(np.float32).tolist()) for i in range(200)]
    check(spark, rows, 3, 1e-6)


def test_double_double():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-8, 8, 200), rng.normal(size=200)
    for made, plain in ((whitening.two_sum(a, b), lambda x, y: x + y), (whitening.two_product(a, b), lambda x, y: x * y)):
        for h, e, x, y in zip(*made, a, b, strict=True):
            assert Fraction(h) + Fraction(e) == plain(Fraction(x), Fraction(y))
    high, low = whitening.total((a[:, None], np.zeros((200, 1))))
    exact = sum(map(Fraction, a.tolist()))
    assert abs(Fraction(high[0]) + Fraction(low[0]) - exact) <= abs(exact) * Fraction(1, 10**28)


def test_huge_deviations():
    x = np.array([[2**52, 0], [0, 2**52], [5, 5]])
    assert whitening._deviations(x, 3, [2**52 + 5, 2**52 + 5])[:2] == [None, None]
    y = np.array([[2**40, 1], [3, 2**20]])
    want = [sum((7 * c - s) ** 2 for c, s in zip(r, [9, 2**50], strict=True)) for r in y.tolist()]
    assert whitening._deviations(y, 7, [9, 2**50]) == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize(
    "vectors, rows",
    [([], 0), ([None, []], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0], [2.0]], 2), ([[1.0, 2.0], [1.0, 3.0], [9.0]], 2), ([[1e38, 1.0], [1.0, 2.0], [3.0, 5.0]], 2), ([[1.0, 1.0], [2.0, 2.0], [2.0, 2.0]], 3)],
)
def test_odd_tables(spark, vectors, rows):
    """Empty tables, constant vectors (no component), other lengths, huge values, and dimensions that depend on each other (one component)."""
    clean = whitening.fixed_point(spark.createDataFrame([(None, v) for v in vectors], "vec_id long, embedding array<float>"))
    assert whitening.whiten(clean, whitening.fit(clean)).count() == rows


def test_query(spark):
    found = queries.op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(found) == 500 * 16 and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-10
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(16)).max() < 1e-6
