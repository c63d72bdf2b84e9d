"""Entities that no task holds against the same as matrices: fits, polish, weighted medians, components and conjugate gradients."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.functions import kernels
from quantloom.operators import large, normalize, quantify
from quantloom.plans import pipelines
from tests.conftest import SF

SCHEMA = "entity string, ion long, sample string, quant double"


def matrices(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, ions, hole in (("full", 40, 0.0), ("holes", 60, 0.4), ("few", 3, 0.3), ("two parts", 30, 0.2), ("far", 25, 0.1)):
        x = rng.normal(20, 2, (ions, 1)) + rng.normal(0, 1, 6) + rng.standard_t(2, (ions, 6)) * 0.3
        x[rng.random(x.shape) < hole] = np.nan
        if name == "two parts":
            x[:15, 3:], x[15:, :3] = np.nan, np.nan
        if name == "holes":
            x[:, 5] = np.nan  # a sample without values
        out[name] = x[~np.isnan(x).all(1)]
    out["one ion"] = np.array([[1.5, np.nan, 3.0, 4.0, np.nan, 2.0]])
    out["flat"] = np.add.outer(np.arange(8.0), np.arange(6.0))  # fits exactly
    return out


def cells(spark, xs: dict[str, np.ndarray]):
    rows = [(e, int(i), f"s{j:04}", float(x[i, j])) for e, x in xs.items() for i, j in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def compare(found, xs, make, tolerance=1e-8):
    got = {(r["entity"], r["sample"]): r["estimate"] for r in found.collect()}
    for e, x in xs.items():
        want = make(x)
        for j, v in enumerate(want):
            own = got.get((e, f"s{j:04}"))
            assert (own is None) == bool(np.isnan(v)), (e, j, own, v)
            assert own is None or abs(own - v) < tolerance, (e, j, own, v)


@pytest.mark.parametrize("method", ["weighted_median_polish", "median_polish_short", "rlm_direct", "weighted_rlm_direct"])
def test_spread_fits(spark, method, monkeypatch):
    monkeypatch.setattr(large, "REPLAY", 3)
    xs = matrices(1)
    if "rlm" in method:
        xs = {e: xs[e] for e in ("full", "few", "two parts", "one ion", "flat")}
    axis, options = [f"s{j:04}" for j in range(6)], {"p2": 8} if "rlm" in method else {}  # a round is two jobs
    found = quantify.by_method(cells(spark, xs), method, axis, large=1, **options)
    make = kernels.median_polish_short if method == "median_polish_short" else lambda x: kernels.process_matrix(x, method, **options)
    compare(found, xs, lambda x: x[0] if len(x) == 1 else make(x), 1e-7)


def test_sizes_are_told_apart_and_grouped(spark, monkeypatch):
    """Large entities are spread, in groups of what the driver may keep; small ones stay matrices."""
    monkeypatch.setattr(large, "STATE", 12)
    xs = matrices(2)
    found = pipelines.quantify_cells(cells(spark, xs), "median_polish", large=60)
    compare(found, xs, lambda x: kernels.process_matrix(x, "median_polish"))


def test_histogram_medians(spark):
    """Ties, one value, an even number with a gap, huge and tiny values: the median of every key, in a few passes."""
    keys = {0: [1.0], 1: [1.0, 2.0], 2: [5.0] * 9 + [7.0] * 9, 3: [1e-300, 1.0, 1e300], 4: [0.1 * k for k in range(999)], 5: [1.0, 1.0, 2.0, 1e6, 2e6, 2e6]}
    rows = [(str(k), i, "s", v) for k, vs in keys.items() for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    data = large.spread(table, table.select("entity").distinct(), ["s"])
    want = np.array([np.median(keys[k]) for k in keys])
    read = lambda i: (i.entity[i.ion], i.value, None)
    assert np.allclose(data.medians(read, 6), want, rtol=1e-15)
    assert np.allclose(data.medians(read, 6, near=(want - 1e-9, want + 1e-9)), want, rtol=1e-15)
    assert np.allclose(data.medians(read, 6, near=(want + 5, want + 6)), want, rtol=1e-15)
    scale = np.array([np.median(np.abs(np.array(keys[k]) - m)) for k, m in zip(keys, want, strict=True)])
    for off in (1e-9, 0.3, 50.0):
        near = (want + off / 2, scale + off / 3, np.full(6, off), np.full(6, off))
        for a, b in zip(data.middles_and_scales(read, 6, data.all, near), (want, scale), strict=True):
            assert np.allclose(a, b, rtol=1e-12)


def test_weighted_median(spark):
    rng = np.random.default_rng(4)
    groups = {f"g{i}": (rng.integers(0, 12, n).astype(float), rng.integers(1, 4, n).astype(float)) for i, n in enumerate((1, 2, 3, 10, 50, 51, 400))}
    groups["spread"] = (rng.normal(size=3000) * 10.0 ** rng.integers(-20, 20, 3000), np.ones(3000))
    groups["outlier"] = (np.append(rng.normal(size=500), 1e300), np.ones(501))
    groups["largest"] = (np.array([-1.7e308, 1.7e308, 1.0, 2.0]), np.array([1.0, 1.0, 1.0, 1.0]))
    rows = [(g, float(v), float(w)) for g, (vs, ws) in groups.items() for v, w in zip(vs, ws, strict=True)] + [("g1", None, 5.0), ("g1", 1.0, None), ("g2", float("nan"), 1.0)]
    found = {r["k"]: r["m"] for r in quantify.weighted_median(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", "m").collect()}
    assert set(found) == set(groups)
    for g, (v, w) in groups.items():
        assert np.isclose(found[g], kernels.weighted_median(v, w), rtol=1e-12), g
    assert quantify.weighted_median(spark.createDataFrame([], "k string, v double, w double"), ["k"], "v", "w").count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    xs = {f"e{i}": np.where(rng.random((12, 30)) < 0.06, 1.0, np.nan) for i in range(20)}
    xs["chain"] = np.where(np.eye(29, 30, dtype=bool) | np.eye(29, 30, k=1, dtype=bool), 1.0, np.nan)
    xs = {e: x[~np.isnan(x).all(1)] for e, x in xs.items() if not np.isnan(x).all()}
    axis = [f"s{j:04}" for j in range(30)]
    for size in (0, 10):
        got = {(r["entity"], r["sample"]): r["component"] for r in quantify.components(cells(spark, xs), axis, size).collect()}
        assert len(got) == 30 * len(xs)
        for e, x in xs.items():
            assert [got[e, s] for s in axis] == kernels.components(x).tolist(), (e, size)


def test_conjugate_gradients(spark):
    """Chains of many samples, components of several sizes, and single samples."""
    rng = np.random.default_rng(6)
    x = np.full((40, 20), np.nan)
    for i in range(40):
        at = i % 18
        x[i, at : at + 3] = rng.normal(20, 1) + rng.normal(size=3)
    x[:, 12:14] = np.nan
    xs = {"chain": x[~np.isnan(x).all(1)], **{k: v for k, v in matrices(7).items() if k in ("two parts", "one ion")}}
    table = cells(spark, xs)
    compare(quantify.maxlfq_conjugate(table), xs, lambda m: kernels.maxlfq(m)[0], 1e-5)


def test_weighted_ratios(spark):
    xs = {k: v for k, v in matrices(9).items() if k in ("full", "two parts", "few", "one ion")}
    found = quantify.by_method(cells(spark, xs), "weighted_maxlfq", [f"s{j:04}" for j in range(6)], large=1)
    compare(found, xs, lambda m: kernels.process_matrix(m, "weighted_maxlfq"), 1e-5)


def test_ion_weights(spark):
    xs = {k: v for k, v in matrices(8).items() if len(v) >= 3}
    table, axis = cells(spark, xs), [f"s{j:04}" for j in range(6)]
    fit = quantify.by_method(table, "maxlfq", axis)
    got = {(r["entity"], r["ion"]): r["weight"] for r in quantify.ion_weights(table, fit, 6, min_m=5).collect()}
    for e, x in xs.items():
        want = kernels.row_weights(x, kernels.process_matrix(x, "maxlfq")) if len(x) >= 5 else np.ones(len(x))
        assert np.allclose([got[e, i] for i in range(len(x))], want), e


def test_median_by_key_of_any_size(spark):
    rows = [(k, float(v)) for k in range(5) for v in range(k + 1)]
    table = spark.createDataFrame(rows, "k int, quant double")
    want = {k: k / 2 for k in range(5)}
    for size in (1, 100):
        assert {r["k"]: r["median"] for r in normalize.median_by_key(table, ["k"], large=size).collect()} == want
    off = {k: kernels.MAD_FACTOR * float(np.median(np.abs(np.arange(k + 1) - k / 2))) for k in range(5)}
    for size in (1, 100):
        got = {r["k"]: r["mad"] for r in quantify.mad(table, ["k"], large=size).collect()}
        assert all(abs(got[k] - v) < 1e-12 for k, v in off.items())
    assert quantify.mad(table.where(F.lit(False)), ["k"]).count() == 0


def test_rescaling_of_any_size(spark):
    """Entities that come together, those that are spread, and both at once: as their matrices are rescaled."""
    xs = {k: v for k, v in matrices(10).items() if k in ("holes", "two parts", "few", "one ion")}
    xs["apart"] = np.array([[1.0, np.nan, np.nan], [2.0, np.nan, np.nan], [6.0, np.nan, np.nan], [np.nan, 3.0, 5.0]])
    xs = {e: np.pad(x, ((0, 0), (0, 6 - x.shape[1])), constant_values=np.nan) for e, x in xs.items()}
    axis = [f"s{j:04}" for j in range(6)]
    table = cells(spark, xs).unionByName(spark.createDataFrame([(None, 1, axis[0], 9.0)], SCHEMA))
    for method in ("median-median", "median-mean", "mean-mean", "sum", "sum_exact"):
        make = lambda c, size, m=method: quantify.rescale(quantify.mean_intensity(c), c, quantify.components(c, axis, size), m, size)
        for size in (10, 1000) if method == "median-median" else (1000,):
            compare(quantify.by_size(table, make, size), xs, lambda x, m=method: kernels.rescale(np.array([np.nan if np.isnan(c).all() else np.nanmean(c) for c in x.T]), x, m))
    assert quantify.by_size(table.where("ion < 0"), make).count() == 0


def test_rescaling_brings_cells_together_once(spark):
    """The rows are shuffled by entity, and neither they nor their cells by anything else; they are not written a second time."""
    plan = queries.queries()["rescale_median_median"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    assert dealt and all(re.fullmatch(r"entity#\d+L?", keys) for keys in dealt), dealt
    scans = re.findall(r"Scan ExistingRDD\[(.*?)\]", plan)
    assert all("quant" not in columns for columns in scans), scans
