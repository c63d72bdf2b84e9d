"""Polish and robust fits of entities that no task should hold: Spark goes over an entity's ions, the driver keeps a value per sample.

The rows are one per entity and ion (an ion has one value per sample at most), spread over all tasks. What a fit carries from round
to round are the samples' effects and a scale; the ions' effects follow from these, so rows are never written anew, or,
for the robust fits, only every few rounds. Medians of any number of values are found by narrowing histograms: each pass
counts a key's values in ranges of an interval, and goes on with the range that holds the middle until it has one value left.
Entities are taken in groups, so that what the driver keeps is bounded: STATE values, whatever the number of entities or ions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.durable import durable
from quantloom.functions.kernels import MAD_FACTOR, TIES, TINY, components

#: Values per sample that the driver keeps for a group of entities, ranges of a histogram, and rounds between writing ions' effects.
STATE, RANGES, REPLAY = 1 << 20, 1024, 8
#: Values closer than this (times their size, if over 1) are told apart by rounding only.
SAME = 1e-13
#: Cells of a dense block of ions inside a task.
BLOCK = 1 << 20


@dataclass
class Ions:
    """A batch of rows in flat arrays: entity of each ion, first place, and sample, value and ion of each cell."""

    entity: np.ndarray
    first: np.ndarray
    sample: np.ndarray
    value: np.ndarray
    effect: np.ndarray
    width: int

    def __post_init__(self) -> None:
        self.count = np.diff(np.append(self.first, len(self.value)))
        self.ion = np.repeat(np.arange(len(self.first)), self.count)
        self.at = self.entity[self.ion] * self.width + self.sample

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Sums by ion."""
        return np.add.reduceat(x, self.first) if len(x) else np.zeros(0)

    def median(self, x: np.ndarray) -> np.ndarray:
        """Medians by ion."""
        x = x[np.lexsort((x, self.ion))]
        return (x[self.first + (self.count - 1) // 2] + x[self.first + self.count // 2]) / 2

    def only(self, wanted: np.ndarray) -> Ions:
        """The ions of wanted entities."""
        keep = wanted[self.entity]
        cells = keep[self.ion]
        count = self.count[keep]
        return Ions(self.entity[keep], np.cumsum(count) - count, self.sample[cells], self.value[cells], self.effect[keep], self.width)


def _ions(batches: Iterator[pa.RecordBatch], width: int, wanted: np.ndarray) -> Iterator[Ions]:
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(1)
        count = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = cells.flatten()
        found = Ions(batch.column(0).to_numpy(zero_copy_only=False), np.cumsum(count) - count, flat.field("at").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), width)
        found = found.only(wanted)
        if len(found.entity):
            yield found


#: What a pass looks at in a task: keys, values and weights (or None).
Values = Callable[[Ions], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


@dataclass
class Spread:
    """The rows of a group of entities: e (place in entities), cells (array of at, v) and effect."""

    rows: DataFrame
    entities: list
    axis: list

    def __post_init__(self) -> None:
        self.all = np.ones(len(self.entities), bool)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.entities), len(self.axis)

    def totals(self, values: Values, keys: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sum and largest value of each key."""
        width, wanted = len(self.axis), self.all if wanted is None else wanted

        def run(batches):
            for ions in _ions(batches, width, wanted):
                key, value, _ = values(ions)
                own, at = np.unique(key, return_inverse=True)
                most = np.full(len(own), -np.inf)
                np.maximum.at(most, at, value)
                yield pa.record_batch([pa.array(own.astype(np.int64)), pa.array(np.bincount(at)), pa.array(np.bincount(at, value)), pa.array(most)], ["key", "n", "s", "m"])

        found = self.rows.mapInArrow(run, "key long, n long, s double, m double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m")).toPandas()
        out = np.zeros(keys), np.zeros(keys), np.full(keys, -np.inf)
        for side, name in zip(out, "nsm", strict=True):
            side[found["key"]] = found[name]
        return out

    def histogram(self, values: Values, place: Callable[[np.ndarray, np.ndarray], np.ndarray], places: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each key with values: count, weight, heaviest weight, least and largest value of its places, which ascend with the values."""
        width, wanted = len(self.axis), self.all if wanted is None else wanted

        def run(batches):
            for ions in _ions(batches, width, wanted):
                key, value, weight = values(ions)
                weight = np.ones(len(key)) if weight is None else weight
                at = place(key, value)
                ok = (at >= 0) & ~np.isnan(value)
                code, value, weight = (key * places + at)[ok], value[ok], weight[ok]
                if not len(code):
                    continue
                order = np.argsort(code, kind="stable")
                code, value, weight = code[order], value[order], weight[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                columns = [f.reduceat(x, first) for f, x in ((np.add, weight), (np.maximum, weight), (np.minimum, value), (np.maximum, value))]
                yield pa.record_batch([pa.array(code[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(code)))), *map(pa.array, columns)], ["code", "n", "w", "heaviest", "low", "high"])

        kind = "code long, n long, w double, heaviest double, low double, high double"
        merged = self.rows.mapInArrow(run, kind).groupBy("code").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("heaviest").alias("heaviest"), F.min("low").alias("low"), F.max("high").alias("high"))
        found = merged.toPandas().sort_values("code")  # the places of the keys at most
        columns = [found[c].to_numpy() for c in ("n", "w", "heaviest", "low", "high")]
        for k, s, e in zip(*_runs(found["code"].to_numpy() // places), strict=True):
            yield k, *(c[s:e] for c in columns)

    def medians(self, values: Values, keys: int, wanted: np.ndarray | None = None, near: tuple[np.ndarray, np.ndarray] | None = None, weighted: bool = False) -> np.ndarray:
        """The exact median of each key's values, or the interpolating weighted one; NaN without values. near: where they may be found.

        If the two middle values lie in two ranges, they are the end of one and the start of the other. Weighted: as
        kernels.weighted_median; values of equal size count as one, but for the heaviest of them, which comes last.
        """
        ranges = max(8, min(RANGES, STATE // max(1, keys)))
        low, high = (np.full(keys, -np.inf), np.full(keys, np.inf)) if near is None else (near[0].copy(), near[1].copy())
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
        out, active = np.full(keys, np.nan), np.ones(keys, bool)
        while active.any():

            def place(key, value, low=low, high=high, active=active):
                a, b = low[key], high[key]
                with np.errstate(all="ignore"):
                    at = np.nan_to_num(np.floor((value - a) / (b - a) * ranges), nan=0.0)
                return np.where(~active[key], -1, np.where(value < a, 0, np.where(value > b, ranges + 1, np.clip(at, 0, ranges - 1) + 1))).astype(np.int64)

            left = np.zeros(keys, bool)
            for k, n, w, heaviest, a, b in self.histogram(values, place, ranges + 2, wanted):
                p, out[k] = _weighted_middle(n, w, heaviest, a, b) if weighted else _middle(n, a, b)
                left[k] = np.isnan(out[k])
                if left[k]:
                    low[k], high[k] = a[p], b[p]
            active = left
        return out

    def middles_and_scales(self, values: Values, keys: int, wanted: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """The median of each key's values, and the median of their distances to it (NaN without values).

        near: guesses of both, and how far these may be off. Then one pass counts the values around the middle and one scale below
        and above it, which mostly settles both; keys that it leaves open are found one median after the other.
        """
        middle, scale = np.full(keys, np.nan), np.full(keys, np.nan)
        if near is not None:
            m, s, off_m, off_s = near
            edges = np.stack([m - s - off_m - off_s, m - s + off_m + off_s, m - off_m, m + off_m, m + s - off_m - off_s, m + s + off_m + off_s], 1)
            edges = np.maximum.accumulate(np.nan_to_num(edges), axis=1)
            ranges = max(2, min(RANGES, STATE // max(1, keys)) // 3)

            def place(key, value):
                a = edges[key]
                zone = (value[:, None] >= a).sum(1)  # odd: inside one of the three
                low, high = (np.take_along_axis(a, np.clip(zone + d, 0, 5)[:, None], 1)[:, 0] for d in (-1, 0))
                with np.errstate(all="ignore"):
                    at = np.clip(np.nan_to_num(np.floor((value - low) / (high - low) * ranges), nan=0.0), 0, ranges - 1)
                return (zone * ranges + np.where(zone % 2 == 1, at, 0)).astype(np.int64)

            for k, n, _, _, a, b in self.histogram(values, place, 7 * ranges, wanted):
                middle[k] = _middle(n, a, b)[1]
                if not np.isnan(middle[k]):
                    scale[k] = _middle_distance(n, a, b, middle[k])
        first = wanted & np.isnan(middle)
        if first.any():
            found = self.medians(values, keys, first)
            middle = np.where(first, found, middle)
        second = wanted & np.isnan(scale)
        if second.any():

            def distances(i, centre=middle):
                key, value, weight = values(i)
                return key, np.abs(value - centre[key]), weight

            scale = np.where(second, self.medians(distances, keys, second), scale)
        return middle, scale


def _at_rank(reached: np.ndarray, low: np.ndarray, high: np.ndarray, rank: int) -> float:
    """The value of this rank in ascending places with known ends, if it is an end or its place has one value; else NaN."""
    p = int(np.searchsorted(reached, rank, side="right"))
    if high[p] - low[p] <= SAME * max(1, abs(high[p])) or rank == reached[p] - 1:
        return high[p]
    return low[p] if rank == (reached[p - 1] if p else 0) else np.nan


def _middle(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
    """The place of the lower middle value, and the median if the places tell it (else NaN)."""
    reached = np.cumsum(n)
    lower, upper = (reached[-1] - 1) // 2, reached[-1] // 2
    return int(np.searchsorted(reached, lower, side="right")), (_at_rank(reached, low, high, lower) + _at_rank(reached, low, high, upper)) / 2


def _weighted_middle(n: np.ndarray, w: np.ndarray, heaviest: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
    """The same for the interpolating weighted median."""
    reached = np.cumsum(w)
    p, total = int(np.argmax(2 * reached >= reached[-1])), reached[-1]
    if low[p] != high[p]:
        return p, np.nan
    inside = n[p] > 1 and 2 * (reached[p] - heaviest[p]) >= total
    return p, low[p] if inside or p == len(n) - 1 else (reached[p] * low[p] + (total - reached[p]) * low[p + 1]) / total


def _middle_distance(n: np.ndarray, low: np.ndarray, high: np.ndarray, middle: float) -> float:
    """The median distance to the middle, if places with one value settle it (else NaN)."""
    a, b = np.abs(low - middle), np.abs(high - middle)
    least, most = np.where((low <= middle) & (middle <= high), np.where(low == high, a, 0), np.minimum(a, b)), np.maximum(a, b)
    order = np.argsort(least, kind="stable")
    n, least, most = n[order], least[order], most[order]
    # Places that overlap in distance are one, whose ends are known.
    ceiling = np.maximum.accumulate(most)
    first = np.flatnonzero(np.concatenate([[True], least[1:] > ceiling[:-1]]))
    last = np.append(first[1:], len(n)) - 1
    return _middle(np.add.reduceat(n, first), least[first], ceiling[last])[1]


def _runs(key: np.ndarray) -> tuple[list, list, list]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first].tolist(), first.tolist(), np.append(first[1:], len(key)).tolist() if len(key) else []


def spread(cells: DataFrame, names: DataFrame, axis: list) -> Spread:
    """The rows of a group of entities, whose names (column entity) are few."""
    types = dict(cells.dtypes)
    entities = sorted(r[0] for r in names.select("entity").collect())
    spark = cells.sparkSession
    places = spark.createDataFrame([(e, i) for i, e in enumerate(entities)], f"entity {types['entity']}, e int")
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(axis)], f"sample {types['sample']}, at int")
    own = cells.join(F.broadcast(places), "entity").join(F.broadcast(samples), "sample").where("quant is not null and not isnan(quant)")
    rows = own.groupBy("e", "ion").agg(F.collect_list(F.struct("at", F.col("quant").cast("double").alias("v"))).alias("cells"))
    return Spread(durable(rows.select("e", "cells", F.lit(0.0).alias("effect")).sortWithinPartitions("e")), entities, axis)


def _around(x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Where a value is looked for that was x, and `before` a round ago."""
    if before is None:
        return None
    reach = 4 * np.abs(x - before) + 1e-9 * np.abs(x) + 1e-12
    return x - reach, x + reach


#: The weights of a batch's ions.
Weights = Callable[[Ions], np.ndarray]


def median_polish(data: Spread, eps: float = 1e-4, rounds: int = 1000, weights: Weights | None = None) -> np.ndarray:
    """The samples' effects plus the overall one, by entity and sample; NaN where a sample has no value.

    An ion's effect is the median of its values less the samples' effects, and a sample's effect is the median of its
    values less the ions' effects; what a sweep adds to both in turn amounts to that. An entity stops when the sum of its
    absolute residuals does.
    """
    e, s = data.shape
    effects, before, overall = np.zeros(e * s), np.zeros(e), np.zeros(e)
    old, active = None, np.ones(e, bool)
    for made_rounds in range(rounds):
        ion_effect = lambda ions, c=effects: ions.median(ions.value - c[ions.at])

        def rest(i, f=ion_effect):
            own = i.value - f(i)[i.ion]
            return (i.at, own, None) if weights is None else (i.at, np.round(own, TIES), weights(i)[i.ion])

        made = data.medians(rest, e * s, active, _around(effects, old), weights is not None)
        cells = np.repeat(active, s)
        made = np.where(cells, made, effects)
        total = data.totals(lambda i, f=ion_effect, c=made: (i.entity[i.ion], np.abs(i.value - f(i)[i.ion] - c[i.at]), None), e, active)[1]
        done = active & ((total == 0) | (np.abs(total - before) < eps * total)) if made_rounds < rounds - 1 else active
        if done.any():
            overall = np.where(done, data.medians(lambda i, f=ion_effect: (i.entity, f(i), None), e, done), overall)
        old, effects, before, active = effects, made, total, active & ~done
        if not active.any():
            break
    return effects.reshape(e, s) + overall[:, None]


def ion_weights(data: Spread, fit: np.ndarray, k: float, min_m: int) -> Weights:
    """Huber weights of ions by how far each strays from the fitted profile (entity x sample); 1 in entities of fewer than min_m ions."""
    e, s = data.shape
    fit = fit.ravel()

    def distance(i: Ions) -> np.ndarray:
        diff = i.value - fit[i.at]
        diff = diff - (i.sum(diff) / i.count)[i.ion]
        return np.where(i.count < 2, np.nan, np.sqrt(s / i.count * i.sum(diff * diff)))

    middle = data.medians(lambda i: (i.entity, distance(i), None), e)
    scale = MAD_FACTOR * data.medians(lambda i: (i.entity, np.abs(distance(i) - middle[i.entity]), None), e)
    ions = data.totals(lambda i: (i.entity, np.ones(len(i.entity)), None), e)[0]
    plain = np.isnan(scale) | (scale < TINY) | (ions < min_m)

    def weights(i: Ions) -> np.ndarray:
        with np.errstate(all="ignore"):
            u = np.abs(distance(i) / scale[i.entity])
            return np.where(plain[i.entity] | np.isnan(u) | (u <= k), 1.0, k / u)

    return weights


@dataclass
class _History:
    """Effects and scale of the rounds since ions' effects were written; the first round of all (fresh) has equal weights."""

    k: float
    prior: Weights | None
    fresh: bool
    rounds: list

    def replay(self, i: Ions) -> tuple[np.ndarray, np.ndarray]:
        """Ions' effects of the last round and of the one before."""
        one = i.effect
        for step in range(len(self.rounds)):
            effects = self.rounds[step][0]
            if step or self.fresh:
                w = np.ones(len(i.value)) if not step else self.weights(i, one, step - 1)
                before, one = one, i.sum(w * (i.value - effects[i.at])) / i.sum(w)
            else:
                before = one
        return one, before

    def weights(self, i: Ions, effect: np.ndarray, step: int = -1) -> np.ndarray:
        effects, scale = self.rounds[step]
        with np.errstate(all="ignore"):
            far = np.abs((i.value - effect[i.ion] - effects[i.at]) / scale[i.entity[i.ion]])
            w = np.minimum(1, self.k / np.maximum(far, 1e-300))
        return w if self.prior is None else w * self.prior(i)[i.ion]


def _solve(frame):
    """One entity's normal equations (samples x samples): its samples' effects, each component's level as it was."""
    import pandas as pd

    frame = frame.sort_values("s")
    system = np.stack(frame["sums"].to_list())
    start, total, right, there = system[:, -4], system[:, -3], system[:, -2], system[:, -1] > 0
    cross = system[:, :-4][np.ix_(there, there)]
    linked = np.where(cross > 0, 0.0, np.nan)
    np.fill_diagonal(linked, 0.0)
    label = components(linked)
    total = total[there]
    part = np.where(label[:, None] == np.arange(label.max() + 1), total[:, None], 0)
    keep = part / part.sum(0)
    out = np.full(len(there), np.nan)
    out[there] = np.linalg.solve(np.diag(total) - cross + part @ keep.T, right[there] + part @ (keep.T @ start[there]))
    return pd.DataFrame({"e": frame["e"].to_numpy(), "s": frame["s"].to_numpy(), "effect": out, "largest": frame["largest"].to_numpy()})


def _fit(data: Spread, weights: Callable[[Ions], tuple[np.ndarray, np.ndarray]], start: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares of values = ions + samples: every task adds up normal equations, one task solves those of an entity.

    weights: of a batch's cells, and a value per ion, of which the largest by entity comes back with the effects.
    """
    e, s = data.shape

    def run(batches):
        held, system, largest = None, None, 0.0

        def rows():
            return pa.record_batch([pa.array(np.full(s, held, np.int32)), pa.array(np.arange(s, dtype=np.int32)), pa.array(list(system), pa.list_(pa.float64())), pa.array(np.full(s, largest))], ["e", "s", "sums", "largest"])

        for ions in _ions(batches, s, active):
            w, moved = weights(ions)
            sums = ions.sum(w)
            level = ions.sum(w * ions.value) / sums
            for own, a, b in zip(*_runs(ions.entity), strict=True):
                if own != held:
                    if held is not None:
                        yield rows()
                    held, system, largest = own, np.zeros((s, s + 4)), 0.0
                largest = max(largest, moved[a:b].max())
                step = max(1, BLOCK // s)
                for at in range(a, b, step):
                    to = min(b, at + step)
                    cells = slice(ions.first[at], ions.first[to] if to < len(ions.first) else len(ions.value))
                    block = np.zeros((to - at, s))
                    block[ions.ion[cells] - at, ions.sample[cells]] = w[cells]
                    system[:, :s] += block.T @ (block / sums[at:to, None])
                    off = w[cells] * (ions.value[cells] - level[ions.ion[cells]])
                    for column, x in ((-3, w[cells]), (-2, off), (-1, np.ones(len(off)))):
                        system[:, column] += np.bincount(ions.sample[cells], x, minlength=s)
        if held is not None:
            yield rows()

    parts = data.rows.mapInArrow(run, "e int, s int, sums array<double>, largest double")
    total = F.aggregate(F.collect_list("sums"), F.array_repeat(F.lit(0.0), s + 4), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))  # a row per task
    whole = parts.groupBy("e", "s").agg(total.alias("sums"), F.max("largest").alias("largest"))
    known = np.nan_to_num(start)

    def solve(frame):
        sums = np.stack(frame["sums"].to_list())
        sums[:, -4] = known[frame["e"].to_numpy(), frame["s"].to_numpy()]
        return _solve(frame.assign(sums=list(sums)))

    if e * s * (s + 4) <= STATE:
        frames = [solve(f) for _, f in whole.toPandas().groupby("e")]
    else:
        frames = [whole.groupBy("e").applyInPandas(solve, "e int, s int, effect double, largest double").toPandas()]
    out, largest = start.copy(), np.zeros(e)
    for found in frames:
        out[found["e"], found["s"]] = found["effect"]
        largest[found["e"]] = found["largest"]
    return out, largest


def robust_fit(data: Spread, k: float = 1.345, rounds: int = 1000, prior: Weights | None = None) -> np.ndarray:
    """Huber M-estimate of the two-way model by reweighted least squares, each round solved exactly: the samples' effects, by entity.

    The scale of a round is the exact MAD of all residuals of the entity. An entity stops when neither its samples' nor its
    ions' effects move.
    """
    e, s = data.shape
    active = np.ones(e, bool)
    effects = _fit(data, lambda i: (np.ones(len(i.value)), np.zeros(len(i.entity))), np.zeros((e, s)), active)[0]
    history = _History(k, prior, True, [[np.nan_to_num(effects).ravel(), None]])
    middle = scale = old_middle = old_scale = None
    still = np.zeros(e, bool)
    for _ in range(rounds):
        rest = lambda i, h=history: i.value - h.replay(i)[0][i.ion] - h.rounds[-1][0][i.at]
        near = None
        if old_middle is not None:
            off = [4 * np.abs(x - y) + 1e-9 * np.abs(x) + 1e-12 for x, y in ((middle, old_middle), (scale, old_scale))]
            near = middle, scale, *off
        found = data.middles_and_scales(lambda i, f=rest: (i.entity[i.ion], f(i), None), e, active, near)
        old_middle, old_scale, (middle, scale) = middle, scale, found
        active = active & (MAD_FACTOR * scale >= TINY)
        if not active.any():
            break
        history.rounds[-1][1] = MAD_FACTOR * scale

        def weights(i, h=history):
            effect, before = h.replay(i)
            return h.weights(i, effect), np.abs(effect - before)

        moved, change = _fit(data, weights, effects, active)
        active = active & ~(still & (change <= TINY))  # what the round before has changed: its ions' effects are first seen now
        if not active.any():
            break
        moved = np.where(active[:, None], moved, effects)
        history.rounds.append([np.nan_to_num(moved).ravel(), None])
        still = active & (np.nan_to_num(np.abs(moved - effects)).max(1) <= TINY)
        effects = moved
        if len(history.rounds) > REPLAY:
            data, history = _written(data, history, active), _History(k, prior, False, history.rounds[-1:])
    return effects


def _written(data: Spread, history: _History, active: np.ndarray) -> Spread:
    """The rows of active entities with their ions' effects of the last round."""
    s = len(data.axis)

    def run(batches):
        for batch in batches:
            keep = pa.array(active[batch.column(0).to_numpy(zero_copy_only=False)])
            own = batch.filter(keep)
            for ions in _ions([own], s, active):
                yield own.set_column(2, "effect", pa.array(history.replay(ions)[0]))

    return Spread(durable(data.rows.mapInArrow(run, data.rows.schema)), data.entities, data.axis)


def _single(data: Spread) -> np.ndarray:
    """Which entities have one ion, whose values are the result."""
    return data.totals(lambda i: (i.entity, np.ones(len(i.entity)), None), data.shape[0])[0] == 1


METHODS = ("median_polish", "weighted_median_polish", "median_polish_short", "rlm_direct", "weighted_rlm_direct", "rlm", "weighted_rlm")


def quantify_group(cells: DataFrame, names: DataFrame, axis: list, method: str, k: float = 1.345, min_m: int = 15, p1: float | None = None, p2: float | None = None) -> DataFrame:
    """entity, sample, estimate and annotation (empty) of a group of entities, as kernels.process_matrix would give them for the direct methods."""
    data = spread(cells, names, axis)
    e, s = data.shape
    weighted, kind = method.startswith("weighted_"), method.removeprefix("weighted_")
    if kind.startswith("median_polish"):
        short = kind.endswith("short")
        eps, rounds = (0.01, 10) if short else (1e-4 if p1 is None else p1, int(1000 if p2 is None else p2))
        fit = lambda w: median_polish(data, eps, rounds, w)
    else:
        fit = lambda w: robust_fit(data, 1.345 if p1 is None else p1, int(1000 if p2 is None else p2), w)
    out = fit(None)
    if weighted:
        ions = data.totals(lambda i: (i.entity, np.ones(len(i.entity)), None), e)[0]
        out = np.where(ions[:, None] >= min_m, fit(ion_weights(data, out, k, min_m)), out)
    n, total, _ = data.totals(lambda i: (i.at, i.value, None), e * s)
    n, total = n.reshape(e, s), total.reshape(e, s)
    out = np.where(n > 0, out, np.nan)
    if method != "median_polish_short":
        with np.errstate(all="ignore"):
            out = out + (total.sum(1) / n.sum(1) - np.nansum(out, 1) / (n > 0).sum(1))[:, None]
    alone = _single(data)
    with np.errstate(all="ignore"):
        out = np.where(alone[:, None], total / n, out)
    types = dict(cells.dtypes)
    rows = [(data.entities[i], axis[j], None if np.isnan(out[i, j]) else float(out[i, j]), "") for i in range(e) for j in range(s)]
    return cells.sparkSession.createDataFrame(rows, f"entity {types['entity']}, sample {types['sample']}, estimate double, annotation string")


def quantify_large(cells: DataFrame, big: DataFrame, axis: list, method: str, **options) -> DataFrame:
    """All entities of `big` (column entity), in groups of STATE values per sample at most."""
    from quantloom.operators.reshape import row_index

    per = max(1, STATE // max(1, len(axis)))
    numbered = durable(row_index(big.select("entity"), "entity", "_no").withColumn("_group", F.floor((F.col("_no") - 1) / per)))
    out = None
    for (group,) in sorted(numbered.select("_group").distinct().collect()):
        own = quantify_group(cells, numbered.where(F.col("_group") == group), axis, method, **options)
        out = own if out is None else out.unionByName(own)
    return out
