"""Quantification in plain relational terms: means, top ions, pair ratios, closed-form and distributed MaxLFQ.

Input cells: entity, ion, sample, quant (log2), a row per cell. Results: entity, sample, estimate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.durable import durable, released, small
from quantloom.errors import UnknownName
from quantloom.functions.kernels import MAD_FACTOR, TINY
from quantloom.operators.grouped import Kernel, quantify_grouped
from quantloom.operators.normalize import LARGE, RANGES, exact_median, median_by_key

#: Samples up to which a task solves their system as a matrix.
DENSE = 2_000


def mean_intensity(cells: DataFrame, log_space: bool = True) -> DataFrame:
    """Mean per entity and sample, in log2 or in linear space. An entity of one ion keeps its values either way."""
    value = F.avg("quant") if log_space else F.log2(F.avg(F.pow(F.lit(2.0), "quant")))
    return cells.groupBy("entity", "sample").agg(value.alias("estimate"))


def top_n(cells: DataFrame, n: int = 3, log_space: bool = True) -> DataFrame:
    """Mean per sample of the n ions with the largest means; ties go to the smaller ion."""
    value = F.col("quant") if log_space else F.pow(F.lit(2.0), "quant")
    means = cells.groupBy("entity", "ion").agg(F.avg(value).alias("mean"))
    order = Window.partitionBy("entity").orderBy(F.desc("mean"), "ion")
    best = means.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n).select("entity", "ion")
    return mean_intensity(cells.join(best, ["entity", "ion"]), log_space)


def max_intensity(cells: DataFrame) -> DataFrame:
    return top_n(cells, 1)


def sum_intensity(cells: DataFrame) -> DataFrame:
    """log2 of the linear sum per entity and sample."""
    return cells.groupBy("entity", "sample").agg(F.log2(F.sum(F.pow(F.lit(2.0), "quant"))).alias("estimate"))


def row_completeness(cells: DataFrame, n_samples: int) -> DataFrame:
    """n_missing of every entity and ion, of so many samples."""
    return cells.groupBy("entity", "ion").agg((F.lit(n_samples) - F.count("quant")).cast("long").alias("n_missing"))


def least_missing(cells: DataFrame) -> DataFrame:
    """The values of the entity's ion with the fewest missing ones; ties go to the smaller ion."""
    counts = cells.groupBy("entity", "ion").agg(F.count("*").alias("n"))
    best = counts.groupBy("entity").agg(F.min_by("ion", F.struct((-F.col("n")).alias("n"), "ion")).alias("ion"))
    return cells.join(best, ["entity", "ion"]).select("entity", "sample", F.col("quant").alias("estimate"))


def pair_ratios(cells: DataFrame, spread: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """entity, sample_a < sample_b, ratio (median over shared ions of b - a) and n_ions.

    The values of an ion meet in one row, at most one per sample, so the pairs need no self-join. spread: medians of
    entities with any number of ions, none of which a single task holds. weights (entity, ion, weight): weighted medians, spread.
    """
    rows = cells.groupBy("entity", "ion").agg(F.array_sort(F.collect_list(F.struct("sample", "quant"))).alias("v"))
    weight = [] if weights is None else ["weight"]
    rows = rows.join(weights, ["entity", "ion"]) if weight else rows
    left = rows.select("entity", *weight, "v", F.posexplode("v").alias("at", "a"))
    both = left.select("entity", *weight, "a", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("b"))
    pairs = both.select("entity", *weight, F.col("a.sample").alias("sample_a"), F.col("b.sample").alias("sample_b"), (F.col("b.quant") - F.col("a.quant")).alias("d"))
    keys = ["entity", "sample_a", "sample_b"]
    if weight:
        pairs = durable(pairs)
        return weighted_median(pairs, keys, "d", "weight", "ratio").join(pairs.groupBy(*keys).agg(F.count("*").alias("n_ions")), keys)
    if spread:
        pairs = durable(pairs)
        return exact_median(pairs, keys, "d", "ratio").join(pairs.groupBy(*keys).agg(F.count("*").alias("n_ions")), keys)
    return pairs.groupBy(*keys).agg(F.median("d").alias("ratio"), F.count("*").alias("n_ions"))


def maxlfq_complete(cells: DataFrame) -> DataFrame:
    """MaxLFQ in closed form, of the entities in which every two samples share an ion.

    There the least squares solution is the mean of an entity's data plus the mean of a sample's ratios.
    """
    r = pair_ratios(cells)
    sides = F.array(F.struct(F.col("sample_b").alias("sample"), F.col("ratio").alias("d")), F.struct(F.col("sample_a").alias("sample"), (-F.col("ratio")).alias("d")))
    sums = r.select("entity", F.explode(sides).alias("x")).groupBy("entity", F.col("x.sample").alias("sample")).agg(F.sum("x.d").alias("b"), F.count("*").alias("links"))
    whole = cells.groupBy("entity", "sample").agg(F.sum("quant").alias("s"), F.count("*").alias("n"))
    per = whole.groupBy("entity").agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("k"))
    links = r.groupBy("entity").agg(F.count("*").alias("pairs"))
    complete = per.join(links, "entity", "left").where(F.coalesce("pairs", F.lit(0)) * 2 == F.col("k") * (F.col("k") - 1)).select("entity", "mean", "k")
    return whole.join(complete, "entity").join(sums, ["entity", "sample"], "left").select("entity", "sample", (F.col("mean") + F.coalesce(F.col("b") / F.col("k"), F.lit(0.0))).alias("estimate"))


def _from_pairs(cells: DataFrame, samples: list | None) -> DataFrame:
    """MaxLFQ of any entities from pair medians that Spark has made; a task only solves samples x samples systems."""
    import numpy as np
    import pandas as pd

    from quantloom.functions import kernels

    cells = durable(cells)
    own = cells.groupBy("entity", "sample").agg(F.sum("quant").alias("s"), F.count("*").alias("n")).join(exact_median(cells, ["entity", "sample"], name="m"), ["entity", "sample"])
    own = own.groupBy("entity").agg(F.collect_list(F.struct("sample", "s", "n", "m")).alias("data"))  # samples at most
    links = pair_ratios(cells, spread=True).groupBy("entity").agg(F.collect_list(F.struct("sample_a", "sample_b", "ratio")).alias("links"))
    types = dict(cells.dtypes)
    axis = samples

    def solve(frames):
        for frame in frames:
            out = []
            for entity, data, pairs in zip(frame["entity"], frame["data"], frame["links"], strict=True):
                data = {d["sample"]: d for d in data}
                names = axis or sorted(data)
                at = {s: i for i, s in enumerate(names)}
                r = np.full((len(names), len(names)), np.nan)
                for p in pairs if pairs is not None else []:
                    i, j = at[p["sample_a"]], at[p["sample_b"]]
                    r[i, j], r[j, i] = p["ratio"], -p["ratio"]
                linked = np.where(np.isnan(r), np.nan, 0.0)
                for i, s in enumerate(names):
                    if s in data:
                        linked[i, i] = 0.0
                label, x = kernels.components(linked), np.full(len(names), np.nan)
                for k in range(label.max() + 1):
                    own = [i for i in np.flatnonzero(label == k) if names[i] in data]
                    if len(own) == 1:
                        x[own] = data[names[own[0]]]["m"]
                    elif own:
                        rows = [data[names[i]] for i in own]
                        x[own] = kernels.solve_ratios(r[np.ix_(own, own)], sum(d["s"] for d in rows) / sum(d["n"] for d in rows))
                note = kernels.annotation(x, label)
                out += [(entity, s, v if v == v else None, note) for s, v in zip(names, x.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["entity", "sample", "estimate", "annotation"])

    return own.join(links, "entity", "left").mapInPandas(solve, f"entity {types['entity']}, sample {types['sample']}, estimate double, annotation string")


def _group_sums(df: DataFrame, **sums: Column) -> DataFrame:
    return df.groupBy("entity", "component").agg(*[F.sum(e).alias(n) for n, e in sums.items()])


def maxlfq_conjugate(cells: DataFrame, samples: list | None = None, weights: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """MaxLFQ by conjugate gradients over the table of pairs: entity, sample, component, estimate of every sample with data.

    No matrix of samples is made: the Laplacian times a vector is a join of the pairs with the vector and a sum by sample.
    Each component has its own step sizes, and stops when its squared residual is below TINY or after as many rounds as it
    has samples, and one. A component of one sample has the median of its values.
    """
    cells = durable(cells.select("entity", "ion", "sample", "quant"))
    label = durable(components(cells, samples, 0).join(cells.select("entity", "sample").distinct(), ["entity", "sample"]))
    pairs = pair_ratios(cells, spread=True, weights=weights).select("entity", "sample_a", "sample_b", "ratio")
    sides = [F.struct(F.col(f"sample_{a}").alias("sample"), F.col(f"sample_{b}").alias("other"), (F.col("ratio") * sign).alias("d")) for a, b, sign in (("b", "a", 1), ("a", "b", -1))]
    edges = durable(pairs.select("entity", F.explode(F.array(*sides)).alias("x")).select("entity", "x.*"))
    size = label.groupBy("entity", "component").agg(F.count("*").alias("samples"))
    start = edges.groupBy("entity", "sample").agg(F.count("*").alias("degree"), F.sum("d").alias("rest"))
    state = start.join(label, ["entity", "sample"]).join(size, ["entity", "component"])
    state = durable(state.select("entity", "component", "samples", "sample", "degree", F.lit(0.0).alias("x"), "rest", F.col("rest").alias("way")))
    groups, settled, made = ["entity", "component"], None, 0
    while True:
        now = _group_sums(state, size=F.col("rest") * F.col("rest")).withColumnRenamed("size", "size_now")
        state = durable(state.drop("size_now").join(small(now), groups))
        finished = (F.col("size_now") < TINY) | (F.lit(made) > F.col("samples")) | F.lit(rounds is not None and made >= (rounds or 0))
        done = state.where(finished).select("entity", "component", "sample", "x")
        settled = done if settled is None else settled.unionByName(done)
        state = state.where(~finished)
        if state.isEmpty():
            break
        vector = small(state.select("entity", F.col("sample").alias("other"), "way"))
        near = edges.join(vector, ["entity", "other"]).groupBy("entity", "sample").agg(F.sum("way").alias("near"))
        state = state.join(near, ["entity", "sample"]).withColumn("image", F.col("degree") * F.col("way") - F.col("near"))
        state = durable(state)
        step = _group_sums(state, along=F.col("way") * F.col("image"))
        moved = state.join(small(step), groups).withColumn("step", F.col("size_now") / F.col("along"))
        moved = moved.withColumns({"x": F.col("x") + F.col("step") * F.col("way"), "rest": F.col("rest") - F.col("step") * F.col("image")})
        grown = _group_sums(moved, size_next=F.col("rest") * F.col("rest"))
        moved = moved.join(small(grown), groups)
        moved = moved.withColumn("way", F.col("rest") + F.col("size_next") / F.col("size_now") * F.col("way"))
        state = durable(moved.select("entity", "component", "samples", "sample", "degree", "x", "rest", "way"))
        made += 1
    whole = cells.join(label, ["entity", "sample"]).groupBy(*groups).agg(F.avg("quant").alias("mean"))
    off = settled.groupBy(*groups).agg(F.avg("x").alias("off"))
    solved = settled.join(whole, groups).join(off, groups).select("entity", "sample", "component", (F.col("x") - F.col("off") + F.col("mean")).alias("estimate"))
    alone = label.join(size.where("samples = 1"), groups).select("entity", "sample", "component")
    single = exact_median(cells.join(alone, ["entity", "sample"]), ["entity", "sample"], name="estimate").join(alone, ["entity", "sample"])
    return solved.unionByName(single.select("entity", "sample", "component", "estimate"))


def _annotated(found: DataFrame, cells: DataFrame, axis: list) -> DataFrame:
    """Every sample of the axis, with the annotation of its entity: found has component and estimate."""
    types, spark = dict(cells.dtypes), cells.sparkSession
    places = small(spark.createDataFrame([(s, i) for i, s in enumerate(axis)], f"sample {types['sample']}, at int"))
    label = components(cells, axis, 0)
    every = label.join(found.drop("component"), ["entity", "sample"], "left").join(places, "sample")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("estimate").isNotNull(), (F.col("component") + 1).cast("string")).otherwise("NA").alias("t")))), lambda x: x["t"])
    own = F.count_distinct(F.when(F.col("estimate").isNotNull(), F.col("component")))
    notes = every.groupBy("entity").agg(F.when(own == 0, "NA").when(own == 1, "").otherwise(F.array_join(texts, ";")).alias("annotation"))
    return every.join(notes, "entity").select("entity", "sample", "estimate", "annotation")


def _leveled(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Estimates shifted so that their mean is that of all data."""
    mean = cells.groupBy("entity").agg(F.avg("quant").alias("mean")).join(found.groupBy("entity").agg(F.avg("estimate").alias("own")), "entity")
    return found.join(small(mean), "entity").withColumn("estimate", F.col("estimate") + F.col("mean") - F.col("own")).drop("mean", "own")


def _ratio_method(cells: DataFrame, axis: list, method: str, k: float = 1.345, min_m: int = 15) -> DataFrame:
    """maxlfq_bit and weighted_maxlfq of entities of any size, from pairs."""
    cells = durable(cells)
    found = maxlfq_conjugate(cells, axis)
    if method == "maxlfq_bit":
        label = components(cells, axis, 0)
        found = rescale(found.select("entity", "sample", "estimate"), cells, label, "median-mean").join(label, ["entity", "sample"])
    else:
        many = durable(cells.groupBy("entity").agg(F.count_distinct("ion").alias("n")).where(F.col("n") >= min_m).select("entity"))  # others stay as they are
        own = cells.join(small(many), "entity", "left_semi")
        again = maxlfq_conjugate(own, axis, durable(ion_weights(own, found, len(axis), k, min_m)))
        found = found.join(small(many), "entity", "left_anti").unionByName(again)
    return _annotated(_leveled(found, cells), cells, axis).withColumn("annotation", F.lit(""))


def maxlfq(cells: DataFrame, samples: list | None = None, large: int = LARGE, keep_missing: bool = True) -> DataFrame:
    """MaxLFQ of all entities: entity, sample, estimate, annotation.

    Entities of fewer than `large` cells are matrices inside tasks; larger ones are spread by ion and by pair of
    samples, so no task holds them. The sizes are counted first, and only if there are large ones is the input split.
    """
    from quantloom.operators.grouped import sample_axis

    axis = sample_axis(cells) if samples is None else samples
    big = cells.groupBy("entity").count().where(F.col("count") >= large).select("entity")
    if big.isEmpty():
        return quantify_grouped(cells, "maxLFQ", axis, keep_missing=keep_missing)
    small = quantify_grouped(cells.join(big, "entity", "left_anti"), "maxLFQ", axis, keep_missing=keep_missing)
    own = cells.join(big, "entity", "left_semi")
    rest = _from_pairs(own, axis) if len(axis) <= DENSE else _annotated(maxlfq_conjugate(own, axis), own, axis)
    return small.unionByName(rest if keep_missing else rest.where("estimate is not null"))


def by_method(cells: DataFrame, method: str | Kernel = "maxlfq_bit", samples: list | None = None, rescale: str | None = None, keep_missing: bool = True, large: int | None = LARGE, partitions: int | None = None, **options) -> DataFrame:
    """Any matrix method: entity, sample, estimate, annotation. Entities of `large` cells and more are never one task's matrix.

    They are polished and fitted over all tasks (operators.large; "rlm" takes the exact minimum there, which the published
    alternating fit may stop short of), or solved from pair medians. A function of a matrix, and rescaling, need the matrix.
    large=None: it is known that there are none. partitions: see quantify_grouped.
    """
    from quantloom.operators import large as spread_out
    from quantloom.operators.grouped import sample_axis

    ratios = ("maxLFQ", "maxlfq", "maxlfq_bit", "weighted_maxlfq")
    spread = large is not None and not callable(method) and rescale is None and method in (*spread_out.METHODS, *ratios)
    axis = sample_axis(cells) if samples is None else samples
    big = durable(cells.groupBy("entity").count().where(F.col("count") >= large).select("entity")) if spread else None
    if not spread or big.isEmpty():
        return quantify_grouped(cells, method, axis, rescale, keep_missing, partitions, **options)
    small = quantify_grouped(cells.join(big, "entity", "left_anti"), method, axis, None, keep_missing, partitions, **options)
    own = cells.join(big, "entity", "left_semi")
    if method in spread_out.METHODS:
        rest = spread_out.quantify_large(own, big, axis, method, **options)
    elif method in ratios[2:]:
        rest = _ratio_method(own, axis, method, **options)
    else:
        rest = maxlfq(own, axis, large)
    return small.unionByName(rest if keep_missing else rest.where("estimate is not null"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "estimate") -> DataFrame:
    """The interpolating weighted median by key (see kernels.weighted_median), for keys of any size; nulls and NaN are left out.

    A pass adds up the weights of a key's values in RANGES ranges of an interval, at first from the least to the largest, and
    the next one goes into the range where half of the weight is reached, until that has one value. So no task sorts a
    key, and what is kept between passes is a row per key. Equal values count as one, but for the heaviest, which comes last.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")).where("_v is not null and _w is not null and not isnan(_v) and not isnan(_w)")
    state = durable(rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    settled, own = None, Window.partitionBy(*keys).orderBy("_range")
    while not state.isEmpty():
        half = lambda c: F.col(c) / 2  # noqa: E731  differences of the largest doubles stay finite
        place = F.least(F.floor((half("_v") - half("_low")) / (half("_high") - half("_low")) * RANGES), F.lit(RANGES - 1))
        same = F.col("_high") / 2 == F.col("_low") / 2
        place = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), RANGES).when(same, (F.col("_v") > F.col("_low")).cast("int")).otherwise(place)
        placed = rows.join(small(state), keys).withColumn("_range", place.cast("int"))
        counted = placed.groupBy(*keys, "_range").agg(F.sum("_w").alias("w"), F.max("_w").alias("heaviest"), F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        counted = counted.select("*", F.sum("w").over(own).alias("c"), F.lead("_low").over(own).alias("after"), F.sum("w").over(Window.partitionBy(*keys)).alias("total"))
        fields = ["w", "heaviest", "n", "_low", "_high", "c", "after", "total"]
        found = counted.where(F.col("c") * 2 >= F.col("total")).groupBy(*keys).agg(F.min_by(F.struct(*fields), "_range").alias("x"))
        found = durable(found.select(*keys, *[F.col(f"x.{f}").alias(f) for f in fields]))
        inner = (F.col("c") * F.col("_low") + (F.col("total") - F.col("c")) * F.col("after")) / F.col("total")
        inside = F.col("after").isNull() | ((F.col("n") > 1) & ((F.col("c") - F.col("heaviest")) * 2 >= F.col("total")))
        done = found.where("_low = _high").select(*keys, F.when(inside, F.col("_low")).otherwise(inner).alias(name))
        settled = done if settled is None else settled.unionByName(done)
        state = found.where("_low < _high").select(*keys, "_low", "_high")
    return settled if settled is not None else state.select(*keys, F.col("_low").alias(name))


def mad(df: DataFrame, keys: list[str], value: str = "quant", name: str = "mad", large: int = LARGE) -> DataFrame:
    """1.4826 times the median distance to the median, by key; keys of any size."""
    off = df.join(median_by_key(df, keys, value, "_m", large), keys).select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return median_by_key(off, keys, "_d", "_d", large).select(*keys, (F.lit(MAD_FACTOR) * F.col("_d")).alias(name))


def components(cells: DataFrame, samples: list | None = None, large: int | None = LARGE) -> DataFrame:
    """entity, sample and component (from 0, by first sample) for every sample of the axis: samples that share an ion are linked.

    Entities of fewer than `large` cells (None: it is known that all are) are matrices inside tasks. Of larger ones only the distinct sets of samples that ions have are looked at. Every task joins the sets it holds of an entity, and passes on a
    forest, with fewer links than there are samples; these are joined again in a few parts, and at last in one, as they stream by.
    """
    from quantloom.operators.forest import forest, labels
    from quantloom.operators.grouped import sample_axis

    axis = sample_axis(cells) if samples is None else samples
    whole = lambda c: quantify_grouped(c, "components", axis).select("entity", "sample", F.col("estimate").cast("int").alias("component"))
    if large is None:
        return whole(cells)
    big = cells.groupBy("entity").count().where(F.col("count") >= large).select("entity")
    if big.isEmpty():
        return whole(cells)
    rest = whole(cells.join(big, "entity", "left_anti"))
    cells = cells.join(big, "entity", "left_semi")
    types, spark = dict(cells.dtypes), cells.sparkSession
    places = spark.createDataFrame([(s, i) for i, s in enumerate(axis)], f"sample {types['sample']}, at int")
    sets = cells.join(small(places), "sample").groupBy("entity", "ion").agg(F.array_sort(F.collect_set("at")).alias("set")).select("entity", "set").distinct()
    links = sets.mapInArrow(forest, f"entity {types['entity']}, set array<int>").distinct()
    for part in (["entity", F.pmod(F.hash("set"), F.lit(16))], ["entity"]):
        links = links.repartition(*part).sortWithinPartitions("entity")
        links = links.mapInArrow(forest if len(part) > 1 else labels(len(axis)), f"entity {types['entity']}, set array<int>" if len(part) > 1 else f"entity {types['entity']}, at int, component int")
    return rest.unionByName(links.join(small(places), "at").select("entity", "sample", "component"))


def ion_weights(cells: DataFrame, fit: DataFrame, n_samples: int, k: float = 1.345, min_m: int = 15) -> DataFrame:
    """entity, ion and weight: Huber weights by how far an ion strays from the fitted profile; 1 in entities of fewer than min_m ions."""
    diff = cells.join(fit.select("entity", "sample", "estimate"), ["entity", "sample"]).where("estimate is not null")
    far = F.when(F.count("*") > 1, F.sqrt(F.lit(n_samples) * F.var_pop(F.col("quant") - F.col("estimate"))))
    distance = durable(diff.groupBy("entity", "ion").agg(far.alias("d")))
    ions = distance.groupBy("entity").agg(F.count("*").alias("ions"))
    scale = mad(distance, ["entity"], "d", "s").join(ions, "entity", "right")
    plain = F.col("s").isNull() | (F.col("s") < TINY) | (F.col("ions") < min_m) | F.col("d").isNull() | (F.col("d") <= F.col("s") * k)
    return distance.join(small(scale), "entity").select("entity", "ion", F.when(plain, 1.0).otherwise(F.lit(k) * F.col("s") / F.col("d")).alias("weight"))


def by_size(rows: DataFrame, make: Callable[[DataFrame, int | None], DataFrame], large: int = LARGE) -> DataFrame:
    """make(rows, None) of the entities of fewer than `large` rows, and make(rows, large) of the others, if there are any.

    The former are hash-partitioned by entity, so that all steps of make can share this one shuffle. Rows without entity go.
    """
    rows = rows.where("entity is not null")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as in quantify_grouped, which then shuffles nothing
    together = lambda r: make(r.repartition(tasks, "entity"), None)
    big = released(rows.groupBy("entity").count().where(F.col("count") >= large).select("entity"))
    if big.isEmpty():
        return together(rows)
    big = small(big)
    return together(rows.join(big, "entity", "left_anti")).unionByName(make(rows.join(big, "entity", "left_semi"), large))


def rescale(estimates: DataFrame, cells: DataFrame, labels: DataFrame, method: str, large: int | None = LARGE) -> DataFrame:
    """Shifts each component's estimates to the level of its data, as kernels.rescale does; labels: see components.

    large=None: it is known that no entity has so many cells. Then an entity's labels travel as one map, and cells and estimates
    that are hash-partitioned by entity already (see by_size) are not shuffled again.
    """
    keys = ["entity", "component"]
    mean, total = F.avg("quant"), F.sum("quant")
    level = {"median-mean": (None, None), "median-median": (None, None), "mean-mean": (mean, mean), "sum": (total, total), "sum_exact": (total, total)}  # medians: below
    if method not in level:
        raise UnknownName(f"no rescaling method '{method}'")
    single, whole = level[method]
    own = F.sum("estimate") if method == "sum_exact" else F.avg("estimate")
    if large is None:
        by = Window.partitionBy(*keys)
        middle = lambda c: F.median(F.when(~F.isnan(c), F.col(c)))
        if method.startswith("median"):
            single, whole = middle("quant"), middle("quant") if method == "median-median" else mean
        own = middle("estimate") if method == "median-median" else own
        packed = lambda df, key, value: df.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(f"_by_{key}"))  # noqa: E731  a row per entity
        maps = packed(labels.where("sample is not null"), "sample", "component")
        place = lambda df: df.join(maps, "entity").withColumn("component", F.try_element_at("_by_sample", "sample")).where("component is not null")
        data = packed(place(cells).groupBy(*keys).agg(F.struct(single.alias("single"), whole.alias("whole")).alias("level")), "component", "level")
        known = place(estimates).withColumns({"size": F.size(F.filter(F.map_values("_by_sample"), lambda x: x == F.col("component"))), "own": own.over(by), "n": F.count("estimate").over(by)})
        out = known.join(data, "entity").withColumn("level", F.try_element_at("_by_component", "component")).where("level is not null").select("*", "level.*")
    else:
        labels = released(labels)
        placed = cells.join(labels, ["entity", "sample"])
        known = estimates.join(labels, ["entity", "sample"])
        if method.startswith("median"):
            placed = released(placed)
            data = median_by_key(placed, keys, "quant", "single").join(placed.groupBy(*keys).agg(F.avg("quant").alias("mean")), keys)
            data = data.select(*keys, "single", F.col("single" if method == "median-median" else "mean").alias("whole"))
        else:
            data = placed.groupBy(*keys).agg(single.alias("single"), whole.alias("whole"))
        now = known.groupBy(*keys).agg(own.alias("own"), F.count("estimate").alias("n"))
        if method == "median-median":
            now = now.drop("own").join(median_by_key(known, keys, "estimate", "own"), keys, "left")
        out = known.join(data, keys).join(labels.groupBy(*keys).agg(F.count("*").alias("size")), keys).join(now, keys)
    gap = (F.col("whole") - F.col("own")) / (F.col("n") if method.startswith("sum") else F.lit(1))
    value = F.when(F.col("n") == 0, F.col("estimate")).when(F.col("size") == 1, F.col("single")).otherwise(F.col("estimate") + gap)
    return out.select("entity", "sample", value.alias("estimate"))
