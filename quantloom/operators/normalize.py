"""log2, cutoff and per-sample median normalisation with exact, distributed medians."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.durable import durable, small
from quantloom.errors import EmptySample, UnknownName

#: Rows of an entity or key from which no task holds them all.
LARGE = 2_000_000
#: Value ranges of a key that the first pass of an exact median counts.
RANGES = 4096


def log2_cutoff(df: DataFrame, cutoff: float | None = 0.0) -> DataFrame:
    """quant in log2; values of zero or less are missing, and so are those not above the cutoff."""
    out = df.withColumn("quant", F.log2("quant")).where("quant is not null and not isnan(quant)")
    return out if cutoff is None else out.where(F.col("quant") > cutoff)


def exact_quantiles(df: DataFrame, keys: Iterable[str], shares: dict[str, float], value: str = "quant") -> DataFrame:
    """Exact interpolated quantiles of value by key (shares: column name to share), for keys of any size; null and NaN are left out.

    A key's values are counted in RANGES equal ranges; only the ranges with the wanted ranks are then counted
    by single value. So no task ever holds a key's values, unlike a plain percentile aggregate. The three passes over
    df run when this is called; only their small results are kept, and rows meet them without a shuffle.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))
    bounds = durable(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")))  # a row per key
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / RANGES)
    at = F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(0))
    placed = rows.join(small(bounds), keys).withColumn("_range", at)
    counted = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
    wanted = reduce(Column.__or__, [holds(edge(place(p))) for p in shares.values() for edge in (F.floor, F.ceil)])
    middle = durable(counted.withColumn("_before", before).where(wanted).select(*keys, "_range", "_before"))  # two rows at most per key and share
    values = placed.join(small(middle), [*keys, "_range"]).groupBy(*keys, "_range", "_before", "_v").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = values.withColumn("_before", F.col("_before") + inner)
    pick = lambda rank: F.max(F.when(holds(rank), F.col("_v")))
    picked = found.groupBy(*keys).agg(F.first("_n").alias("_n"), *[pick(edge(place(p))).alias(f"_{side}{i}") for i, p in enumerate(shares.values()) for side, edge in (("low", F.floor), ("high", F.ceil))])
    part = lambda p: place(p) - F.floor(place(p))
    return durable(picked.select(*keys, *[(F.col(f"_low{i}") * (1 - part(p)) + F.col(f"_high{i}") * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())]))


def exact_median(df: DataFrame, keys: Iterable[str], value: str = "quant", name: str = "median") -> DataFrame:
    """The exact median of value by key, for keys of any size; null and NaN are left out."""
    return exact_quantiles(df, keys, {name: 0.5}, value)


def median_by_key(df: DataFrame, keys: Iterable[str], value: str = "quant", name: str = "median", large: int = LARGE) -> DataFrame:
    """The median of value by key: an aggregate, unless a key has `large` rows or more; they are counted first."""
    keys = list(keys)
    most = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) >= large:
        return exact_median(df, keys, value, name)
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.median(value).alias(name))


def shift_factors(df: DataFrame, value: str = "quant") -> DataFrame:
    """sample and factor: what its median lacks to the unweighted mean of all sample medians."""
    medians = exact_median(df, ["sample"], value)
    mean = medians.agg(F.avg("median").alias("mean"))
    return medians.crossJoin(F.broadcast(mean)).select("sample", (F.col("mean") - F.col("median")).alias("factor"))  # one row


def median_normalize(df: DataFrame, mode: str = "median", samples: DataFrame | None = None, on_empty_sample: str = "error") -> DataFrame:
    """Adds each sample's factor to its log2 values. samples: all samples before the cutoff.

    A sample without any value left has no median: an error by default, or it is left out ("drop").
    """
    if mode == "none":
        return df
    if mode != "median" or on_empty_sample not in ("error", "drop"):
        raise UnknownName(f"no normalisation '{mode}' with empty samples '{on_empty_sample}'")
    if samples is not None and on_empty_sample == "error":
        empty = samples.select("sample").distinct().join(df.select("sample").distinct(), "sample", "left_anti").first()
        if empty:
            raise EmptySample(f"sample '{empty[0]}' has no value above the cutoff")
    return df.join(small(shift_factors(df)), "sample").withColumn("quant", F.col("quant") + F.col("factor")).drop("factor")


def median_normalize_linear(df: DataFrame) -> DataFrame:
    """Multiplies each sample's linear values by the mean of all sample medians over its own."""
    medians = exact_median(df, ["sample"])
    mean = medians.agg(F.avg("median").alias("mean"))
    factors = medians.crossJoin(F.broadcast(mean)).select("sample", (F.col("mean") / F.col("median")).alias("factor"))  # one row
    return df.join(small(factors), "sample").withColumn("quant", F.col("quant") * F.col("factor")).drop("factor")
