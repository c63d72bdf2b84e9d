"""Data of quality plots: histograms, per-sample box statistics and one entity's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.durable import durable, small
from quantloom.operators.normalize import exact_median, exact_quantiles


def histogram(df: DataFrame, bins: int = 100, value: str = "quant") -> DataFrame:
    """bin (from 1), lower and upper limit, n and density, of bins of equal width from the least to the largest value."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(limits))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / width) + 1)).cast("int")
    counted = rows.groupBy(at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    lower = F.col("lo") + (F.col("bin") - 1) * width
    return counted.select("bin", lower.alias("lower"), (lower + width).alias("upper"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def box_stats(df: DataFrame, value: str = "quant") -> DataFrame:
    """n, min, quartiles and max by sample: Tukey's hinges are left to the plot, quartiles interpolate."""
    df = durable(df.select("sample", value))  # narrow: it is read four times
    ends = df.groupBy("sample").agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_quantiles(df, ["sample"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, value)
    return ends.join(small(quartiles), "sample", "left").select("sample", "n", "min", "q1", "median", "q3", "max")


def cutoff_report(df: DataFrame, cutoff: float) -> DataFrame:
    """How many values each sample has, how many the cutoff leaves, and the median before."""
    counts = df.groupBy("sample").agg(F.count("quant").alias("n"), F.count_if(F.col("quant") > cutoff).alias("n_above"))
    return counts.join(small(exact_median(df, ["sample"])), "sample")


def entity_series(cells: DataFrame, entity, per_column: int = 12) -> DataFrame:
    """Lines of one entity's plot: ion, sample, quant and the legend column (from 0) of an ion, per_column ions each."""
    rows = cells.where(F.col("entity") == F.lit(entity))
    order = rows.select("entity", "ion").distinct().withColumn("at", F.row_number().over(Window.partitionBy("entity").orderBy("ion")))
    return rows.join(order, ["entity", "ion"]).select("ion", "sample", "quant", F.floor((F.col("at") - 1) / per_column).alias("legend"))
