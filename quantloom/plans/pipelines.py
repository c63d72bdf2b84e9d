"""The whole ways from a report to a table: long format, wide format, the store, and step by step.

Each is one lazy plan of operators; long ones cut nothing but the dictionaries of the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.columns import col, require, require_keys
from quantloom.durable import durable, small
from quantloom.errors import UnknownName
from quantloom.operators import annotate, normalize, quantify, reshape
from quantloom.operators.grouped import Kernel, sample_axis
from quantloom.operators.predicates import apply_filters
from quantloom.roles import DIANN, DIANN_PARQUET, Roles
from quantloom.sources import delimited, store

RELATIONAL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "maxLFQ": quantify.maxlfq, "meanInt": quantify.mean_intensity, "top3": quantify.top_n, "top5": lambda c: quantify.top_n(c, 5),
    "maxInt": quantify.max_intensity, "sum": quantify.sum_intensity, "least_na": quantify.least_missing,
}


def quantify_cells(cells: DataFrame, method: str | Kernel = "maxLFQ", **options) -> DataFrame:
    """Any method by name (relational, or a matrix kernel) or a function of a matrix: entity, sample, estimate, ..."""
    if method in RELATIONAL and not options:
        return RELATIONAL[method](cells)
    return quantify.by_method(cells, method, **options)


def load_quads(source: DataFrame | str, roles: Roles, spark: SparkSession | None = None) -> tuple[DataFrame, str]:
    """Filtered linear quads of a tab-separated path or of a DataFrame, and the mode of rules that applied."""
    if isinstance(source, str):
        rows, mode = delimited.read_delimited(spark or SparkSession.active(), source), "file"
    else:
        rows, mode = source, "frame"
    require(rows, roles.columns())
    return reshape.to_long(apply_filters(rows, roles.filters, mode), roles, mode), mode


def _loaded(quads: DataFrame, source: DataFrame | str) -> DataFrame:
    """A checkpoint of loaded quads. If a file fails, its text is read once more, and the error names the line."""
    try:
        return durable(quads)
    except Exception:
        if isinstance(source, str):
            delimited.require_arity(quads.sparkSession, source)
        raise


def preprocess(quads: DataFrame, cutoff: float | None = 0.0, normalization: str = "median", on_empty_sample: str = "error") -> DataFrame:
    """log2, cutoff and median normalisation of linear quads, which are read several times: keep them first if they are dear."""
    if normalization not in ("median", "none"):
        raise UnknownName(f"no normalisation '{normalization}'")
    logged = normalize.log2_cutoff(quads, cutoff)
    return normalize.median_normalize(logged, normalization, quads, on_empty_sample)


@dataclass
class LongResult:
    """estimates: entity, sample, estimate, annotation. stats: by entity. table(): the wide table to write."""

    estimates: DataFrame
    stats: DataFrame
    samples: list
    annotations: DataFrame | None

    def table(self, primary: str = "entity") -> DataFrame:
        wide = reshape.long_to_wide(self.estimates, self.samples)
        out = wide.join(self.stats, "entity", "left")
        if self.annotations is not None:
            out = out.join(self.annotations, "entity", "left")
        values = [c for c in out.columns if c not in ("entity", *map(str, self.samples))]
        return out.select(col("entity").alias(primary), *[col(c) for c in values], *[col(str(s)) for s in self.samples])


def process_long(
    source: DataFrame | str, roles: Roles = DIANN, normalization: str = "median", cutoff: float | None = 0.0, method: str | Kernel = "maxLFQ", peptide_extractor: Callable[[Column], Column] | None = None,
    fasta: DataFrame | None = None, duplicates: str | None = None, output: str | None = None, spark: SparkSession | None = None, on_empty_sample: str = "error",
) -> LongResult:
    """From a long report to estimates, with statistics of fragments and, given sequences, coverage.

    duplicates: "last" of a cell's values for ordered files, else "error"; output writes the wide table there.
    """
    quads, mode = load_quads(source, roles, spark)
    quads = _loaded(quads, source)  # filtered and narrow: medians, statistics and cells read it again
    kept = preprocess(quads, cutoff, normalization, on_empty_sample)
    policy = duplicates or ("last" if mode == "file" else "error")
    cells = reshape.cells(kept, policy)
    samples = sample_axis(kept, "row_no" if "row_no" in kept.columns else None)
    estimates = quantify_cells(cells, method)
    order = "row_no" if "row_no" in quads.columns else "ion"
    stats = annotate.fragment_stats(quads, peptide_extractor, order)
    if fasta is not None and peptide_extractor is not None:
        groups = stats.select("entity", F.split("peptides", ";").alias("peptides"))
        stats = stats.join(annotate.coverage(groups, fasta), "entity", "left")
    notes = annotate.first_match(quads, "entity", roles.annotation, order) if roles.annotation else None
    result = LongResult(estimates, stats, samples, notes)
    if output:
        delimited.write_wide(result.table(roles.primary), output)
    return result


def to_store(source: DataFrame | str, path: str, roles: Roles = DIANN_PARQUET, normalization: str = "median", cutoff: float | None = 0.0, spark: SparkSession | None = None) -> None:
    """Writes the store of a report; "none" skips log2 and cutoff and stores raw values."""
    quads, _ = load_quads(source, roles, spark)
    if normalization != "none":
        quads = preprocess(_loaded(quads, source), cutoff, normalization).withColumn("quant", F.pow(F.lit(2.0), "quant"))
    if "row_no" not in quads.columns:
        quads = quads.withColumn("row_no", F.struct("entity", "sample", "ion"))
    store.write_store(quads, path, roles.annotation)


def _estimates(facts: DataFrame, samples: DataFrame, method: str | Kernel, rescale: str | None, options: dict) -> DataFrame:
    """entity_idx, sample_idx, estimate: equal cells are summed, all samples of the dimension make the axis."""
    linear = reshape.cells(facts, "sum", key=("entity_idx", "ion_idx", "sample_idx"))
    linear = linear.select(F.col("entity_idx").alias("entity"), F.col("ion_idx").alias("ion"), F.col("sample_idx").alias("sample"), "quant")
    axis = [r[0] for r in samples.select("sample_idx").orderBy("sample_idx").collect()]  # the columns of the result
    found = quantify.by_method(reshape.log_cells(linear), method, axis, rescale, **options)
    return found.select(F.col("entity").alias("entity_idx"), F.col("sample").alias("sample_idx"), "estimate")


def named_estimates(found: DataFrame, entities: DataFrame, samples: DataFrame, chosen: tuple[int, int] | DataFrame | None = None) -> DataFrame:
    """Estimates of all entities (of those chosen) and samples by their names; entities without values have null rows."""
    own = store.of_entities(entities.select("entity", "entity_idx"), chosen)
    every = own.join(F.broadcast(samples.select("sample", "sample_idx")), F.lit(True))  # the result's own shape
    return every.join(found, ["entity_idx", "sample_idx"], "left").select("entity", "sample", "estimate")


def store_estimates(spark: SparkSession, path: str, method: str | Kernel = "maxlfq_bit", rescale: str | None = None, entities: tuple[int, int] | DataFrame | None = None, large: int = quantify.LARGE, **options) -> DataFrame:
    """entity_idx, sample_idx, estimate of a Parquet store, or of some of its entities (see store.of_entities), without a shuffle of the facts.

    A bucket is a task. Entities of `large` facts and more, which the store's sizes tell, are read apart, without buckets, and spread.
    """
    samples = spark.read.parquet(f"{path}/samples")
    sizes = spark.read.parquet(f"{path}/sizes").groupBy("entity_idx").agg(F.sum("n").alias("n")).where(F.col("n") >= large)
    big = durable(store.of_entities(sizes.select("entity_idx"), entities))
    facts, whole = store.of_entities(store.bucketed_facts(spark, path), entities), big.isEmpty()
    rest = facts if whole else facts.join(small(big), "entity_idx", "left_anti")
    found = _estimates(rest, samples, method, rescale, {**options, "large": None, "partitions": store.bucket_count(spark, path)})
    if whole:
        return found
    return found.unionByName(_estimates(store.of_entities(store.plain_facts(spark, path), big), samples, method, rescale, {**options, "large": large}))


def from_store(spark: SparkSession, path: str, method: str | Kernel = "maxlfq_bit", rescale: str | None = None, entities: tuple[int, int] | DataFrame | None = None, **options) -> DataFrame:
    """Estimates of a Parquet store, or of a range of its entity indices (or those in a DataFrame's entity_idx): only these are read."""
    _, names, samples, _ = store.read_store(spark, path)
    return named_estimates(store_estimates(spark, path, method, rescale, entities, **options), names, samples, entities)


def from_directory(spark: SparkSession, path: str, method: str | Kernel = "maxlfq_bit", rescale: str | None = None, entities: tuple[int, int] | None = None, **options) -> DataFrame:
    """Estimates of the literal directory layout, or of a range of its entities: files of others are not opened."""
    names, samples, _ = store.directory_dims(spark, path)
    read = spark.read.format("iondir")
    if entities:
        read = read.option("first", entities[0]).option("last", entities[1])
    return named_estimates(_estimates(read.load(path), samples, method, rescale, options), names, samples, entities)


def process_wide(source: DataFrame, id_column: str, quant_columns: list[str], method: str | Kernel = "maxLFQ", is_log: bool = False, annotation: Iterable[str] = (), **options) -> DataFrame:
    """Collapses rows of one id: entity, sample, estimate of every id, and annotation columns of its first row."""
    annotation = list(annotation)
    require(source, [id_column, *quant_columns, *annotation])
    long = reshape.wide_to_long(source, id_column, quant_columns)
    long = long if is_log else reshape.log_cells(long)
    out = quantify_cells(long.select("entity", "ion", "sample", "quant"), method, **options)
    if annotation:
        out = annotate.annotate(out, source.withColumn("_at", F.monotonically_increasing_id()), id_column, annotation, "_at")
    return out


def create_table(quads: DataFrame, method: str | Kernel = "maxLFQ", **options) -> DataFrame:
    """The step-by-step way: normalised quads to estimates; a duplicate cell or a null key is an error."""
    require_keys(quads, ["entity", "sample", "ion", "quant"])
    return quantify_cells(reshape.cells(quads, "error"), method, **options)
