"""Continuous ingest of long quads into the partitioned store, and running per-sample figures.

The facts of each micro-batch are one set of Parquet files under their batch number, so a batch that runs
again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.durable import durable
from quantloom.operators.grouped import Kernel
from quantloom.plans import pipelines
from quantloom.sources import store


def ingest(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Appends a stream of entity, sample, ion, quant to <path>/batch=N/bucket=K until its input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_store(
    stream: DataFrame, path: str, checkpoint: str, method: str | Kernel | None = None, rescale: str | None = None, annotation: Iterable[str] = (), order: str | None = None, buckets: int = store.BUCKETS, **options
) -> StreamingQuery:
    """Appends a stream of entity, sample, ion, quant (raw linear values) to a Parquet store, which it starts with its first batch.

    Indices stay as they are and grow at the end, so stores of the same batches are equal. Given a method, the
    entities of each batch, and no others, are quantified anew (see latest_estimates). One stream writes a store at a time.
    order: the column that tells rows of a batch apart; without it they are ordered by entity, sample and ion.
    """
    annotation = list(annotation)

    def write(batch: DataFrame, number: int) -> None:
        rows = durable(batch if order else batch.withColumn("row_no", F.struct("entity", "sample", "ion")))  # read once from the source
        if number:
            store.append_store(rows, path, number, annotation, order or "row_no")
        else:
            store.write_store(rows, path, annotation, order or "row_no", buckets)
        if method is not None:
            requantify(rows.sparkSession, path, number, method, rescale, **options)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requantify(spark: SparkSession, path: str, batch: int, method: str | Kernel = "maxlfq_bit", rescale: str | None = None, **options) -> None:
    """Estimates of the entities that a batch has facts of, from all their facts, as <path>/estimates/batch=N."""
    changed = store.plain_facts(spark, path).where(F.col("batch") == batch).select("entity_idx")
    pipelines.store_estimates(spark, path, method, rescale, changed, **options).write.mode("overwrite").parquet(f"{path}/estimates/batch={batch}")


def latest_estimates(spark: SparkSession, path: str) -> DataFrame:
    """entity, sample, estimate of all entities and samples: each entity's are those of the last batch that changed it."""
    found, (_, names, samples, _) = spark.read.parquet(f"{path}/estimates"), store.read_store(spark, path)
    last = found.groupBy("entity_idx").agg(F.max("batch").alias("batch"))
    return pipelines.named_estimates(found.join(last, ["entity_idx", "batch"]).drop("batch"), names, samples)


def windowed_totals(stream: DataFrame, time: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Values, their sum and mean log2 per sample and time window; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, length), "sample")
    return rows.agg(F.count("quant").alias("n"), F.sum("quant").alias("total"), F.avg(F.log2("quant")).alias("mean_log2"))
