"""Matrix kernels as a grouped map: Spark brings an entity's cells together, a task runs the kernel, rows come back.

Cells are sorted inside the shuffle partitions and stream through mapInArrow, so small entities cost no call of
their own and a task holds one entity at a time. An entity is one matrix for the numerical kernels; MaxLFQ of
very large entities goes through pair medians instead, and polish and robust fits through passes over all tasks (see quantify.by_method).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.durable import SMALL
from quantloom.errors import UnknownName
from quantloom.functions import kernels

#: A kernel: matrix -> values per sample, or (values, annotation).
Kernel = Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, str]]


def named_kernel(method: str | Kernel, **options) -> Kernel:
    """The kernel of a method name; a function is a kernel itself."""
    if callable(method):
        return lambda x: method(x, **options)
    own: dict[str, Kernel] = {
        "maxLFQ": lambda x: kernels.maxlfq(x),
        "median_polish_short": lambda x: kernels.median_polish_short(x, **options),
        "topN": lambda x: kernels.top_n(x, **options),
        "meanInt": lambda x: kernels.mean_intensity(x, **options),
        "components": lambda x: kernels.components(x).astype(float),
    }
    if method in own:
        return own[method]
    if method in kernels.METHODS:
        return lambda x: kernels.process_matrix(x, method, **options)
    raise UnknownName(f"no method '{method}'")


def sample_axis(df: DataFrame, order: str | None = None) -> list:
    """All samples, by first appearance in `order` or by name. A table has few samples: they are matrix columns."""
    found = df.groupBy("sample").agg(F.min(order or "sample").alias("at")).collect()
    return [r["sample"] for r in sorted(found, key=lambda r: (r["at"], r["sample"]))]


def _run(kernel: Kernel, width: int, rescale: str | None, entity_type: pa.DataType):
    names = ["entity", "sample_at", "estimate", "annotation"]

    def apply(entity, sample: np.ndarray, opens: np.ndarray, quant: np.ndarray):
        row = np.cumsum(opens) - 1  # rows come sorted by ion; each of them opens where its ion does
        x = np.full((row[-1] + 1, width), np.nan)
        x[row, sample] = quant
        with np.errstate(all="ignore"):
            out = kernel(x)
            estimate, note = out if isinstance(out, tuple) else (out, "")
            if rescale:
                estimate = kernels.rescale(np.asarray(estimate, float), x, rescale)
        return entity, np.asarray(estimate, float), note

    def rows(done: list) -> pa.RecordBatch:
        value = np.concatenate([d[1] for d in done])
        value = np.where(np.isinf(value), np.nan, value)
        at = pa.array(np.repeat(np.arange(len(done)), width))
        own = pa.array([d[0] for d in done], entity_type).take(at)
        notes = pa.array([d[2] for d in done], pa.string()).take(at)
        return pa.record_batch([own, pa.array(np.tile(np.arange(width, dtype=np.int32), len(done))), pa.array(value, mask=np.isnan(value)), notes], names)

    def run(batches):
        held: list[tuple] = []
        done: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            entity, ion = batch.column(0), batch.column(2)
            sample, quant = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            code = ion.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            opens = np.concatenate([[not held or ion[0].as_py() != last], code[1:] != code[:-1]])
            last = ion[-1].as_py()
            same = pa.compute.equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(entity)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                name = entity[s].as_py()
                if held and held[0][0] != name:
                    done.append(apply(held[0][0], *(np.concatenate(c) for c in list(zip(*held, strict=True))[1:])))
                    held = []
                if not held:
                    opens[s] = True
                held.append((name, sample[s:e], opens[s:e], quant[s:e]))
            if len(done) > 2000:
                yield rows(done)
                done = []
        if held:
            done.append(apply(held[0][0], *(np.concatenate(c) for c in list(zip(*held, strict=True))[1:])))
        if done:
            yield rows(done)

    return run


def quantify_grouped(cells: DataFrame, method: str | Kernel = "maxLFQ", samples: list | None = None, rescale: str | None = None, keep_missing: bool = True, partitions: int | None = None, **options) -> DataFrame:
    """entity, sample, estimate (null: none) and annotation, for every entity and every sample of the axis.

    cells: entity, ion, sample, quant (log2), a row per cell. Ions are ordered by value inside the kernel.
    keep_missing=False leaves out samples without an estimate. Cells that are hash-partitioned by entity already, as those of a
    bucketed table, are not shuffled again if `partitions` is the number of their partitions.
    """
    spark = cells.sparkSession
    axis = sample_axis(cells) if samples is None else samples
    types = dict(cells.dtypes)
    if not axis:
        return spark.createDataFrame([], f"entity {types['entity']}, sample {types['sample']}, estimate double, annotation string")
    places = spark.createDataFrame([(s, i) for i, s in enumerate(axis)], f"sample {types['sample']}, sample_at int")
    places = F.broadcast(places) if len(axis) <= SMALL else places  # a row per sample
    ion = F.col("ion") if types["ion"] in ("int", "bigint", "string") else F.to_json(F.struct("ion"))
    rows = cells.join(places, "sample").select("entity", "sample_at", ion.alias("ion"), F.col("quant").cast("double").alias("quant"))
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of much work stay spread
    rows = rows.repartition(tasks, "entity").sortWithinPartitions("entity", "ion", "sample_at")
    kind = pa.string() if types["entity"] == "string" else pa.int64() if types["entity"] == "bigint" else pa.int32()
    found = rows.mapInArrow(_run(named_kernel(method, **options), len(axis), rescale, kind), f"entity {types['entity']}, sample_at int, estimate double, annotation string")
    if not keep_missing:
        found = found.where("estimate is not null")
    return found.join(places, "sample_at").select("entity", "sample", "estimate", "annotation")
