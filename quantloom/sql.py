"""The SQL surface: a table function that quantifies, and aggregates for interactive use.

    SELECT * FROM quantify(TABLE(SELECT entity, ion, sample, quant FROM cells) PARTITION BY (entity), 'rlm')
    SELECT * FROM quantify(TABLE(SELECT entity, ion, sample, quant FROM cells) PARTITION BY (entity), 'maxlfq', array(1992, 1993, 1994))
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quantloom.errors import MissingColumn, QuantError, UnknownName


@dataclass
class _Call(AnalyzeResult):
    """What a call says once: the method, the samples in their order (None: those of each entity), and where the columns are."""

    method: str = "maxLFQ"
    samples: list | None = None
    names: tuple = ()


class Quantify:
    """One partition is one entity. The result has the types of the input's entity and sample, and a row for each sample of the axis.

    Cells are kept as two numbers and a value; ions are put in the order of their values, as in quantify_grouped. With an axis given,
    cells of other samples are left out. Two values of a cell are an error.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, method: AnalyzeArgument, samples: AnalyzeArgument | None = None) -> _Call:
        from quantloom.operators.grouped import named_kernel

        if not row.isTable:
            raise QuantError("the first argument of quantify is a table")
        names = {f.name.lower(): f for f in row.dataType.fields}
        for name in ("entity", "ion", "sample", "quant"):
            if name not in names:
                raise MissingColumn(name)
        if not method.isConstantExpression or samples is not None and not samples.isConstantExpression:
            raise QuantError("method and samples of quantify are constants")
        if method.value is None:
            raise UnknownName("quantify needs a method")
        named_kernel(method.value)  # an unknown name fails here
        fields = [T.StructField("entity", names["entity"].dataType), T.StructField("sample", names["sample"].dataType), T.StructField("estimate", T.DoubleType())]
        axis = None if samples is None or samples.value is None else list(dict.fromkeys(samples.value))
        return _Call(T.StructType(fields), method=method.value, samples=axis, names=tuple(names[n].name for n in ("entity", "ion", "sample", "quant")))

    def __init__(self, call: _Call):
        self.call = call
        self.entity = None
        self.ions: dict = {}
        self.samples: dict = {} if call.samples is None else {s: i for i, s in enumerate(call.samples)}
        self.cells = (array("q"), array("q"), array("d"))

    def eval(self, row, method, samples=None):
        entity, ion, sample, quant = (row[n] for n in self.call.names)
        self.entity = entity
        if self.call.samples is not None and sample not in self.samples or quant is None:
            return
        for held, value in zip(self.cells, (self.ions.setdefault(ion, len(self.ions)), self.samples.setdefault(sample, len(self.samples)), quant), strict=True):
            held.append(value)

    def terminate(self):
        from quantloom.operators.grouped import named_kernel

        if not self.cells[0]:
            return
        order = lambda values: sorted(values, key=lambda v: (v is not None, v))  # noqa: E731  nulls first
        axis = order(self.samples) if self.call.samples is None else self.call.samples
        row, column = np.empty(len(self.ions), int), np.empty(len(axis), int)
        for held, places in ((self.ions, row), (self.samples, column)):
            for at, value in enumerate(order(held) if held is self.ions else axis):
                places[held[value]] = at
        x = np.full((len(row), len(column)), np.nan)
        at = row[np.frombuffer(self.cells[0], np.int64)], column[np.frombuffer(self.cells[1], np.int64)]
        if len(np.unique(at[0] * len(column) + at[1])) < len(at[0]):
            raise QuantError(f"entity {self.entity} has two values of one ion and sample")
        x[at] = np.frombuffer(self.cells[2])
        with np.errstate(all="ignore"):
            out = named_kernel(self.call.method)(x)
        for sample, value in zip(axis, out[0] if isinstance(out, tuple) else out, strict=True):
            yield self.entity, sample, float(value) if np.isfinite(value) else None


def weighted_median_udf():
    """weighted_median(value, weight) as a grouped aggregate for bounded groups."""
    from quantloom.functions import kernels

    @F.pandas_udf("double")
    def weighted_median(value: pd.Series, weight: pd.Series) -> float:
        return float(kernels.weighted_median(value.to_numpy(float), weight.to_numpy(float)))

    return weighted_median


def register(spark: SparkSession) -> None:
    """quantify() and weighted_median() in SQL, and the directory store as a format."""
    from quantloom.sources import store

    spark.udtf.register("quantify", F.udtf(Quantify, useArrow=True))
    spark.udf.register("weighted_median", weighted_median_udf())
    store.register(spark)
