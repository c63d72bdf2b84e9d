"""Conjunctive row filters, with the rules of delimited files ("file") or of typed tables ("frame").

file: texts; empty cells compare as "". Numeric filters are strict; "NaN" passes both ways; a text counts as
the number that it begins with, or 0. frame: null and NaN never pass, and numeric filters include the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.columns import col, leading_number, require
from quantloom.errors import UnknownName
from quantloom.roles import Filters


def string_equal(name: str, value: str, mode: str = "frame") -> Column:
    return (F.coalesce(col(name), F.lit("")) if mode == "file" else col(name)) == value


def string_not_equal(name: str, value: str, mode: str = "frame") -> Column:
    return (F.coalesce(col(name), F.lit("")) if mode == "file" else col(name)) != value


def _number(name: str) -> Column:
    return col(name).cast("double")


def double_less(name: str, limit: float, mode: str = "frame") -> Column:
    if mode == "file":
        return (F.trim(F.coalesce(col(name), F.lit(""))) == "NaN") | (leading_number(col(name)) < limit)
    return (_number(name) <= limit) & ~F.isnan(_number(name))


def double_greater(name: str, limit: float, mode: str = "frame") -> Column:
    if mode == "file":
        return (F.trim(F.coalesce(col(name), F.lit(""))) == "NaN") | (leading_number(col(name)) > limit)
    return (_number(name) >= limit) & ~F.isnan(_number(name))


def apply_filters(df: DataFrame, filters: Filters, mode: str = "frame") -> DataFrame:
    """Rows that pass all filters."""
    if mode not in ("file", "frame"):
        raise UnknownName(f"no filter mode '{mode}'")
    require(df, filters.columns())
    kinds = ((string_equal, filters.equal), (string_not_equal, filters.not_equal), (double_less, filters.less), (double_greater, filters.greater))
    tests = [test(name, value, mode) for test, wanted in kinds for name, value in wanted.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def drop_empty_ids(df: DataFrame, name: str) -> DataFrame:
    """Without rows whose id is null or empty."""
    return df.where(col(name).isNotNull() & (col(name).cast("string") != ""))
