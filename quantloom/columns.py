"""Column helpers: names with dots, text to numbers, required columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.errors import MissingColumn, NullKey

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col(name: str) -> Column:
    """A column by its literal name (dots are no struct access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise MissingColumn(name)


def leading_number(text: Column) -> Column:
    """The number that a text begins with ("12abc": 12), or 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), _NUMBER, 1).try_cast("double"), F.lit(0.0))


def whole_number(text: Column) -> Column:
    """The text as a double, or null if it isn't a plain number."""
    text = F.trim(text)
    return F.when(text.rlike(_NUMBER + r"\s*$"), text.try_cast("double"))


def require_keys(df: DataFrame, names: Iterable[str]) -> None:
    """Raises if any of these columns has a null: one aggregate over the table."""
    names = list(names)
    found = df.agg(*[F.count_if(col(n).isNull()).alias(f"c{i}") for i, n in enumerate(names)]).first()
    for i, n in enumerate(names):
        if found[i]:
            raise NullKey(f"{found[i]} null values in column '{n}'")
