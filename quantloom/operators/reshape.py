"""Long and wide shapes: exploding packed measurements, dictionaries, cells and pivots."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.columns import col, require, whole_number
from quantloom.durable import durable
from quantloom.errors import DuplicateCell, UnknownName
from quantloom.roles import Roles


def pack(names: Iterable[str], separator: str = ";") -> Column:
    """Several measurement columns as one packed text; nulls as "0", so that positions stay."""
    return F.concat_ws(separator, *[F.coalesce(col(n).cast("string"), F.lit("0")) for n in names])


def split_packed(text: Column, separator: str) -> Column:
    """Slots of a packed cell; the separator is literal, trailing empty slots stay."""
    return F.split(F.coalesce(text, F.lit("")), "\\Q" + separator[0] + "\\E", -1)


def explode_packed(df: DataFrame, name: str, separator: str, ids: str | None = None) -> DataFrame:
    """One row per slot: slot_id (its position from 1, or the id at this position) and slot_value (text).

    With ids, both cells must have equally many slots.
    """
    values = split_packed(col(name).cast("string"), separator)
    if ids is None:
        rows = df.select("*", F.posexplode(values).alias("_at", "slot_value"))
        return rows.withColumn("slot_id", (F.col("_at") + 1).cast("string")).drop("_at")
    names = split_packed(col(ids).cast("string"), separator)
    same = F.when(F.size(names) == F.size(values), F.arrays_zip(names.alias("id"), values.alias("value"))).otherwise(F.raise_error(F.lit(f"'{ids}' and '{name}' have unequal numbers of slots")))
    rows = df.select("*", F.explode(same).alias("_slot"))
    return rows.select("*", F.col("_slot.id").alias("slot_id"), F.col("_slot.value").alias("slot_value")).drop("_slot")


def to_long(df: DataFrame, roles: Roles, mode: str = "frame") -> DataFrame:
    """entity, sample, ion_key, ion, quant (linear) and what else is asked for: annotations and the row order.

    Empty and "NaN" measurements go, and so do roles.na_string ones if cells are packed. In file mode, or if
    packed, the slot's position (or id) ends the ion key. ion shows the key joined by "_"; ions are told apart by
    the key itself. Texts that are no numbers are dropped.
    """
    require(df, roles.columns())
    keep = [c for c in df.columns if c == "row_no" or c in roles.annotation]
    known = [roles.primary, roles.sample, *(roles.secondary if len(roles.secondary) == 1 else [])]  # nulls among several parts of a key are NA
    rows = df.where(reduce(Column.__and__, [col(c).isNotNull() for c in known])).select(
        *[col(c) for c in keep], col(roles.primary).cast("string").alias("entity"), col(roles.sample).cast("string").alias("sample"),
        F.array(*[F.coalesce(col(c).cast("string"), F.lit("NA")) if len(roles.secondary) > 1 else col(c).cast("string") for c in roles.secondary]).alias("ion_key"),
        col(roles.intensity).alias("_quant"), *([col(roles.fragment_ids).alias("_ids")] if roles.fragment_ids else []),
    )
    if roles.separator:
        rows = explode_packed(rows, "_quant", roles.separator, "_ids" if roles.fragment_ids else None)
        value, suffix = F.col("slot_value"), F.array("slot_id")
    else:
        value, suffix = F.col("_quant"), F.array(F.lit("1")) if mode == "file" else F.array().cast("array<string>")
    text = F.trim(value.cast("string"))
    missing = value.isNull() | text.isin("", "NaN", *([roles.na_string] if roles.separator else []))
    number = whole_number(text) if dict(df.dtypes)[roles.intensity] == "string" or roles.separator else value.cast("double")
    key = F.concat("ion_key", suffix)
    rows = rows.where(~missing).select(*[col(c) for c in keep], "entity", "sample", key.alias("ion_key"), F.array_join(key, "_").alias("ion"), number.alias("quant"))
    return rows.where("quant is not null")


def dictionary(df: DataFrame, key: str, order: Column | str, extra: Iterable[str] = ()) -> DataFrame:
    """1-based index of each distinct key by first appearance in `order` (equal places: by key), with the extra columns of that first row.

    The index comes from a range sort and the sizes of its partitions, not from one task.
    """
    order = F.col(order) if isinstance(order, str) else order
    first = df.select(col(key).alias("_key"), order.alias("_order"), *[col(e) for e in extra]).groupBy("_key").agg(F.min(F.struct("_order", *[col(e) for e in extra])).alias("x"))
    ranked = first.select(F.col("_key").alias(key), F.struct("x._order", "_key").alias("_order"), *[F.col("x").getField(e).alias(e) for e in extra])
    return row_index(ranked, "_order", "index").drop("_order")


def row_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the 1-based rank of each row by a column without ties."""
    sorted_rows = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    inside = durable(sorted_rows.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order))))  # its ranges are drawn once
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    return inside.join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


CELL = ("entity", "ion", "sample")


def cells(df: DataFrame, duplicates: str = "sum", order: str = "row_no", key: Iterable[str] = CELL) -> DataFrame:
    """One row per entity, ion and sample: "sum" adds linear values, "last" takes the last by `order`, "error" raises."""
    key = list(key)
    if duplicates == "sum":
        return df.groupBy(*key).agg(F.sum("quant").alias("quant"))
    if duplicates == "last":
        return df.groupBy(*key).agg(F.max_by("quant", order).alias("quant"))
    if duplicates == "error":
        twice = df.groupBy(*key).count().where("count > 1").first()
        if twice:
            raise DuplicateCell(f"{twice['count']} values of {', '.join(f'{k} {twice[k]}' for k in key)}")
        return df.select(*key, "quant")
    raise UnknownName(f"no duplicate policy '{duplicates}'")


def duplicate_cells(df: DataFrame, key: Iterable[str] = CELL) -> DataFrame:
    """Cells with more than one value, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def log_cells(df: DataFrame) -> DataFrame:
    """log2 of linear cells; zero and negative sums are missing."""
    return df.withColumn("quant", F.log2("quant")).where("quant is not null")


def long_to_wide(df: DataFrame, samples: list, value: str = "estimate") -> DataFrame:
    """A row per entity, a column per sample in the given order."""
    return df.groupBy("entity").pivot("sample", samples).agg(F.first(value))


def in_id_order(df: DataFrame, ids: DataFrame, key: str = "entity", place: str = "place") -> DataFrame:
    """The rows of df whose key is in ids (columns key and place), in the order of place; an id without rows has one of nulls."""
    return ids.select(col(key), col(place)).join(df.drop(place), key, "left").orderBy(place)


def wide_to_long(df: DataFrame, id_column: str, quant_columns: list[str]) -> DataFrame:
    """entity, ion (the row's number), sample, quant and sample_at; rows of a null or empty id, and null values, go."""
    rows = df.where(col(id_column).isNotNull() & (col(id_column).cast("string") != "")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select(col(id_column).alias("entity"), F.col("_row").alias("ion"), *[col(c).cast("double").alias(c) for c in quant_columns])
    long = rows.unpivot(["entity", "ion"], [col(c) for c in quant_columns], "sample", "quant").where("quant is not null and not isnan(quant)")
    return long.withColumn("sample_at", F.array_position(F.array(*[F.lit(c) for c in quant_columns]), F.col("sample")))
