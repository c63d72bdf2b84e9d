"""Tab-separated reports (also gzipped) as all-text DataFrames, with strict arity and the order of rows.

The first of several equal column names wins; names keep their case and dots. A row with a missing or an extra field
fails the load when strict, whichever columns are used. Null cells of the reader are empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.columns import col
from quantloom.durable import small
from quantloom.errors import MalformedRow

#: Orders rows as they stand in their files.
ROW_ORDER = "row_no"


def header(spark: SparkSession, path: str) -> list[str]:
    """The names of the first line."""
    line = spark.read.text(path).first()
    return line[0].rstrip("\r").split("\t") if line else []


def read_delimited(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All columns as text, and row_no (file, block and row: comparable within one read).

    Names that differ in case only make the session case-sensitive, as Spark cannot tell them apart otherwise.
    """
    names, seen = header(spark, path), set()
    if len({n.lower() for n in names}) < len(set(names)):
        spark.conf.set("spark.sql.caseSensitive", "true")
    own = []
    for i, n in enumerate(names):
        own.append(f"\0{i}" if n in seen else n)
        seen.add(n)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in own])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    rows = spark.read.schema(schema).option("columnPruning", str(not strict).lower()).csv(path, sep="\t", header=True, quote="", mode=mode)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*[F.coalesce(col(n), F.lit("")).alias(n) for n in own if not n.startswith("\0")], order.alias(ROW_ORDER))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (in its file, from 1), place (from 1, over all files by name, each without its header) and text of every line.

    Lines are counted by byte range, and running sums over the ranges give each its first number: a row per range, so
    no line moves for its number, and a task that runs again gives the same ones.
    """
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    ranges = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    ranges = ranges.select("file", "block", "first", above(own).alias("in_file"), above(before).alias("in_all"), F.dense_rank().over(Window.orderBy("file")).alias("files"))
    placed = lines.join(small(ranges), ["file", "block"]).withColumn("at", F.col("id") - F.col("first") + 1)
    return placed.select("file", (F.col("at") + F.col("in_file")).alias("line"), (F.col("at") + F.col("in_all") - F.col("files")).alias("place"), "text")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, place, n_fields and text of the lines that a strict load fails on; blank lines are none."""
    expected = len(header(spark, path))
    lines = numbered_lines(spark, path).withColumn("n_fields", F.size(F.split("text", "\t", -1)))
    return lines.where((F.col("line") > 1) & (F.col("n_fields") != expected) & F.col("text").rlike(r"[^\x00-\x20]")).select("file", "line", "place", "n_fields", "text")


def require_arity(spark: SparkSession, path: str) -> None:
    """Raises an error that names the first malformed line, by file name and line: one pass over the text."""
    worst = malformed_lines(spark, path).orderBy("file", "line").first()
    if worst:
        raise MalformedRow(worst["file"], worst["line"], worst["n_fields"], len(header(spark, path)))


def observed(rows: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """rows, and what is counted as they first pass: n_rows, and about how many entities and samples."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("entity").alias("n_entities"), F.approx_count_distinct("sample").alias("n_samples")), seen


def write_wide(df: DataFrame, path: str) -> None:
    """One tab-separated file in a folder: header, no quotes, nulls as NA. Meant for results, a row per entity."""
    texts = [F.coalesce(col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns]
    df.select(*texts).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def default_output(path: str) -> str:
    """Where the result of an input goes if nothing else is said."""
    return f"{path}-quant.tsv"


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide table with inferred types; NA is null."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, nullValue="NA")
