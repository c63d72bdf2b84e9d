"""First-match annotation, fragment statistics and sequence coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.columns import col, require
from quantloom.errors import UnknownName


def first_match(df: DataFrame, id_column: str, annotation: Iterable[str], order: str | Column) -> DataFrame:
    """One row per id: its annotation columns as in the id's first row by `order`."""
    annotation = list(annotation)
    require(df, [id_column, *annotation])
    order = F.col(order) if isinstance(order, str) else order
    rows = df.groupBy(col(id_column).alias("_id")).agg(F.min_by(F.struct(*[col(a) for a in annotation]), order).alias("x"))
    return rows.select(F.col("_id").alias(id_column), *[F.col("x").getField(a).alias(a) for a in annotation])


def annotate(result: DataFrame, source: DataFrame, id_column: str, annotation: Iterable[str], order: str | Column, strict: bool = True) -> DataFrame:
    """result (column entity) with annotation columns; strict: an entity without a match is an error."""
    table = first_match(source, id_column, annotation, order).withColumnRenamed(id_column, "_id")
    if strict:
        lost = result.join(table, result["entity"].cast("string") == table["_id"].cast("string"), "left_anti").first()
        if lost:
            raise UnknownName(f"no annotation row has the id '{lost['entity']}'")
    return result.join(table, result["entity"].cast("string") == table["_id"].cast("string"), "left").drop("_id")


def rows_of_ids(groups: DataFrame, ids: str, rows: DataFrame, key: str, separator: str = ";") -> DataFrame:
    """The rows whose key is in a group's packed id list, with the group's other columns; an id twice in a list counts twice."""
    require(groups, [ids])
    require(rows, [key])
    listed = groups.select("*", F.explode(F.split(col(ids), "\\Q" + separator + "\\E", -1)).alias("_member")).drop(ids)
    return listed.join(rows, F.trim("_member") == col(key).cast("string")).drop("_member")


def strip_from_digit(ion: Column) -> Column:
    """A peptide extractor: what stands before the first digit, without what follows an underscore or a bracket."""
    return F.regexp_replace(F.regexp_replace(ion, r"\([^)]*\)|\[[^\]]*\]", ""), r"[0-9_].*$", "")


def fragment_stats(quads: DataFrame, extractor: Callable[[Column], Column] | None = None, order: str = "row_no") -> DataFrame:
    """n_fragments per entity; with an extractor also n_peptides, peptides (by first appearance) and XIC (sum of raw values).

    Keyed by entity, so entities that lose all values later disturb nobody.
    """
    if extractor is None:
        return quads.groupBy("entity").agg(F.count_distinct("ion").alias("n_fragments"))
    rows = quads.withColumn("peptide", extractor(F.col("ion")))
    per = rows.groupBy("entity", "peptide", "ion").agg(F.min(order).alias("at"), F.sum("quant").alias("xic"))
    per = per.groupBy("entity", "peptide").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.sum("xic").alias("xic"))
    return per.groupBy("entity").agg(
        F.sum("n").alias("n_fragments"), F.count("*").alias("n_peptides"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "peptide"))), lambda x: x["peptide"]), ";").alias("peptides"), F.sum("xic").alias("xic"),
    )


def hits(sequence: str, peptides: Iterable[str]) -> int:
    """Positions of the sequence inside non-overlapping occurrences of any peptide, each peptide's taken from the left.

    One pass of an automaton of all peptides; memory goes with their letters and the sequence's, not with their product.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in peptides:
        if p:  # nulls and empty ones cover nothing
            automaton.add_word(p, (len(p), p))
    if not len(automaton):
        return 0
    automaton.make_automaton()
    free: dict[str, int] = {}  # where a peptide may start again
    reach = [0] * (len(sequence) + 1)  # where an occurrence that starts here ends
    for last, (size, p) in automaton.iter(sequence):
        start = last + 1 - size
        if start >= free.get(p, 0):
            free[p] = last + 1
            reach[start] = max(reach[start], last + 1)
    count = end = 0
    for start, to in enumerate(reach):
        if to > end:
            count += to - max(start, end)
            end = to
    return count


def covered(sequence: Column, peptides: Column) -> Column:
    """Percent (half to even) of the sequence's positions that its peptides (array) cover; null without a sequence, 0 for an empty one."""

    @F.arrow_udf("int")
    def percent(texts: pa.Array, listed: pa.Array) -> pa.Array:
        found = []
        for s, p in zip(texts, listed, strict=True):
            text = s.as_py()
            found.append(None if text is None else round(100 * hits(text, p.as_py() or ()) / len(text)) if text else 0)
        return pa.array(found, pa.int32())

    return percent(sequence, peptides)


def coverage(groups: DataFrame, fasta: DataFrame) -> DataFrame:
    """entity and coverage ("NN%;0%"): for every accession of the entity's ";"-list, how much its peptides (array) cover.

    fasta: accession, sequence. An accession without a sequence, or with an empty one, has 0%.
    """
    rows = groups.select("entity", "peptides", F.posexplode(F.split(F.col("entity").cast("string"), ";")).alias("at", "accession"))
    found = rows.join(fasta.dropDuplicates(["accession"]), "accession", "left")
    share = F.coalesce(covered(F.col("sequence"), F.col("peptides")), F.lit(0))
    texts = found.select("entity", F.struct("at", F.concat(share.cast("string"), F.lit("%")).alias("text")).alias("x"))
    return texts.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ";").alias("coverage"))
