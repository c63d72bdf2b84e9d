"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Language ID drops what has no language; near-dedup keeps one document of each group; suffix-array dedup cuts
repeated passages out of the texts; decontamination drops documents with benchmark passages; packing
lays the rest out in token sequences. A stage judges its own input: all that the stage before it has kept.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup

#: Stages share this shingle size and similarity with any near-duplicate work that has no contract of its own.
SHINGLE, PERCENT = 5, 80
#: Below 50 words, the usual length of a passage worth removing, and the grams that anchor such windows.
REPEAT_BYTES, GRAM_BYTES = 200, 96


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; drops those without text or letters, and doubtful ones."""
    return language_id.keep_identified(docs, language_id.learn_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first_of_groups(docs, SHINGLE, PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated passages cut out of their texts; n_chars follows. Documents left empty go."""
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES, GRAM_BYTES).where("text is null or text <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontaminate", benchmarks),
    ("packing", sequences),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, beside the session's checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="corpus-")
    return f"{shared.rstrip('/')}/corpus-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
