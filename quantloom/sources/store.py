"""A partitioned store of measurements: three dimension tables and facts, as Parquet or in the literal directory layout.

Parquet: <path>/entities, samples, ions and sizes (cells by entity), and facts, an external table bucketed by entity_idx and sorted inside its
files; all have a folder per batch. So a range of entities reads the row groups that hold it, one entity a single bucket, and a
bucket is a partition of the plan: nothing is shuffled to bring an entity together.
Directory: _protein.tsv, _sample.tsv, _ion.tsv and one headerless <entity index>.tsv (sample index, ion index, linear value).
"""

from __future__ import annotations

import csv
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from quantloom.durable import durable, small
from quantloom.errors import QuantError
from quantloom.operators.reshape import dictionary

BUCKETS = 64
#: Files that share a bucket of one batch at most, so that no task writes a hot entity alone.
SPREAD = 8
#: Entities that are looked up as literals, which prune buckets and row groups; more of them are joined.
LITERALS = 1000
#: Rows of the batches that the directory reader makes.
BATCH_ROWS = 1 << 16

_DIMS = (("entity", "entities"), ("sample", "samples"), ("ion", "ions"))
_SORTED = ("entity_idx", "sample_idx", "ion_idx")
_FACTS = "entity_idx bigint, sample_idx bigint, ion_idx bigint, quant double, batch int"


def _table(path: str) -> str:
    """The catalog's name of the facts at a path."""
    return f"quantloom_facts_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_store(quads: DataFrame, path: str, annotation: Iterable[str] = (), order: str = "row_no", buckets: int = BUCKETS) -> None:
    """quads: entity, sample, ion, quant (linear) and `order`. Index columns are 1-based by first appearance. Replaces what is there."""
    _write(quads, path, 0, list(annotation), order, buckets)


def append_store(quads: DataFrame, path: str, batch: int, annotation: Iterable[str] = (), order: str = "row_no") -> None:
    """Adds the quads of a batch (from 1 on): known keys keep their index, new ones follow in order of first appearance.

    A batch that runs again replaces what it wrote, as it only looks at batches before it; the annotation of a key is that of its first batch.
    """
    if batch < 1:
        raise QuantError(f"batch {batch}: appended batches count from 1")
    _write(quads, path, batch, list(annotation), order, bucket_count(quads.sparkSession, path))


def _write(quads: DataFrame, path: str, batch: int, annotation: list[str], order: str, buckets: int) -> None:
    spark, dims = quads.sparkSession, {}
    for key, name in _DIMS:
        rows = quads
        if batch:
            known = spark.read.parquet(f"{path}/{name}").where(F.col("batch") < batch)
            last = known.agg(F.max(f"{key}_idx")).first()[0] or 0
            rows = quads.join(known.select(key), key, "left_anti")
        found = dictionary(rows, key, order, annotation if key == "entity" else ()).withColumnRenamed("index", f"{key}_idx")
        _save(found.withColumn(f"{key}_idx", F.col(f"{key}_idx") + last) if batch else found, f"{path}/{name}", batch)
        dims[key] = spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= batch)
    facts = quads.select("entity", "sample", "ion", "quant")
    for key in dims:
        facts = facts.join(dims[key].select(key, f"{key}_idx"), key)
    facts = facts.select(*_SORTED, "quant", F.lit(batch).alias("batch"))
    spread = facts.repartition(F.pmod(F.hash("entity_idx"), F.lit(buckets)), F.pmod(F.xxhash64("sample_idx", "ion_idx"), F.lit(SPREAD)))
    if batch:
        _open(spark, path, buckets)
        spread.drop("batch").createOrReplaceTempView(f"{_table(path)}_new")
        spark.sql(f"insert overwrite table {_table(path)} partition (batch = {batch}) select * from {_table(path)}_new")
        spark.catalog.dropTempView(f"{_table(path)}_new")
    else:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
        spread.write.mode("overwrite").partitionBy("batch").bucketBy(buckets, "entity_idx").sortBy(*_SORTED).option("path", f"{path}/facts").saveAsTable(_table(path))
    _save(plain_facts(spark, path).where(F.col("batch") == batch).groupBy("entity_idx").agg(F.count("*").alias("n")), f"{path}/sizes", batch)


def _save(df: DataFrame, path: str, batch: int) -> None:
    """The rows of one batch; the first one replaces all that is there."""
    if not batch:
        nothing = df.sparkSession.createDataFrame([], df.schema).withColumn("batch", F.lit(0))
        nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(path)
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets of the facts of a store."""
    return spark.read.parquet(f"{path}/layout").first()["buckets"]


def _open(spark: SparkSession, path: str, buckets: int) -> str:
    """Enters the facts of a path into the catalog, with all batches that are there now."""
    spark.sql(f"create table if not exists {_table(path)} ({_FACTS}) using parquet partitioned by (batch) clustered by (entity_idx) sorted by ({', '.join(_SORTED)}) into {buckets} buckets location '{path}/facts'")
    spark.sql(f"msck repair table {_table(path)} sync partitions")
    spark.catalog.refreshTable(_table(path))
    return _table(path)


def plain_facts(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as plain files: a task takes as much of a bucket as fits its share, so a hot entity is spread."""
    return spark.read.schema(_FACTS).parquet(f"{path}/facts")


def bucketed_facts(spark: SparkSession, path: str) -> DataFrame:
    """entity_idx, sample_idx, ion_idx, quant and batch, as a bucketed table of the session's catalog (external: the files stay where they are)."""
    return spark.table(_open(spark, path, bucket_count(spark, path)))


def of_entities(facts: DataFrame, entities: tuple[int, int] | DataFrame | None) -> DataFrame:
    """Facts of a range of entity indices (both ends included), or of those in a DataFrame's entity_idx; None: all."""
    if entities is None:
        return facts
    if isinstance(entities, tuple):
        return facts.where(F.col("entity_idx").between(*entities))
    some = entities.select("entity_idx").distinct()
    listed = [r[0] for r in some.limit(LITERALS + 1).collect()]
    return facts.where(F.col("entity_idx").isin(listed)) if len(listed) <= LITERALS else facts.join(small(durable(some)), "entity_idx", "left_semi")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts and the entity, sample and ion dimensions."""
    return plain_facts(spark, path).drop("batch"), *(spark.read.parquet(f"{path}/{name}").drop("batch") for _, name in _DIMS)


def store_cells(spark: SparkSession, path: str) -> DataFrame:
    """entity, sample, ion, quant (linear) of a store."""
    facts, entities, samples, ions = read_store(spark, path)
    out = facts.join(entities.select("entity", "entity_idx"), "entity_idx").join(samples.select("sample", "sample_idx"), "sample_idx").join(ions.select("ion", "ion_idx"), "ion_idx")
    return out.select("entity", "sample", "ion", "quant")


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class DirectoryReader(DataSourceReader):
    """Reads entity files of an index range in each task; a missing file is an entity without values."""

    def __init__(self, path: str, parts: int, first: int = 1, last: int | None = None):
        self.path, self.parts, self.first, self.last = path, parts, first, last
        self.only: set[int] | None = None

    def partitions(self) -> list[_Range]:
        with open(f"{self.path}/_protein.tsv", newline="") as lines:
            n = sum(1 for _ in csv.reader(lines, delimiter="\t")) - 1
        first, last = max(1, self.first), n if self.last is None else min(n, self.last)
        if self.only is not None:
            first, last = max(first, min(self.only, default=last + 1)), min(last, max(self.only, default=0))
        step = max(1, -(-(last - first + 1) // self.parts))
        return [_Range(i, min(last, i + step - 1)) for i in range(first, last + 1, step)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no ranges
            return
        types = {"sample_idx": pa.int64(), "ion_idx": pa.int64(), "quant": pa.float64()}
        parse, convert = pyarrow.csv.ParseOptions(delimiter="\t", quote_char=False), pyarrow.csv.ConvertOptions(column_types=types, null_values=["NA"])
        held: list[pa.RecordBatch] = []
        for entity in range(partition.start, partition.end + 1):
            file = f"{self.path}/{entity}.tsv"
            if self.only is not None and entity not in self.only or not os.path.exists(file) or not os.path.getsize(file):
                continue
            for batch in pyarrow.csv.open_csv(file, pyarrow.csv.ReadOptions(column_names=list(types), use_threads=False), parse, convert):
                held.append(pa.record_batch([pa.repeat(pa.scalar(entity, pa.int64()), batch.num_rows), *batch.columns], ["entity_idx", *types]))
                if sum(b.num_rows for b in held) >= BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class PrunedReader(DirectoryReader):
    """Also takes conditions on entity_idx out of the plan: files of other entities are not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("entity_idx",):
                yield f
            elif isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                last = f.value - isinstance(f, LessThan)
                self.last = last if self.last is None else min(self.last, last)
            else:
                yield f


class DimensionReader(DataSourceReader):
    """The lines of one dimension file, numbered from 1; its header's other columns are the annotation."""

    def __init__(self, path: str):
        self.path = path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, newline="") as lines:
            rows = csv.reader(lines, delimiter="\t")
            next(rows)
            for i, (key, *rest) in enumerate(rows, 1):
                yield i, key, [None if x == "NA" else x for x in rest]


class _Written(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class DirectoryWriter(DataSourceArrowWriter):
    """Writes lines (file, line; sorted by file in a task) as files of a folder, which appears whole or not at all.

    A task writes below <path>.part-<job>/<attempt> and moves a file beside its fellows once it is complete, so an attempt that runs again
    replaces what an earlier one left. The commit is one rename; an aborted job removes its own folder.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        if os.path.exists(self.path) and not overwrite:
            raise QuantError(f"'{self.path}' exists already")
        self.part = f"{self.path}.part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, own = f"{self.part}/done", f"{self.part}/{uuid.uuid4().hex}"
        os.makedirs(done, exist_ok=True)
        os.makedirs(own)
        name, out, files = None, None, 0

        def close() -> None:
            out.close()
            os.replace(f"{own}/{name}", f"{done}/{name}")

        for batch in iterator:
            at = batch.column(0).dictionary_encode()
            code = at.indices.to_numpy()
            cuts = [0, *((code[1:] != code[:-1]).nonzero()[0] + 1).tolist(), len(code)] if len(code) else [0]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if at[s].as_py() != name:
                    if out:
                        close()
                    name, files = at[s].as_py(), files + 1
                    out = open(f"{own}/{name}", "w", newline="")  # noqa: SIM115
                out.write("\n".join(batch.column(1).slice(s, e - s).to_pylist()) + "\n")
        if out:
            close()
        os.rmdir(own)
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(f"{self.part}/done", exist_ok=True)
        if os.path.exists(self.path):
            os.rename(self.path, f"{self.part}/old")
        os.rename(f"{self.part}/done", self.path)
        shutil.rmtree(self.part, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.part, ignore_errors=True)


class DirectoryStore(DataSource):
    """spark.read.format("iondir").load(path): entity_idx, sample_idx, ion_idx, quant. The path must be mounted on all executors.

    option("table", "protein" | "sample" | "ion"): index, key and annotation (array) of that dimension instead.
    option("first", i), option("last", j): entities of that range only. option("pushdown", "true"): conditions on entity_idx do the
    same, in sessions with spark.sql.python.filterPushdown.enabled. Writing takes (file, line), see DirectoryWriter.
    """

    @classmethod
    def name(cls) -> str:
        return "iondir"

    def schema(self) -> str:
        return "index long, key string, annotation array<string>" if "table" in self.options else "entity_idx long, sample_idx long, ion_idx long, quant double"

    def reader(self, schema) -> DataSourceReader:
        if "table" in self.options:
            return DimensionReader(f"{self.options['path']}/_{self.options['table']}.tsv")
        kind = PrunedReader if self.options.get("pushdown", "false").lower() == "true" else DirectoryReader
        last = self.options.get("last")
        return kind(self.options["path"], int(self.options.get("partitions", "64")), int(self.options.get("first", "1")), None if last is None else int(last))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DirectoryWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DirectoryStore)


def _field(df: DataFrame, name: str) -> Column:
    """A value as it stands in a dimension file: texts in quotes, nulls as NA."""
    text = F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"')) if dict(df.dtypes)[name] == "string" else F.col(name).cast("string")
    return F.coalesce(text, F.lit("NA"))


def write_directory(spark: SparkSession, store: str, path: str) -> None:
    """The literal layout of a Parquet store, on a mounted folder: one job writes all files, each by one task, and replaces what is there."""
    register(spark)
    facts, *dims = read_store(spark, store)
    lines = facts.select(F.concat("entity_idx", F.lit(".tsv")).alias("file"), F.col("sample_idx").alias("at"), F.col("ion_idx").alias("then"), F.concat_ws("\t", "sample_idx", "ion_idx", F.col("quant").cast("string")).alias("line"))
    heads = []
    for (key, _), name, dim in zip(_DIMS, ("_protein.tsv", "_sample.tsv", "_ion.tsv"), dims, strict=True):
        columns = [key, *[c for c in dim.columns if c not in (key, f"{key}_idx")]]
        heads.append((name, 0, 0, "\t".join(f'"{c}"' for c in columns)))
        lines = lines.unionByName(dim.select(F.lit(name).alias("file"), F.col(f"{key}_idx").alias("at"), F.lit(0).alias("then"), F.concat_ws("\t", *[_field(dim, c) for c in columns]).alias("line")))
    lines = lines.unionByName(spark.createDataFrame(heads, "file string, at long, then long, line string"))
    lines.repartition("file").sortWithinPartitions("file", "at", "then").select("file", "line").write.format("iondir").mode("overwrite").save(path)


def directory_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, samples and ions of the literal layout with their 1-based indices, and annotation."""
    register(spark)
    read = lambda table, key: spark.read.format("iondir").option("table", table).load(path).withColumnsRenamed({"index": f"{key}_idx", "key": key})
    return read("protein", "entity"), read("sample", "sample"), read("ion", "ion")
