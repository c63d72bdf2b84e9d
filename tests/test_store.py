"""The store: ranges of entities without a full read or a shuffle, batches, and the directory sink's commit."""

from __future__ import annotations

import os

import pytest

from quantloom import queries
from quantloom.errors import QuantError
from quantloom.plans import pipelines
from quantloom.sources import store
from quantloom.streaming import ingest
from tests.oracle import connect, same

QUADS = "entity string, sample string, ion string, quant double, row_no int"


def quads(spark, entities=range(12), start=0):
    rows = [(f"e{e:02}", f"s{s}", f"i{e}_{i}", float(1 + (7 * e + 3 * s + i) % 11)) for e in entities for s in range(3) for i in range(4)]
    return spark.createDataFrame([(*r, start + k) for k, r in enumerate(rows)], QUADS)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def values(df) -> dict:
    return {(r["entity"], r["sample"]): None if r["estimate"] is None else round(r["estimate"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kept") / "store")
    store.write_store(quads(spark), path, buckets=4)
    return path


def test_range_is_pushed_down_and_not_shuffled(spark, kept):
    out = pipelines.store_estimates(spark, kept, "meanInt", entities=(3, 5))
    plan = plan_of(out)
    assert "hashpartitioning" not in plan and "GreaterThanOrEqual(entity_idx,3)" in plan and "LessThanOrEqual(entity_idx,5)" in plan
    assert {r["entity_idx"] for r in out.collect()} == {3, 4, 5}
    every = values(pipelines.from_store(spark, kept, "meanInt"))
    part = values(pipelines.from_store(spark, kept, "meanInt", entities=(3, 5)))
    assert len(part) == 9 and all(every[k] == v for k, v in part.items())


def test_one_entity_reads_one_bucket(spark, kept):
    some = spark.createDataFrame([(7,), (7,)], "entity_idx long")
    out = pipelines.store_estimates(spark, kept, "meanInt", entities=some)
    assert "SelectedBucketsCount: 1 out of 4" in plan_of(out) and {r["entity_idx"] for r in out.collect()} == {7}
    assert values(pipelines.from_store(spark, kept, "meanInt", entities=some)).keys() == {("e06", f"s{s}") for s in range(3)}


def test_many_chosen_entities_are_joined(spark, kept, monkeypatch):
    monkeypatch.setattr(store, "LITERALS", 1)
    some = spark.createDataFrame([(2,), (11,), (99,)], "entity_idx long")
    assert {k[0] for k in values(pipelines.from_store(spark, kept, "meanInt", entities=some))} == {"e01", "e10"}


def test_large_entities_are_read_apart(spark, kept, tmp_path):
    more = str(tmp_path / "store")
    store.write_store(quads(spark).unionByName(quads(spark, [0], 1000)), more, buckets=4)
    plain = values(pipelines.from_store(spark, more, "maxlfq"))
    apart = values(pipelines.from_store(spark, more, "maxlfq", large=20))
    assert plain.keys() == apart.keys() and all(abs(plain[k] - apart[k]) < 1e-6 for k in plain)


def test_batches_equal_one_load(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    first, second, third = quads(spark, range(5)), quads(spark, [4, 9, 2], 100), quads(spark, [9, 20], 200)
    store.write_store(first.unionByName(second).unionByName(third), one, buckets=4)
    store.write_store(first, many, buckets=4)
    for _ in range(2):  # a batch that runs again replaces itself
        store.append_store(second, many, 1)
    store.append_store(third, many, 2)
    for a, b in zip(store.read_store(spark, one), store.read_store(spark, many), strict=True):
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))
    assert values(pipelines.from_store(spark, one, "maxlfq_bit")) == values(pipelines.from_store(spark, many, "maxlfq_bit"))
    with pytest.raises(QuantError):
        store.append_store(first, many, 0)
    store.write_store(first, many, buckets=4)  # replaces all batches
    assert store.read_store(spark, many)[0].count() == 60


def test_stream_into_store_requantifies_what_changes(spark, tmp_path):
    path, mark, source = str(tmp_path / "store"), str(tmp_path / "mark"), str(tmp_path / "in")
    for k, part in enumerate((quads(spark, range(5)), quads(spark, [4, 9], 100))):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(QUADS).parquet(source)
        ingest.into_store(stream, path, mark, "maxlfq", order="row_no", buckets=4).awaitTermination()
        assert {r[0] for r in spark.read.parquet(f"{path}/estimates/batch={k}").select("entity_idx").collect()} == ({1, 2, 3, 4, 5}, {5, 6})[k]
    whole = str(tmp_path / "whole")
    store.write_store(quads(spark, range(5)).unionByName(quads(spark, [4, 9], 100)), whole, buckets=4)
    assert values(ingest.latest_estimates(spark, path)) == values(pipelines.from_store(spark, whole, "maxlfq"))


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(quads(spark, []), path, buckets=2)
    assert pipelines.from_store(spark, path, "meanInt").count() == 0 and store.store_cells(spark, path).count() == 0
    store.append_store(quads(spark, [1]), path, 1)
    assert pipelines.from_store(spark, path, "meanInt").count() == 3
    folder = str(tmp_path / "dir")
    store.write_store(quads(spark, []), path, buckets=2)
    store.write_directory(spark, path, folder)
    assert sorted(os.listdir(folder)) == ["_ion.tsv", "_protein.tsv", "_sample.tsv"] and pipelines.from_directory(spark, folder, "meanInt").count() == 0


def test_directory_quotes_ranges_and_pushdown(spark, kept, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "dir")
    rows = spark.createDataFrame([('a"b', "s 1", "i\nj", 4.5e10, 1, None), ("c", "s 1", "k", 0.1, 2, "x y")], QUADS + ", note string")
    store.write_store(rows, path, ["note"])
    store.write_directory(spark, path, folder)
    dims = [sorted(map(tuple, d.collect())) for d in store.directory_dims(spark, folder)]
    assert dims == [[(1, 'a"b', [None]), (2, "c", ["x y"])], [(1, "s 1", [])], [(1, "i\nj", []), (2, "k", [])]]
    assert sorted(map(tuple, spark.read.format("iondir").load(folder).collect())) == [(1, 1, 1, 4.5e10), (2, 1, 2, 0.1)]
    store.write_directory(spark, kept, folder)  # replaces the folder
    assert len(os.listdir(folder)) == 15 and sorted(os.listdir(tmp_path)) == ["dir", "store"]
    every, part = values(pipelines.from_directory(spark, folder, "meanInt")), values(pipelines.from_directory(spark, folder, "meanInt", entities=(11, 40)))
    assert set(part) == {(e, f"s{s}") for e in ("e10", "e11") for s in range(3)} and all(every[k] == v for k, v in part.items())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        facts = spark.read.format("iondir").option("pushdown", "true").load(folder)
        os.remove(f"{folder}/5.tsv")
        os.makedirs(f"{folder}/5.tsv")  # would fail if it were opened
        for condition, found in (("entity_idx > 9 and entity_idx <= 11", {10, 11}), ("entity_idx in (2, 7, 90)", {2, 7}), ("entity_idx = 3 and quant > 0", {3}), ("entity_idx < 1", set()), ("entity_idx in (1, 2) and entity_idx = 4", set())):
            assert {r["entity_idx"] for r in facts.where(condition).collect()} == found
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_failed_write_leaves_nothing(spark, tmp_path):
    store.register(spark)
    folder = str(tmp_path / "dir")
    lines = spark.createDataFrame([("1.tsv", "1\t1\t2.0"), ("bad/name/x.tsv", "1\t1\t2.0")], "file string, line string").coalesce(1)
    with pytest.raises(Exception, match="bad/name"):
        lines.write.format("iondir").mode("overwrite").save(folder)
    assert os.listdir(tmp_path) == []
    lines.where("file = '1.tsv'").write.format("iondir").mode("append").save(folder)
    assert os.listdir(folder) == ["1.tsv"]
    with pytest.raises(Exception, match="exists already"):
        lines.write.format("iondir").mode("append").save(folder)
    assert os.listdir(folder) == ["1.tsv"] and os.listdir(tmp_path) == ["dir"]


def test_range_of_the_query_ends_inside_a_tie(spark):
    """Suppliers 28 and 30 share places 9 and 10 of sf0.01."""
    same(connect("/root/testdata/sf0.01"), queries.queries()["store_range"](spark, "/root/testdata/sf0.01"), queries.oracle_sql()["store_range"])
