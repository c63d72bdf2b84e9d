"""One test for each rule of missing values, filters, packed cells, duplicates and names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantloom import errors
from quantloom.operators import annotate, grouped, normalize, predicates, qc, quantify, reshape
from quantloom.plans import pipelines
from quantloom.roles import Filters, Roles
from quantloom.sources import delimited, store

ROLES = Roles(sample="S", primary="P.G", secondary=("I.a", "I.b"), intensity="Q", annotation=("Name",))


def tsv(path, text: str) -> str:
    path.write_bytes(text.encode())
    return str(path)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("value", "less", "greater"), [("NaN", True, True), ("0.01", False, False), ("", True, False), ("0.005", True, False), ("0.5x", False, True), ("abc", True, False)])
def test_file_filters(spark, value, less, greater):
    df = spark.createDataFrame([(value,)], "`Q.v` string")
    assert bool(predicates.apply_filters(df, Filters(less={"Q.v": 0.01}), "file").count()) == less
    assert bool(predicates.apply_filters(df, Filters(greater={"Q.v": 0.01}), "file").count()) == greater


@pytest.mark.parametrize(("value", "less", "greater"), [(float("nan"), False, False), (0.01, True, True), (None, False, False), (0.005, True, False)])
def test_frame_filters(spark, value, less, greater):
    df = spark.createDataFrame([(value,)], "`Q.v` double")
    assert bool(predicates.apply_filters(df, Filters(less={"Q.v": 0.01})).count()) == less
    assert bool(predicates.apply_filters(df, Filters(greater={"Q.v": 0.01})).count()) == greater


def test_string_filters_and_missing_column(spark):
    df = spark.createDataFrame([("x",), (None,), ("",)], "a string")
    assert predicates.apply_filters(df, Filters(equal={"a": ""}), "file").count() == 2
    assert predicates.apply_filters(df, Filters(not_equal={"a": "x"}), "file").count() == 2
    assert predicates.apply_filters(df, Filters(not_equal={"a": "x"})).count() == 1
    with pytest.raises(errors.MissingColumn, match="nope"):
        predicates.apply_filters(df, Filters(equal={"nope": "x"}))
    with pytest.raises(errors.UnknownName):
        predicates.apply_filters(df, Filters(), "other")


HEAD = "P.G\tS\tI.a\tI.b\tQ\tName\n"


def test_scan_keeps_order_names_and_line_ends(spark, tmp_path):
    path = tsv(tmp_path / "r.tsv", "P.G\tb\tB\tP.G\r\np1\tx\ty\tsecond\r\np2\t\tz\tother")
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["P.G", "b", "B", "row_no"]
    assert [tuple(r) for r in df.orderBy("row_no").select("`P.G`", "b", "B").collect()] == [("p1", "x", "y"), ("p2", "", "z")]


@pytest.mark.parametrize("row", ["p1\ts1\ta", "p1\ts1\ta\tb\t5\tn\textra"])
def test_wrong_arity_fails_whatever_is_selected(spark, tmp_path, row):
    df = delimited.read_delimited(spark, tsv(tmp_path / "r.tsv", HEAD + "p1\ts1\ta\tb\t5\tn\n" + row + "\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        df.select("S").collect()


def test_scalar_intensity_in_a_file(spark, tmp_path):
    lines = ["p1\ts1\ta_b\tc\t4\tfirst", "p1\ts1\ta\tb_c\t8\tlater", "p1\ts1\tx\ty\t0\tlater", "p1\ts1\tx\tz\tNaN\tn", "p1\ts1\tx\tw\t\tn", "p1\ts1\tx\tv\tabc\tn"]
    quads, mode = pipelines.load_quads(tsv(tmp_path / "r.tsv", HEAD + "\n".join(lines)), ROLES, spark)
    assert mode == "file"
    assert got(quads, "ion", "quant") == [("a_b_c_1", 4.0), ("a_b_c_1", 8.0), ("x_y_1", 0.0)]
    assert quads.select("ion_key").distinct().count() == 3  # two keys show alike
    assert got(normalize.log2_cutoff(quads), "quant") == [(2.0,), (3.0,)]
    assert got(annotate.first_match(quads, "entity", ["Name"], "row_no"), "entity", "Name") == [("p1", "first")]


def test_packed_intensity(spark, tmp_path):
    path = tsv(tmp_path / "r.tsv", HEAD + "p1\ts1\ta\tb\t0;5;;7;NaN;\tn\n")
    quads, _ = pipelines.load_quads(path, ROLES.but(separator=";"), spark)
    assert got(quads, "ion", "quant") == [("a_b_2", 5.0), ("a_b_4", 7.0)]
    frame = spark.createDataFrame([("p", "s", "i", "5;6", "m;n"), ("p", "s", "j", "1;2;3", "m;n")], "P string, S string, I string, Q string, ids string")
    roles = Roles(sample="S", primary="P", secondary=("I",), intensity="Q", separator=";", fragment_ids="ids")
    assert got(reshape.to_long(frame.where("I = 'i'"), roles), "ion", "quant") == [("i_m", 5.0), ("i_n", 6.0)]
    with pytest.raises(Exception, match="unequal"):
        reshape.to_long(frame, roles).collect()


def test_frame_nulls_in_ion_parts(spark):
    frame = spark.createDataFrame([("p", "s", None, "b", 2.0), ("p", "s", "a", "b", float("nan")), (None, "s", "a", "b", 2.0)], "`P.G` string, S string, `I.a` string, `I.b` string, Q double")
    assert got(reshape.to_long(frame, ROLES.but(annotation=())), "ion") == [("NA_b",)]
    assert reshape.to_long(frame, ROLES.but(annotation=(), secondary=("I.a",))).count() == 0


def test_observed_ingest(spark):
    rows, seen = delimited.observed(long(spark, [("p", "a", "s1", 1.0), ("q", "a", "s1", 2.0)]))
    rows.count()
    assert seen.get == {"n_rows": 2, "n_entities": 2, "n_samples": 1}


def test_duplicate_policies(spark):
    df = spark.createDataFrame([("p", "i", "s", 3.0, 1), ("p", "i", "s", 5.0, 2), ("p", "j", "s", 1.0, 3)], "entity string, ion string, sample string, quant double, row_no int")
    assert got(reshape.cells(df, "sum"), "ion", "quant") == [("i", 8.0), ("j", 1.0)]
    assert got(reshape.cells(df, "last"), "ion", "quant") == [("i", 5.0), ("j", 1.0)]
    with pytest.raises(errors.DuplicateCell):
        reshape.cells(df, "error")
    with pytest.raises(errors.UnknownName):
        reshape.cells(df, "any")


def long(spark, rows):
    return spark.createDataFrame(rows, "entity string, ion string, sample string, quant double")


def test_normalisation_and_empty_sample(spark):
    df = long(spark, [("p", str(i), "A", q) for i, q in enumerate((2.0, 4.0, 8.0))] + [("p", str(i), "B", q) for i, q in enumerate((16.0, 64.0))])
    out = pipelines.preprocess(df)
    assert got(out, "sample", "quant") == [("A", 2.5), ("A", 3.5), ("A", 4.5), ("B", 2.5), ("B", 4.5)]
    with pytest.raises(errors.EmptySample, match="C"):
        pipelines.preprocess(df.union(long(spark, [("p", "0", "C", 0.5)])))
    assert pipelines.preprocess(df.union(long(spark, [("p", "0", "C", 0.5)])), on_empty_sample="drop").count() == 5
    assert got(pipelines.preprocess(df, None, "none"), "quant")[0] == (1.0,)
    with pytest.raises(errors.UnknownName):
        pipelines.preprocess(df, normalization="quantile")


def test_exact_median(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("k%d" % (i % 3), float(x)) for i, x in enumerate(np.round(rng.normal(0, 5, 1001), 2))] + [("one", 7.0), ("same", 1.0), ("same", 1.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, quant double")
    found = dict(got(normalize.exact_median(df, ["k"]), "k", "median"))
    want = {r["k"]: r["m"] for r in df.where("not isnan(quant) and quant is not null").groupBy("k").agg(F.median("quant").alias("m")).collect()}
    assert found == pytest.approx(want) and "none" not in found


@pytest.mark.parametrize("large", [2_000_000, 1])
def test_maxlfq_both_ways(spark, large):
    df = long(spark, [("m1", "a", "s1", 10.0), ("m1", "a", "s2", 12.0), ("m1", "b", "s1", 12.0), ("m1", "b", "s3", 10.0), ("m2", "a", "s1", 10.0), ("m2", "a", "s2", 12.0), ("m2", "b", "s1", 11.0), ("m2", "b", "s2", 13.5), ("m2", "c", "s3", 20.0)])
    out = quantify.maxlfq(df, ["s1", "s2", "s3"], large)
    values = {(r["entity"], r["sample"]): r["estimate"] for r in out.collect()}
    assert values == pytest.approx({("m1", "s1"): 11, ("m1", "s2"): 13, ("m1", "s3"): 9, ("m2", "s1"): 10.5, ("m2", "s2"): 12.75, ("m2", "s3"): 20})
    assert dict(got(out.select("entity", "annotation").distinct(), "entity", "annotation")) == {"m1": "", "m2": "1;1;2"}


def test_sample_axis_keeps_or_drops_empty_samples(spark):
    df = long(spark, [("p", "a", "s1", 10.0), ("p", "b", "s1", 11.0)])
    assert quantify.maxlfq(df, ["s0", "s1"]).count() == 2
    assert got(quantify.maxlfq(df, ["s0", "s1"], keep_missing=False), "sample", "estimate") == [("s1", 10.5)]
    assert quantify.maxlfq(df.where("false")).count() == 0


def test_unknown_method_and_user_function(spark):
    df = long(spark, [("p", "a", "s1", 10.0), ("p", "b", "s1", 12.0)])
    with pytest.raises(errors.UnknownName):
        grouped.quantify_grouped(df, "best")
    assert got(grouped.quantify_grouped(df, lambda x: x.max(axis=0)), "estimate") == [(12.0,)]


def test_create_table_wants_keys_and_single_cells(spark):
    with pytest.raises(errors.NullKey):
        pipelines.create_table(long(spark, [("p", None, "s", 1.0)]))
    with pytest.raises(errors.DuplicateCell):
        pipelines.create_table(long(spark, [("p", "i", "s", 1.0), ("p", "i", "s", 2.0)]))
    assert got(pipelines.create_table(long(spark, [("p", "i", "s", 1.0), ("p", "j", "s", 2.0)]), "top3"), "estimate") == [(1.5,)]


def test_coverage(spark):
    groups = spark.createDataFrame([("P1;P2", ["AB", "BC", "zz"])], "entity string, peptides array<string>")
    fasta = spark.createDataFrame([("P1", "ABCDAB"), ("P3", "")], "accession string, sequence string")
    assert got(annotate.coverage(groups, fasta), "coverage") == [("83%;0%",)]
    halves = spark.createDataFrame([("P1", ["A"])], "entity string, peptides array<string>")
    assert got(annotate.coverage(halves, spark.createDataFrame([("P1", "ABBBBBBB")], "accession string, sequence string")), "coverage") == [("12%",)]


def test_process_long_from_a_file(spark, tmp_path):
    lines = [f"{p}\t{s}\t{i}\t1\t{2 ** q};0\tname {p} {k}" for k, (p, s, i, q) in enumerate([("p2", "s2", "x", 4), ("p2", "s1", "x", 3), ("p1", "s1", "x", 5), ("p1", "s2", "x", 6), ("p1", "s1", "y", 2), ("p0", "s1", "y", 0)])]
    path = tsv(tmp_path / "r.tsv", HEAD + "\n".join(lines))
    result = pipelines.process_long(path, ROLES.but(separator=";"), normalization="none", peptide_extractor=annotate.strip_from_digit, output=str(tmp_path / "out"), spark=spark)
    assert result.samples == ["s2", "s1"]
    estimates = {(r["entity"], r["sample"]): r["estimate"] for r in result.estimates.collect()}
    assert estimates == pytest.approx({("p2", "s2"): 4, ("p2", "s1"): 3, ("p1", "s1"): 13 / 3, ("p1", "s2"): 13 / 3} | {k: v for k, v in estimates.items() if k[0] == "p1"})
    stats = {r["entity"]: r.asDict() for r in result.stats.collect()}
    assert stats["p0"]["n_fragments"] == 1 and stats["p1"]["n_peptides"] == 2 and stats["p1"]["peptides"] == "x;y"
    (written,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    head, *body = written.read_text().splitlines()
    assert head.split("\t")[0] == "P.G" and len(body) == 2 and '"' not in head
    assert delimited.default_output("a.tsv") == "a.tsv-quant.tsv"


def test_process_wide(spark):
    wide = spark.createDataFrame([("p", 1.0, 4.0, "n"), ("p", None, 16.0, "m"), (None, 1.0, 1.0, "x"), ("", 1.0, 1.0, "x"), ("q", 0.0, 2.0, "k")], "id string, a double, b double, name string")
    out = pipelines.process_wide(wide, "id", ["a", "b"], "maxInt", annotation=["name"])
    assert got(out, "entity", "sample", "estimate", "name") == [("p", "b", 4.0, "n"), ("q", "b", 1.0, "k")]


def test_store_both_layouts(spark, tmp_path):
    quads = spark.createDataFrame([("p2", "s1", "i1", 4.0, 1), ("p1", "s2", "i2", 8.0, 2), ("p2", "s2", "i1", 2.0, 3), ("p2", "s2", "i1", 2.0, 4)], "entity string, sample string, ion string, quant double, row_no int")
    path = str(tmp_path / "store")
    store.write_store(quads, path)
    entities = store.read_store(spark, path)[1]
    assert got(entities, "entity_idx", "entity") == [(1, "p2"), (2, "p1")]
    out = pipelines.from_store(spark, path, "maxlfq")
    assert got(out.where("entity = 'p2'"), "sample", "estimate") == [("s1", 2.0), ("s2", 2.0)]
    assert out.count() == 4
    folder = str(tmp_path / "dir")
    store.write_directory(spark, path, folder)
    store.register(spark)
    back = spark.read.format("iondir").load(folder)
    assert got(back, "entity_idx", "sample_idx", "ion_idx", "quant") == [(1, 1, 1, 4.0), (1, 2, 1, 2.0), (1, 2, 1, 2.0), (2, 2, 2, 8.0)]
    assert got(store.directory_dims(spark, folder)[0], "entity_idx", "entity") == [(1, "p2"), (2, "p1")]
    assert got(pipelines.from_directory(spark, folder, "maxlfq"), "entity", "sample", "estimate") == got(out, "entity", "sample", "estimate")


def test_to_store_raw_and_normalised(spark, tmp_path):
    frame = spark.createDataFrame([("p", "s", "i", 0.5), ("p", "s", "j", 4.0)], "P string, S string, I string, Q double")
    roles = Roles(sample="S", primary="P", secondary=("I",), intensity="Q")
    pipelines.to_store(frame, str(tmp_path / "raw"), roles, "none")
    assert store.store_cells(spark, str(tmp_path / "raw")).count() == 2
    pipelines.to_store(frame, str(tmp_path / "norm"), roles)
    assert got(store.store_cells(spark, str(tmp_path / "norm")), "quant") == [(4.0,)]


def test_qc(spark):
    df = long(spark, [("p", str(i), "s", float(i)) for i in range(11)])
    bins = got(qc.histogram(df, 5), "bin", "n")
    assert bins == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)]
    assert abs(sum(r["density"] * 2 for r in qc.histogram(df, 5).collect()) - 1) < 1e-9
    assert got(qc.box_stats(df), "q1", "median", "q3") == [(2.5, 5.0, 7.5)]


def test_stream_ingest(spark, tmp_path):
    from quantloom.streaming import ingest

    long(spark, [("p", "i", "s", 1.0), ("q", "i", "s", 2.0)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, ion string, sample string, quant double").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out")), "entity", "quant") == [("p", 1.0), ("q", 2.0)]


def test_ties_of_top_ions_go_to_the_first_by_value(spark):
    """Text ions are ordered by themselves inside a matrix, also across Arrow batches."""
    rows = [("e", ion, s, v) for ion in ("b", "a", "c") for s, v in (("x", {"a": 1.0, "b": 3.0, "c": 2.0}[ion]), ("y", {"a": 3.0, "b": 1.0, "c": 2.0}[ion]))]
    rows += [("f", f"i{k:03}", "x", float(k)) for k in range(50)]
    table = spark.createDataFrame(rows, "entity string, ion string, sample string, quant double")
    from quantloom.operators.grouped import quantify_grouped

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {(r["entity"], r["sample"]): r["estimate"] for r in quantify_grouped(table, "topN", n=1).collect()}
        count = {r["entity"]: r["estimate"] for r in quantify_grouped(table, lambda x: [float(len(x))] * x.shape[1]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {("e", "x"): 1.0, ("e", "y"): 3.0, ("f", "x"): 49.0, ("f", "y"): None}
    assert count == {"e": 3.0, "f": 50.0}


def test_coverage_by_many_peptides():
    import random
    import tracemalloc

    from quantloom.operators.annotate import hits

    def plain(text, peptides):
        marked = set()
        for p in peptides:
            at = text.find(p)
            while at >= 0:
                marked |= set(range(at, at + len(p)))
                at = text.find(p, at + len(p))
        return len(marked)

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abé") for _ in range(rng.randrange(40)))
        peptides = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(6))}
        assert hits(text, peptides) == plain(text, peptides), (text, peptides)
    assert hits("aaaaa", ["aa"]) == 4 and hits("", ["a"]) == 0 and hits("abc", ["", "x"]) == 0
    text = "".join(rng.choice("ACDEFGHIKL") for _ in range(100_000))
    peptides = [text[i : i + 30] for i in range(0, 90_000, 90)]
    tracemalloc.start()
    assert hits(text, peptides) == 30 * len(peptides)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_whole_numbers_are_plain_decimals(spark):
    from quantloom.columns import whole_number

    good = {"1": 1.0, " 2.5 ": 2.5, "-.5": -0.5, "+3.": 3.0, "1e3": 1000.0, "4E-1": 0.4, "1e999": float("inf")}
    bad = ["", " ", "1d", "1F", "0x1p3", "0X1P3", "NaN", "nan", "inf", "-Infinity", "1,5", "1 2", "e5", "abc", "--1", "1e", "."]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]] + [(None,)], "t string").select("t", whole_number(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows if r["x"] is not None} == good
