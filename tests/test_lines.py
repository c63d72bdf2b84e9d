"""Line numbers over several files and byte ranges."""

from __future__ import annotations

import pytest

from quantloom.errors import MalformedRow
from quantloom.plans import pipelines
from quantloom.roles import Roles
from quantloom.sources import delimited


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "report"
    path.mkdir()
    for k in range(3):
        lines = ["P\tS\tI\tQ", *(f"p{i % 3}\ts{i % 2}\ti{i}\t{i + 1}.5" for i in range(200))]
        if k:
            lines[150 + k] = "p\ts\ti" if k == 1 else "p\ts\ti\t1\t2"
            lines[20] = ""
        (path / f"{k}.tsv").write_text("\n".join(lines) + "\n")
    return str(path)


def test_numbers_over_files_and_ranges(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = delimited.numbered_lines(spark, folder).orderBy("place").collect()
            assert [(r["file"][-5:], r["line"]) for r in found if r["line"] > 1] == [(f"{k}.tsv", i) for k in range(3) for i in range(2, 202)]
            assert [r["place"] for r in found if r["line"] > 1] == list(range(1, 601))
            bad = delimited.malformed_lines(spark, folder).orderBy("file").collect()
            assert [(r["file"][-5:], r["line"], r["place"], r["n_fields"]) for r in bad] == [("1.tsv", 152, 351, 3), ("2.tsv", 153, 552, 5)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_failed_load_names_the_line(spark, folder):
    roles = Roles(sample="S", primary="P", secondary=("I",), intensity="Q")
    with pytest.raises(MalformedRow, match="line 152 of .*1.tsv has 3 fields instead of 4"):
        pipelines.process_long(folder, roles, spark=spark)
    with pytest.raises(MalformedRow):
        delimited.require_arity(spark, folder)
    delimited.require_arity(spark, folder + "/0.tsv")
