"""quantify() in SQL: the rows and types of the grouped map, a shared axis, and errors that name the call."""

from __future__ import annotations

import pytest

from quantloom import sql
from quantloom.operators.grouped import quantify_grouped

CALL = "quantify(table(select * from sql_cells) partition by (entity), {})"


@pytest.fixture(scope="module")
def cells(spark):
    sql.register(spark)
    rows = [(e, f"i{i}", 1990 + s, float((5 * e + 3 * i + 7 * s) % 13) + i / 8) for e in range(6) for i in range(5) for s in range(4) if (e + i + s) % 4]
    table = spark.createDataFrame(rows, "entity long, ion string, sample int, quant double")
    table.createOrReplaceTempView("sql_cells")
    return table


def rows(df):
    return sorted(((r["entity"], r["sample"], None if r["estimate"] is None else round(r["estimate"], 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("method", ["maxLFQ", "rlm", "median_polish", "topN", "maxlfq_bit"])
def test_equals_the_grouped_map_typed(spark, cells, method):
    found = spark.sql(f"select * from {CALL.format(repr(method) + ', array(1990, 1991, 1992, 1993)')}")
    assert found.dtypes == [("entity", "bigint"), ("sample", "int"), ("estimate", "double")]
    assert rows(found) == rows(quantify_grouped(cells, method))


def test_axis(spark, cells):
    own = spark.sql("select * from quantify(table(select * from sql_cells where entity = 0 and sample <> 1991) partition by (entity), 'meanInt')")
    assert {r["sample"] for r in own.collect()} == {1990, 1992, 1993}
    given = spark.sql(f"select * from {CALL.format("'meanInt', array(1993, 2000, 1990, 1993)")} where entity = 0")
    assert sorted((r["sample"], r["estimate"] is None) for r in given.collect()) == [(1990, False), (1993, False), (2000, True)]


def test_errors_and_empty(spark, cells):
    for call, text in (("'nothing'", "no method"), ("'rlm', array(entity)", "constants")):
        with pytest.raises(Exception, match=text):
            spark.sql(f"select f.* from (select 1 as entity) t, lateral {CALL.format(call)} f").collect()
    with pytest.raises(Exception, match="quant"):
        spark.sql("select * from quantify(table(select entity, ion, sample from sql_cells) partition by (entity), 'rlm')")
    with pytest.raises(Exception, match="two values"):
        spark.sql("select * from quantify(table(select * from sql_cells union all select * from sql_cells) partition by (entity), 'rlm')").collect()
    assert spark.sql("select * from quantify(table(select * from sql_cells where quant is null) partition by (entity), 'rlm')").count() == 0
