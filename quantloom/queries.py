"""Queries of the quantification engine on the test tables, with their DuckDB SQL.

Scenarios map table columns to entity, ion, sample and quant: A (brand, part, year, price), B (supplier, part,
year, price), C (part, supplier, year, price), E (nation, customer's order, priority, price), F (event type, user, weekday,
value). Estimates are rounded to 6 digits, as both engines add floats in their own order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import oracles as O
from quantloom import sql as sql_surface
from quantloom.durable import released
from quantloom.operators import annotate, normalize, qc, quantify, reshape
from quantloom.operators import predicates as P
from quantloom.operators.grouped import quantify_grouped, sample_axis
from quantloom.plans import pipelines
from quantloom.roles import Filters, Roles
from quantloom.sources import delimited

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(value: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits).alias(name)


def _long(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """entity, ion, sample, quant and row_no (an explicit key, as Parquet rows have no order in SQL)."""
    if which == "E":
        rows = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(F.col("c_nationkey").alias("entity"), F.col("o_custkey").alias("ion"), F.col("o_orderpriority").alias("sample"), F.col("o_totalprice").alias("quant"))
    if which == "F":
        return _t(spark, sf, "events").select(F.col("event_type").alias("entity"), F.col("user_id").alias("ion"), F.dayofweek("ts").alias("sample"), F.col("value").alias("quant"))
    rows = _t(spark, sf, "lineitem")
    row_no = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_no")  # line numbers repeat here
    if which == "A":
        rows = rows.join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        entity, ion = "p_brand", "l_partkey"
    else:
        entity, ion = ("l_suppkey", "l_partkey") if which == "B" else ("l_partkey", "l_suppkey")
    return rows.select(F.col(entity).alias("entity"), F.col(ion).alias("ion"), F.year("l_shipdate").alias("sample"), F.col("l_extendedprice").alias("quant"), row_no)


_ROWS = {
    "A": "select p_brand as entity, l_partkey as ion, cast(year(l_shipdate) as int) as sample, l_extendedprice as quant, l_orderkey, l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row_no from lineitem join part on l_partkey = p_partkey",
    "B": "select l_suppkey as entity, l_partkey as ion, cast(year(l_shipdate) as int) as sample, l_extendedprice as quant, l_orderkey, l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row_no from lineitem",
    "C": "select l_partkey as entity, l_suppkey as ion, cast(year(l_shipdate) as int) as sample, l_extendedprice as quant, l_orderkey, l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as row_no from lineitem",
    "E": "select c_nationkey as entity, o_custkey as ion, o_orderpriority as sample, o_totalprice as quant from orders join customer on o_custkey = c_custkey",
    "F": "select event_type as entity, user_id as ion, cast(dayofweek(ts) + 1 as int) as sample, value as quant from events",
}


def _cells(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """log2 of summed cells."""
    return reshape.log_cells(reshape.cells(_long(spark, sf, which), "sum"))


def _cte(which: str, *more: str) -> str:
    """rows t and log2 cells c of a scenario, and more common table expressions."""
    own = [f"t as ({_ROWS[which]})", "c as (select entity, ion, sample, log2(s) as quant from (select entity, ion, sample, sum(quant) as s from t group by all) where s > 0)", *more]
    return "with recursive " + ", ".join(own) + " "


# Filters --------------------------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_linenumber"]


def _filter_query(name: str, filters: Filters, where: str, mode: str = "frame") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return P.apply_filters(_t(spark, sf, "lineitem"), filters, mode).select(*_LINE)

    run.__name__ = name
    _query(f"select l_orderkey, l_linenumber from lineitem where {where}")(run)


_filter_query("filter_string_equal", Filters(equal={"l_returnflag": "R"}), "l_returnflag = 'R'")
_filter_query("filter_string_not_equal", Filters(not_equal={"l_returnflag": "R"}), "l_returnflag <> 'R'")
_filter_query("filter_double_less_inclusive", Filters(less={"l_discount": 0.04}), "l_discount <= 0.04")
_filter_query("filter_double_greater_inclusive", Filters(greater={"l_tax": 0.05}), "l_tax >= 0.05")


def _text_filter(name: str, filters: Filters, where: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _t(spark, sf, "lineitem").withColumns({"l_discount": F.col("l_discount").cast("string"), "l_tax": F.col("l_tax").cast("string")})
        return P.apply_filters(rows, filters, "file").select(*_LINE)

    run.__name__ = name
    _query(f"select l_orderkey, l_linenumber from lineitem where {where}")(run)


_text_filter("filter_double_less_strict", Filters(less={"l_discount": 0.04}), "l_discount < 0.04")
_text_filter("filter_double_greater_strict", Filters(greater={"l_tax": 0.05}), "l_tax > 0.05")


@_query("select c_custkey from customer where case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then '' else c_name end <> ''")
def drop_null_id(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    return P.drop_empty_ids(_t(spark, sf, "customer").withColumn("c_name", name), "c_name").select("c_custkey")


# Packed measurements, dictionaries and cells -------------------------------------------------------------------------

_PACKED = Roles(sample="sample", primary="entity", secondary=("ion",), intensity="packed", separator=";")
_SLOTS = "union all ".join(f"select entity, ion || '_{i}' as ion, sample, {c} as quant from p " for i, c in ((1, "q"), (2, "e"), (3, "x")))
_PACK_SQL = "with p as (select l_suppkey::varchar as entity, l_partkey::varchar as ion, year(l_shipdate)::varchar as sample, l_quantity as q, l_extendedprice as e, l_tax as x from lineitem), "


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem")
    texts = [F.col(c).cast("decimal(20,4)").cast("string").alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")]
    rows = rows.select(F.col("l_suppkey").cast("string").alias("entity"), F.col("l_partkey").cast("string").alias("ion"), F.year("l_shipdate").cast("string").alias("sample"), *texts)
    return rows.withColumn("packed", reshape.pack(["l_quantity", "l_extendedprice", "l_tax"])).withColumn("names", F.lit("qty;price;tax"))


@_query(_PACK_SQL + f"s as ({_SLOTS}) select entity, ion, sample, count(*)::bigint as n, round(sum(quant), 3) as total from s where quant <> 0 or ion like '%x' group by all")
def explode_packed_intensity(spark: SparkSession, sf: str) -> DataFrame:
    rows = reshape.to_long(_packed(spark, sf), _PACKED.but(na_string="0.0000"))
    return rows.groupBy("entity", "ion", "sample").agg(F.count("*").alias("n"), _r(F.sum("quant"), "total", 3))


@_query(_PACK_SQL + "s as (" + _SLOTS.replace("'_1'", "'_qty'").replace("'_2'", "'_price'").replace("'_3'", "'_tax'") + ") select entity, ion, sample, count(*)::bigint as n, round(sum(quant), 3) as total from s group by all")
def explode_zipped_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = reshape.to_long(_packed(spark, sf), _PACKED.but(fragment_ids="names"))
    return rows.groupBy("entity", "ion", "sample").agg(F.count("*").alias("n"), _r(F.sum("quant"), "total", 3))


@_query(f"select entity, row_number() over (order by k) as index from (select entity, min(row_no) as k from ({_ROWS['C']}) group by entity)")
def dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.dictionary(_long(spark, sf, "C"), "entity", "row_no")


@_query(f"select entity, ion, sample, l_orderkey, l_linenumber, round(log2(quant), 6) as quant from ({_ROWS['A']}) where log2(quant) > 14")
def log2_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.log2_cutoff(_long(spark, sf, "A"), 14.0)
    return rows.select("entity", "ion", "sample", "row_no.l_orderkey", "row_no.l_linenumber", _r("quant", "quant"))


_NORMAL = ("m as (select sample, median(quant) as m from c group by sample)", "f as (select sample, (select avg(m) from m) - m as f from m)", "x as (select entity, ion, sample, quant + f as quant from c join f using (sample))")


@_query(_cte("A", *_NORMAL) + "select entity, ion, sample, round(quant, 6) as quant from x")
def median_normalize_log(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.median_normalize(_cells(spark, sf, "A")).select("entity", "ion", "sample", _r("quant", "quant"))


@_query(_cte("E", "l as (select entity, ion, sample, sum(quant) as quant from t group by all)", "m as (select sample, median(quant) as m from l group by sample)") + "select entity, ion, sample, round(log2(quant * (select avg(m) from m) / m), 6) as quant from l join m using (sample)")
def median_normalize_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.median_normalize_linear(reshape.cells(_long(spark, sf, "E"), "sum"))
    return rows.select("entity", "ion", "sample", _r(F.log2("quant"), "quant"))


@_query(_cte("A") + "select entity, ion, sample, round(quant, 6) as quant from c")
def duplicate_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, "A").select("entity", "ion", "sample", _r("quant", "quant"))


@_query(f"select entity, ion, sample, max_by(quant, row_no) as quant from ({_ROWS['A']}) group by all")
def duplicate_last(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.cells(_long(spark, sf, "A"), "last")


@_query(f"select entity, ion, sample, count(*)::bigint as n from ({_ROWS['A']}) group by all having count(*) > 1")
def duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.duplicate_cells(_long(spark, sf, "A"))


_YEARS = list(range(1992, 1999))


@_query(_cte("A", "e as (select entity, sample, avg(quant) as v from c group by all)") + "select entity, " + ", ".join(f'round(max(v) filter (sample = {y}), 6) as "{y}"' for y in _YEARS) + " from e group by entity")
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = reshape.long_to_wide(quantify.mean_intensity(_cells(spark, sf, "A")), _YEARS)
    return wide.select("entity", *[_r(str(y), str(y)) for y in _YEARS])


@_query("select c_mktsegment as entity, 'acct' as sample, count(*)::bigint as n, round(sum(c_acctbal), 2) as total from customer group by all union all select c_mktsegment, 'key', count(*)::bigint, sum(c_custkey)::double from customer group by all")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = _t(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").alias("acct"), F.col("c_custkey").cast("double").alias("key"))
    return reshape.wide_to_long(wide, "c_mktsegment", ["acct", "key"]).groupBy("entity", "sample").agg(F.count("*").alias("n"), _r(F.sum("quant"), "total", 2))


# Ratios, medians, completeness ----------------------------------------------------------------------------------------

_PAIRS = "r as (select a.entity, a.sample as sample_a, b.sample as sample_b, median(b.quant - a.quant) as ratio, count(*)::bigint as n_ions from {0} a join {0} b on a.entity = b.entity and a.ion = b.ion and a.sample < b.sample group by all)"


@_query(_cte("A", _PAIRS.format("c")) + "select entity, sample_a, sample_b, round(ratio, 6) as ratio, n_ions from r")
def pairwise_log_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.pair_ratios(_cells(spark, sf, "A")).select("entity", "sample_a", "sample_b", _r("ratio", "ratio"), "n_ions")


@_query(_cte("C", _PAIRS.format("c")) + "select entity, sample_a, sample_b, round(ratio, 6) as ratio, n_ions from r")
def pairwise_log_ratio_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.pair_ratios(_cells(spark, sf, "C")).select("entity", "sample_a", "sample_b", _r("ratio", "ratio"), "n_ions")


@_query("""with w as (select l_suppkey as entity, l_extendedprice as v, l_quantity as q from lineitem),
c as (select entity, v, sum(q) over (partition by entity order by v, q rows unbounded preceding) as c, lead(v) over (partition by entity order by v, q) as nxt,
  sum(q) over (partition by entity) as w, row_number() over (partition by entity order by v, q) as k from w),
p as (select entity, min_by(struct_pack(v := v, c := c, nxt := nxt, w := w), k) as x from c where 2 * c >= w group by entity)
select entity, round(coalesce((x.c * x.v + (x.w - x.c) * x.nxt) / x.w, x.v), 4) as estimate from p""")
def weighted_median_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"))
    return quantify.weighted_median(rows, ["entity"], "v", "q").select("entity", _r("estimate", "estimate", 4))


@_query(_cte("B", "m as (select entity, median(quant) as m from c group by entity)") + "select entity, round(1.4826 * median(abs(quant - m)), 6) as mad from c join m using (entity) group by entity")
def mad_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.mad(_cells(spark, sf, "B"), ["entity"]).select("entity", _r("mad", "mad"))


@_query(_cte("C") + "select entity, ion, ((select count(distinct sample) from c) - count(*))::bigint as n_missing from c group by all")
def row_completeness(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf, "C")
    return quantify.row_completeness(cells, cells.select("sample").distinct().count())


def _estimates(name: str, which: str, make: Callable[[DataFrame], DataFrame], sql: str, *more: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return make(_cells(spark, sf, which)).select("entity", "sample", _r("estimate", "estimate"))

    run.__name__ = name
    _query(_cte(which, *more) + f"select entity, sample, round(estimate, 6) as estimate from ({sql})")(run)


def _top_sql(n: int, value: str = "quant", out: str = "avg(quant)") -> tuple[str, str, str]:
    k = f"k as (select entity, ion, row_number() over (partition by entity order by avg({value}) desc, ion) as k from c group by entity, ion)"
    return f"select entity, sample, {out} as estimate from c join k using (entity, ion) where k <= {n} group by entity, sample", k, ""


_LINEAR = "log2(avg(pow(2.0, quant)))"
_estimates("quant_meanint_log", "A", quantify.mean_intensity, "select entity, sample, avg(quant) as estimate from c group by all")
_estimates("quant_meanint_linear", "B", lambda c: quantify.mean_intensity(c, False), f"select entity, sample, {_LINEAR} as estimate from c group by all")
_estimates("quant_topn3", "B", quantify.top_n, *_top_sql(3)[:2])
_estimates("quant_topn5", "C", lambda c: quantify.top_n(c, 5), *_top_sql(5)[:2])
_estimates("quant_topn_linear", "A", lambda c: quantify.top_n(c, 3, False), *_top_sql(3, "pow(2.0, quant)", _LINEAR)[:2])
_estimates("quant_maxint", "C", quantify.max_intensity, *_top_sql(1)[:2])
_estimates("quant_sum", "B", quantify.sum_intensity, "select entity, sample, log2(sum(pow(2.0, quant))) as estimate from c group by all")
_estimates("collapse_least_na", "C", quantify.least_missing, "select c.entity, c.sample, c.quant as estimate from c join b on c.entity = b.entity and c.ion = b.ion", "n as (select entity, ion, count(*) as n from c group by all)", "b as (select entity, min_by(ion, (-n, ion)) as ion from n group by entity)")

# Components and MaxLFQ ------------------------------------------------------------------------------------------------

_COMPONENTS = (
    "s as (select distinct sample from c)", "e as (select distinct entity from c)",
    "ax as (select sample, row_number() over (order by sample) as at from s)",
    "g as (select distinct a.entity, a.sample as u, b.sample as v from c a join c b on a.entity = b.entity and a.ion = b.ion union select entity, sample, sample from e, s)",
    "reach as (select entity, u, v from g union select reach.entity, reach.u, g.v from reach join g on reach.entity = g.entity and reach.v = g.u)",
    "lead as (select entity, u as sample, min(v) as first from reach group by all)",
    "lab as (select entity, sample, (dense_rank() over (partition by entity order by first) - 1)::int as component from lead)",
)


@_query(_cte("C", *_COMPONENTS) + "select entity, sample, component from lab")
def sample_components(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.components(_cells(spark, sf, "C"))


@_query(_cte("C", *_COMPONENTS, "q as (select distinct entity, sample, true as q from c)") + """
select entity, case when count(distinct component) filter (q) <= 1 then '' else string_agg(case when q then (component + 1)::varchar else 'NA' end, ';' order by sample) end as annotation
from lab left join q using (entity, sample) group by entity""")
def component_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return quantify.maxlfq(_cells(spark, sf, "C")).select("entity", "annotation").distinct()


def _closed(source: str = "c") -> tuple[str, ...]:
    """MaxLFQ of entities whose samples are all linked, and of single samples."""
    return (
        _PAIRS.format(source),
        "b as (select entity, sample, sum(d) as b, count(*) as links from (select entity, sample_b as sample, ratio as d from r union all select entity, sample_a, -ratio from r) group by all)",
        f"k as (select entity, count(distinct sample) as k, avg(quant) as mu from {source} group by entity)",
        f"o as (select distinct entity, sample from {source})",
        "ok as (select o.entity from o left join b using (entity, sample) join k on k.entity = o.entity group by o.entity, k.k having min(coalesce(links, 0)) = k.k - 1)",
        "lfq as (select o.entity, o.sample, mu + coalesce(b / k, 0) as estimate from o join ok using (entity) join k using (entity) left join b on b.entity = o.entity and b.sample = o.sample)",
    )


_estimates("quant_maxlfq_complete", "E", quantify.maxlfq_complete, "select * from lfq", *_closed())
_estimates("quant_maxlfq_complete_events", "F", quantify.maxlfq_complete, "select * from lfq", *_closed())
_estimates("quant_maxlfq", "A", lambda c: quantify.maxlfq(c, keep_missing=False), "select * from lfq", *_closed())
_estimates("quant_maxlfq_from_pairs", "A", lambda c: quantify.maxlfq(c, large=1, keep_missing=False), "select * from lfq", *_closed())
_estimates("quant_maxlfq_matrix", "A", lambda c: quantify_grouped(c, "maxlfq", keep_missing=False), "select * from lfq", *_closed())
_estimates("quant_maxlfq_bit", "A", lambda c: quantify_grouped(c, "maxlfq_bit", keep_missing=False), "select * from lfq", *_closed())


_RATIOS = _PAIRS.format("c")
_SPARSE = (_RATIOS, *_COMPONENTS, *O.least_squares("r", "lab", "lsq"))
_NOTES = """notes as (select entity, case when count(distinct component) filter (q) <= 1 then '' else string_agg(case when q then (component + 1)::varchar else 'NA' end, ';' order by sample) end as annotation
  from lab left join (select distinct entity, sample, true as q from c) using (entity, sample) group by entity)"""


@_query(_cte("C", *_SPARSE, _NOTES) + "select entity, sample, round(estimate, 6) as estimate, annotation from lab left join lsq using (entity, sample) join notes using (entity)")
def quant_maxlfq_sparse(spark: SparkSession, sf: str) -> DataFrame:
    found = quantify.maxlfq(_cells(spark, sf, "C"))
    return found.select("entity", "sample", _r("estimate", "estimate"), "annotation")


_estimates("quant_maxlfq_conjugate", "C", quantify.maxlfq_conjugate, "select * from lsq", *_SPARSE)


@_query(_cte("C", *_COMPONENTS) + "select entity, sample, component from lab")
def sample_components_forest(spark: SparkSession, sf: str) -> DataFrame:
    """As sample_components, from mergeable forests at every size."""
    return quantify.components(_cells(spark, sf, "C"), large=0)


@_query(_cte("F", "m as (select entity, median(quant) as m from c group by entity)") + "select entity, round(1.4826 * median(abs(quant - m)), 6) as mad from c join m using (entity) group by entity")
def mad_of_large_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A few keys hold all rows; no task holds a key."""
    return quantify.mad(_cells(spark, sf, "F"), ["entity"], large=0).select("entity", _r("mad", "mad"))


@_query("""with w as (select 'all' as entity, l_extendedprice as v, l_quantity as q from lineitem),
c as (select v, sum(q) over (order by v, q rows unbounded preceding) as c, lead(v) over (order by v, q) as nxt, sum(q) over () as w, row_number() over (order by v, q) as k from w),
p as (select min_by(struct_pack(v := v, c := c, nxt := nxt, w := w), k) as x from c where 2 * c >= w)
select 'all' as entity, round(coalesce((x.c * x.v + (x.w - x.c) * x.nxt) / x.w, x.v), 4) as estimate from p""")
def weighted_median_one_key(spark: SparkSession, sf: str) -> DataFrame:
    """One key has all rows of the table."""
    rows = _t(spark, sf, "lineitem").select(F.lit("all").alias("entity"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"))
    return quantify.weighted_median(rows, ["entity"], "v", "q").select("entity", _r("estimate", "estimate", 4))


def _matrix(name: str, which: str, method: str, table: str | None = None, *more: str, large: int = quantify.LARGE) -> None:
    """A matrix method, and the same of entities that no task holds (large=1)."""
    make = lambda c: quantify.by_method(c, method, keep_missing=False, large=large)
    if table:
        _estimates(name, which, make, f"select * from {table}", *more)
    else:

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return make(_cells(spark, sf, which)).select("entity", "sample", _r("estimate", "estimate"))

        run.__name__ = name
        _query()(run)


_POLISH, _FIT = O.polish("fit", 1e-4, 1000), O.huber("fit")
_WEIGHTED_POLISH = (*_POLISH, *O.ion_weights("fit", "iw"), *O.polish("again", 1e-4, 1000, "iw"), *O.chosen("fit", "again", "picked"), *O.level("picked", "leveled"))
_WEIGHTED_FIT = (*_FIT, *O.ion_weights("fit", "iw"), *O.huber("again", weights="iw"), *O.chosen("fit", "again", "picked"), *O.level("picked", "leveled"))
_WEIGHTED_LFQ = (_RATIOS, *_COMPONENTS, *O.least_squares("r", "lab", "fit"), *O.ion_weights("fit", "iw"), *O.weighted_ratios("iw", "wr"), *O.least_squares("wr", "lab", "again"), *O.chosen("fit", "again", "picked"), *O.level("picked", "leveled"))
_matrix("quant_median_polish_r", "F", "median_polish_short", "fit", *O.polish("fit", 0.01, 10))
_matrix("quant_median_polish", "A", "median_polish", "leveled", *_POLISH, *O.level("fit", "leveled"))
_matrix("quant_weighted_median_polish", "F", "weighted_median_polish", "leveled", *_WEIGHTED_POLISH)
_matrix("quant_weighted_maxlfq", "F", "weighted_maxlfq", "leveled", *_WEIGHTED_LFQ)
_matrix("quant_rlm", "B", "rlm")  # published stopping rule, short of the fixed point: no SQL
_matrix("quant_weighted_rlm", "B", "weighted_rlm")
_matrix("quant_rlm_direct", "F", "rlm_direct", "leveled", *_FIT, *O.level("fit", "leveled"))
_matrix("quant_weighted_rlm_direct", "F", "weighted_rlm_direct", "leveled", *_WEIGHTED_FIT)
_matrix("quant_median_polish_spread", "F", "median_polish", "leveled", *_POLISH, *O.level("fit", "leveled"), large=1)
_matrix("quant_weighted_median_polish_spread", "F", "weighted_median_polish", "leveled", *_WEIGHTED_POLISH, large=1)
_matrix("quant_rlm_spread", "F", "rlm_direct", "leveled", *_FIT, *O.level("fit", "leveled"), large=1)
_matrix("quant_weighted_maxlfq_spread", "F", "weighted_maxlfq", "leveled", *_WEIGHTED_LFQ, large=1)
_matrix("quant_maxlfq_bit_spread", "E", "maxlfq_bit", "lfq", *_closed(), large=1)

_LEVELS = {"median-mean": ("median(quant)", "avg(quant)", "avg(estimate)"), "median-median": ("median(quant)", "median(quant)", "median(estimate)"), "mean-mean": ("avg(quant)", "avg(quant)", "avg(estimate)"), "sum": ("sum(quant)", "sum(quant)", "avg(estimate)")}


def _rescaled(method: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _long(spark, sf, "C").where("sample is not null")
        axis = sample_axis(rows)

        def make(some: DataFrame, large: int | None) -> DataFrame:
            c = reshape.log_cells(reshape.cells(some, "sum"))
            c = c if large is None else released(c)
            return quantify.rescale(quantify.mean_intensity(c), c, quantify.components(c, axis, large), method, large)

        return quantify.by_size(rows, make).select("entity", "sample", _r("estimate", "estimate"))

    run.__name__ = f"rescale_{method.replace('-', '_')}"
    return run


for _method, (_single, _whole, _own) in _LEVELS.items():
    _sql = (
        f"select entity, sample, case when size = 1 then single else estimate + (whole - own) / {'n' if _method == 'sum' else '1'} end as estimate from est join lab using (entity, sample) join dat using (entity, component) join now using (entity, component) join sz using (entity, component)",
        *_COMPONENTS, "est as (select entity, sample, avg(quant) as estimate from c group by all)", f"dat as (select entity, component, {_single} as single, {_whole} as whole from c join lab using (entity, sample) group by all)",
        f"now as (select entity, component, {_own} as own, count(*) as n from est join lab using (entity, sample) group by all)", "sz as (select entity, component, count(*) as size from lab group by all)",
    )
    _query(_cte("C", *_sql[1:]) + f"select entity, sample, round(estimate, 6) as estimate from ({_sql[0]})")(_rescaled(_method))

# Annotation, statistics, quality ----------------------------------------------------------------------------------------


@_query("select p_brand, min_by(p_name, p_partkey) as p_name, min_by(p_type, p_partkey) as p_type from part group by p_brand")
def annotate_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.first_match(_t(spark, sf, "part"), "p_brand", ["p_name", "p_type"], "p_partkey")


@_query(f"""with t as ({_ROWS['A']}), i as (select entity, ion, min(row_no) as place, sum(quant) as xic from t group by all),
p as (select entity, (ion % 10)::varchar as peptide, min(place) as place, count(*) as n, sum(xic) as xic from i group by all)
select entity, sum(n)::bigint as n_fragments, count(*)::bigint as n_peptides, string_agg(peptide, ';' order by place) as peptides, round(sum(xic), 2) as xic from p group by entity""")
def fragment_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = annotate.fragment_stats(_long(spark, sf, "A"), lambda ion: (ion % 10).cast("string"))
    return stats.select("entity", "n_fragments", "n_peptides", "peptides", _r("xic", "xic", 2))


@_query("select p_partkey, regexp_replace(regexp_replace(p_name || '(UniMod:4)' || p_size::varchar, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[0-9_].*$', '') as peptide from part")
def peptide_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", annotate.strip_from_digit(F.concat("p_name", F.lit("(UniMod:4)"), F.col("p_size").cast("string"))).alias("peptide"))


@_query("""with d as (select doc_id, text as s from documents), p as (select unnest(['the', 'er', 'and', 'tion']) as w),
x as (select doc_id, w, unnest(string_split(s, w)) as piece, generate_subscripts(string_split(s, w), 1) as k from d, p where s is not null),
y as (select doc_id, w, k, sum(length(piece) + length(w)) over (partition by doc_id, w order by k) - length(w) as i, count(*) over (partition by doc_id, w) as n from x),
m as (select doc_id, count(distinct i + v) as hit from (select doc_id, i, unnest(range(length(w))) as v from y where k < n) group by doc_id)
select doc_id::varchar as entity, case when length(s) = 0 then 0 else coalesce(round_even(100.0 * hit / length(s), 0), 0)::int end || '%' as coverage from d left join m using (doc_id)""")
def sequence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.col("text").alias("sequence"))
    words = F.array(*[F.lit(w) for w in ("the", "er", "and", "tion")])
    return annotate.coverage(docs.select("entity", words.alias("peptides")), docs.withColumnRenamed("entity", "accession"))


@_query(_cte("A", "b as (select min(quant) as lo, max(quant) as hi, count(*) as n from c)") + "select least(100, floor((quant - lo) / ((hi - lo) / 100)) + 1)::int as bin, count(*)::bigint as n from c, b group by all")
def qc_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return qc.histogram(_cells(spark, sf, "A")).select("bin", "n")


@_query(_cte("A") + "select sample, count(*)::bigint as n, round(min(quant), 6) as min, round(quantile_cont(quant, 0.25), 6) as q1, round(median(quant), 6) as median, round(quantile_cont(quant, 0.75), 6) as q3, round(max(quant), 6) as max from c group by sample")
def qc_boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = qc.box_stats(_cells(spark, sf, "A"))
    return stats.select("sample", "n", *[_r(c, c) for c in ("min", "q1", "median", "q3", "max")])


@_query(_cte("A") + "select sample, count(*)::bigint as n, count(*) filter (quant > 15)::bigint as n_above, round(median(quant), 6) as median from c group by sample")
def exact_median_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    return qc.cutoff_report(_cells(spark, sf, "A"), 15.0).select("sample", "n", "n_above", _r("median", "median"))


@_query("select o_custkey, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey")
def rows_of_packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    groups = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ";").alias("ids"))
    found = annotate.rows_of_ids(groups, "ids", orders.select("o_orderkey", "o_totalprice").dropDuplicates(["o_orderkey"]), "o_orderkey")
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"), _r(F.sum("o_totalprice"), "total", 2))


@_query("select l_suppkey::varchar as entity, l_partkey || '_1' as ion, l_returnflag as sample, count(*)::bigint as n, round(sum(l_quantity), 4) as total from lineitem where l_returnflag = 'R' and l_discount < 0.04 group by all")
def scan_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the table as tab-separated text and reads it back with the rules of files."""
    path = _scratch(spark, "report")
    _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_discount", "l_quantity").write.csv(path, sep="\t", header=True, quote="")
    roles = Roles(sample="l_returnflag", primary="l_suppkey", secondary=("l_partkey",), intensity="l_quantity", filters=Filters(equal={"l_returnflag": "R"}, less={"l_discount": 0.04}))
    quads, _ = pipelines.load_quads(path, roles, spark)
    return quads.groupBy("entity", "ion", "sample").agg(F.count("*").alias("n"), _r(F.sum("quant"), "total", 4))


@_query("select l_suppkey::varchar as entity, l_partkey || '_1' as ion, l_linestatus as sample, count(*)::bigint as n, round(sum(l_quantity), 4) as total from lineitem where l_linestatus <> 'O' and l_tax > 0.03 group by all")
def scan_gzip(spark: SparkSession, sf: str) -> DataFrame:
    """As scan_delimited, of gzipped files."""
    path = _scratch(spark, "report")
    _t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus", "l_tax", "l_quantity").write.csv(path, sep="\t", header=True, quote="", compression="gzip")
    roles = Roles(sample="l_linestatus", primary="l_suppkey", secondary=("l_partkey",), intensity="l_quantity", filters=Filters(not_equal={"l_linestatus": "O"}, greater={"l_tax": 0.03}))
    quads, _ = pipelines.load_quads(path, roles, spark)
    return quads.groupBy("entity", "ion", "sample").agg(F.count("*").alias("n"), _r(F.sum("quant"), "total", 4))


@_query(_cte("A") + "select entity, sample::varchar as sample, round(avg(quant), 6) as estimate from c group by all")
def wide_file_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Writes estimates as a wide tab-separated file and reads it back."""
    cells, path = _cells(spark, sf, "A"), _scratch(spark, "wide")
    samples = sample_axis(cells)
    delimited.write_wide(reshape.long_to_wide(quantify.mean_intensity(cells), samples), path)
    found = reshape.wide_to_long(delimited.read_wide(spark, path), "entity", [str(s) for s in samples])
    return found.select("entity", "sample", _r("quant", "estimate"))


@_query(_cte("B") + "select entity::varchar as entity, ion::varchar as ion, sample::varchar as sample, round(quant, 6) as quant from c")
def directory_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the store in the literal directory layout and reads that back; its folder must be mounted everywhere."""
    from quantloom.sources import store

    kept, path = _scratch(spark, "store"), _scratch(spark, "directory").removeprefix("file://")
    store.write_store(_long(spark, sf, "B"), kept)
    store.write_directory(spark, kept, path)
    entities, samples, ions = (d.drop("annotation") for d in store.directory_dims(spark, path))
    facts = spark.read.format("iondir").load(path)
    cells = facts.join(entities, "entity_idx").join(samples, "sample_idx").join(ions, "ion_idx")
    return reshape.log_cells(reshape.cells(cells, "sum")).select("entity", "ion", "sample", _r("quant", "quant"))


@_query("""with f as (select p_brand as entity, avg(p_retailprice) as price from part group by 1), i as (select 'Brand#' || (55 - range) as entity, range as place from range(55))
select place, entity, round(price, 4) as price from i left join f using (entity)""")
def in_id_order(spark: SparkSession, sf: str) -> DataFrame:
    prices = _t(spark, sf, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.avg("p_retailprice").alias("price"))
    ids = spark.range(55).select(F.concat(F.lit("Brand#"), (55 - F.col("id")).cast("string")).alias("entity"), F.col("id").alias("place"))
    return reshape.in_id_order(prices, ids).select("place", "entity", _r("price", "price", 4))


# Pipelines --------------------------------------------------------------------------------------------------------------

_REPORT = Roles(sample="year", primary="p_brand", secondary=("l_partkey",), intensity="price", annotation=("p_mfgr",), filters=Filters(equal={"l_linestatus": "F"}, less={"l_discount": 0.08}))


@_query("with t as (select p_brand as entity, l_partkey as ion, year(l_shipdate)::varchar as sample, l_extendedprice as quant from lineitem join part on l_partkey = p_partkey where l_linestatus = 'F' and l_discount <= 0.08), c as (select entity, ion, sample, log2(sum(quant)) as quant from t group by all), "
        + ", ".join((*_NORMAL, *_closed("x"))) + " select entity, sample, round(estimate, 6) as estimate from lfq")
def process_long(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: filters, one value per cell, log2, cutoff, median normalisation and MaxLFQ."""
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("year", F.year("l_shipdate"))
    rows = P.apply_filters(rows, _REPORT.filters).groupBy("p_brand", "l_partkey", "year").agg(F.sum("l_extendedprice").alias("price"))
    found = pipelines.process_long(rows, _REPORT.but(filters=Filters(), annotation=()))
    return found.estimates.where("estimate is not null").select("entity", "sample", _r("estimate", "estimate"))


_WIDE = "with w as (select l_orderkey, l_suppkey, sum(case when l_returnflag = 'A' then l_extendedprice end) as a, sum(case when l_returnflag = 'N' then l_extendedprice end) as n, sum(case when l_returnflag = 'R' then l_extendedprice end) as r from lineitem group by all), "


@_query(_WIDE + "c as (select l_suppkey as entity, 'a' as sample, log2(a) as quant from w where a > 0 union all select l_suppkey, 'n', log2(n) from w where n > 0 union all select l_suppkey, 'r', log2(r) from w where r > 0) select entity, sample, round(log2(sum(pow(2.0, quant))), 6) as estimate, min(s_name) as s_name from c join supplier on s_suppkey = entity group by all")
def process_wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem")
    wide = rows.groupBy("l_orderkey", "l_suppkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f.upper(), F.col("l_extendedprice"))).alias(f) for f in "anr"])
    wide = wide.join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = pipelines.process_wide(wide, "l_suppkey", ["a", "n", "r"], "sum", annotation=["s_name"])
    return found.select("entity", "sample", _r("estimate", "estimate"), "s_name")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    number = spark.sparkContext._jvm.java.util.UUID.randomUUID()
    return f"{shared.rstrip('/')}/{name}-{number}" if shared else tempfile.mkdtemp(prefix=f"{name}-") + "/data"


@_query(_cte("B") + "select entity, ion, sample, round(quant, 6) as quant from c")
def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.sources import store

    path = _scratch(spark, "store")
    store.write_store(_long(spark, sf, "B"), path)
    return reshape.log_cells(reshape.cells(store.store_cells(spark, path), "sum")).select("entity", "ion", "sample", _r("quant", "quant"))


@_query("with t as (select l_orderkey, l_linenumber, l_quantity, row_number() over (order by l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice) as place from lineitem) select place, l_orderkey, l_linenumber::bigint as l_linenumber, 2 as n_fields from t where l_quantity >= 45")
def malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a missing field, by their place over all files of a folder."""
    path = _scratch(spark, "lines")
    kept = F.when(F.col("l_quantity") < 45, F.col("l_quantity").cast("string"))  # concat_ws leaves nulls out
    rows = _t(spark, sf, "lineitem").repartitionByRange(6, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")
    rows.select(F.concat_ws("\t", "l_orderkey", "l_linenumber", kept).alias("l_orderkey\tl_linenumber\tl_quantity")).write.option("header", True).csv(path, sep="|", quote="", escape="")
    found = delimited.malformed_lines(spark, path)
    field = lambda i: F.split("text", "\t")[i].cast("long")
    return found.select("place", field(0).alias("l_orderkey"), field(1).alias("l_linenumber"), "n_fields")


@_query(f"""with t as ({_ROWS['B']}), e as (select entity, row_number() over (order by min(l_orderkey * 10 + l_linenumber)) as place from t group by entity),
c as (select entity, ion, sample, log2(sum(quant)) as quant from t group by all)
select entity, sample, round(avg(quant), 6) as estimate from c join e using (entity) where place between 3 and 9 group by all""")
def store_range(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates of a range of a store's entities: the range is pushed to sorted, bucketed files, and nothing is shuffled.

    Entities are numbered by the key of the SQL, which leaves ties open: here they go by entity.
    """
    from quantloom.sources import store

    path, place = _scratch(spark, "store"), F.col("row_no.l_orderkey") * 10 + F.col("row_no.l_linenumber")
    store.write_store(_long(spark, sf, "B").withColumn("place", F.struct(place.isNull().alias("none"), place.alias("place"))), path, order="place")
    return pipelines.from_store(spark, path, "meanInt", entities=(3, 9)).where("estimate is not null").select("entity", "sample", _r("estimate", "estimate"))


@_query(f"""with t as ({_ROWS['B']}), c as (select entity, ion, sample, log2(sum(quant)) as quant from t group by all)
select entity, sample, round(avg(quant), 6) as estimate from c group by all""")
def store_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A store of three batches (years of shipping), of which each requantifies the entities that it changes."""
    from quantloom.sources import store
    from quantloom.streaming import ingest

    rows, path = _long(spark, sf, "B"), _scratch(spark, "store")
    for batch, part in enumerate((F.col("sample") < 1994, F.col("sample").between(1994, 1996), F.col("sample") > 1996)):
        if batch:
            store.append_store(rows.where(part), path, batch)
        else:
            store.write_store(rows.where(part), path)
        ingest.requantify(spark, path, batch, "meanInt")
    return ingest.latest_estimates(spark, path).where("estimate is not null").select("entity", "sample", _r("estimate", "estimate"))


@_query(f"with t as ({_ROWS['B']}) select entity, ion, sample, l_orderkey, l_linenumber, round(log2(quant), 6) as quant from t where quant > 0 and log2(quant) > 12")
def normalize_none(spark: SparkSession, sf: str) -> DataFrame:
    """log2 and cutoff without normalisation."""
    found = pipelines.preprocess(_long(spark, sf, "B"), 12.0, "none")
    return found.select("entity", "ion", "sample", F.col("row_no.l_orderkey").alias("l_orderkey"), F.col("row_no.l_linenumber").alias("l_linenumber"), _r("quant", "quant"))


@_query(f"""with t as ({_ROWS['A']}), c as (select *, log2(quant) as q from t where sample <> 1995 and quant > 1),
m as (select sample, median(q) as m from c group by sample), a as (select avg(m) as a from m)
select entity, ion, sample, l_orderkey, l_linenumber, round(q + a - m, 6) as quant from c join m using (sample), a""")
def normalize_drop_empty_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of which the cutoff leaves nothing is left out, and the others are normalised."""
    rows = _long(spark, sf, "A").withColumn("quant", F.when(F.col("sample") == 1995, 1.0).otherwise(F.col("quant")))
    found = pipelines.preprocess(rows, 0.0, on_empty_sample="drop")
    return found.select("entity", "ion", "sample", F.col("row_no.l_orderkey").alias("l_orderkey"), F.col("row_no.l_linenumber").alias("l_linenumber"), _r("quant", "quant"))


@_query(_cte("A") + "select entity, sample, round(log2(sum(pow(2.0, quant))), 6) as estimate from c group by all")
def udf_method(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    def total(x):
        return np.log2(np.nansum(2.0**x, axis=0))

    return quantify_grouped(_cells(spark, sf, "A"), total, keep_missing=False).select("entity", "sample", _r("estimate", "estimate"))


@_query(_cte("E", *_closed()) + "select entity::varchar as entity, sample, round(estimate, 6) as estimate from lfq")
def sql_udtf_quantify(spark: SparkSession, sf: str) -> DataFrame:
    sql_surface.register(spark)
    _cells(spark, sf, "E").createOrReplaceTempView("quantloom_cells")
    return spark.sql("select entity, sample, round(estimate, 6) as estimate from quantify(table(select entity, ion, sample, quant from quantloom_cells) partition by (entity), 'maxLFQ') where estimate is not null")


@_query(_cte("A") + "select entity, count(*)::bigint as n_cells, count(distinct sample)::bigint as n_samples, count(distinct ion)::bigint as n_ions from c group by entity")
def distinct_axes(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, "A").groupBy("entity").agg(F.count("*").alias("n_cells"), F.count_distinct("sample").alias("n_samples"), F.count_distinct("ion").alias("n_ions"))


@_query(_cte("A") + "select ion, sample, round(quant, 6) as quant, floor((dense_rank() over (order by ion) - 1) / 12.0)::bigint as legend from c where entity = 'Brand#11'")
def entity_profile(spark: SparkSession, sf: str) -> DataFrame:
    return qc.entity_series(_cells(spark, sf, "A"), "Brand#11").select("ion", "sample", _r("quant", "quant"), "legend")
