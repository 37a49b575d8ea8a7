"""Projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contains_any, in_list, not_equal, not_in, within_year
from ..operators import select_strata
from ..plans import class_drift
from . import tables as t
from .registry import query, rounded, table


@query(
    "filter_year",
    "select o_orderkey, o_orderdate from orders where year(o_orderdate) = 1997",
)
def filter_year(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return orders.where(within_year("o_orderdate", 1997))


@query(
    "filter_conjunction",
    "select o_orderkey, o_totalprice from orders "
    "where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'",
)
def filter_conjunction(spark, folder):
    return (
        table(spark, folder, "orders")
        .where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH"))
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "drop_nulls",
    f"with {t.SQL_ATTRIBUTES} select area_name, cast(weight as bigint) as weight, income, "
    "cast(stratum_code as integer) as stratum_code "
    "from attributes where weight is not null and income is not null and stratum_code is not null",
)
def drop_nulls(spark, folder):
    rows = t.attributes(spark, folder).dropna("any", subset=["weight", "income", "stratum_code"])
    return rows.select("area_name", "weight", "income", F.col("stratum_code").cast("int").alias("stratum_code"))


@query(
    "filter_neq_keep_null",
    f"with {t.SQL_PRICES} select region_label, period_begin, price from prices "
    "where nullif(parent_code, 'NATION_7') <> 'NATION_8' or nullif(parent_code, 'NATION_7') is null",
)
def filter_neq_keep_null(spark, folder):
    code = F.nullif("parent_code", F.lit("NATION_7"))
    rows = t.prices(spark, folder).where(not_equal(code, "NATION_8"))
    return rows.select("region_label", "period_begin", "price")


@query(
    "exclude_list",
    "select c_custkey, nullif(c_mktsegment, 'BUILDING') as segment from customer "
    "where c_mktsegment not in ('MACHINERY', 'FURNITURE')",
)
def exclude_list(spark, folder):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    rows = table(spark, folder, "customer").select("c_custkey", segment.alias("segment"))
    return rows.where(not_in("segment", ["MACHINERY", "FURNITURE"]))


@query(
    "include_list",
    "select p_partkey, p_type from part where p_type in ('PROMO', 'SMALL')",
)
def include_list(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return parts.where(in_list("p_type", ["PROMO", "SMALL"]))


@query(
    "filter_any_substring",
    f"with {t.SQL_FACTS} select sector_path, count(*) as row_count, "
    "cast(sum(amount) as double) as amount from facts "
    f"where {t.SQL_RESIDENTIAL} group by sector_path",
)
def filter_any_substring(spark, folder):
    rows = t.facts(spark, folder).where(contains_any("sector_path", t.CONTRIBUTORS["residential"]))
    return rows.groupBy("sector_path").agg(
        F.count("*").alias("row_count"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query("project_columns", "select l_orderkey, l_linenumber, l_discount from lineitem")
def project_columns(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")


def drift_sql(stratum: str, cte: str = "merged_class") -> str:
    """Tail of the drift CTEs over a frame with major_class, amount, weight and a stratum."""
    return f"""
base_mean as (
  select major_class, sum(amount) / sum(weight) as m from {cte} group by major_class),
base as (
  select major_class, 100 * m / (select sum(m) from base_mean where major_class <> 'PROMO') as share
  from base_mean where major_class <> 'PROMO'),
strat_mean as (
  select {stratum} as stratum, major_class, sum(amount) / sum(weight) as m
  from {cte} where {stratum} is not null group by 1, 2),
strat_total as (
  select stratum, sum(m) as s from strat_mean where major_class <> 'PROMO' group by stratum),
drift as (
  select t.stratum, t.major_class, b.share - 100 * t.m / s.s as drift
  from strat_mean t join strat_total s on s.stratum = t.stratum
       join base b on b.major_class = t.major_class)"""


@query(
    "select_strata",
    t.sql(
        t.SQL_FACT_CHILD_CLASS, t.SQL_MERGED_CLASS, drift_sql("stratum_code"),
        select="select cast(stratum as integer) as stratum_code, major_class, round(drift, 6) as drift "
        "from drift where stratum in (1, 2, 3, 4, 8)",
    ),
)
def select_strata_(spark, folder):
    merged = t.merged(spark, folder, "child", "by sector", agg=False)
    drift = class_drift(merged, excluded=t.EXCLUDED_CLASS)
    return rounded(select_strata(drift, "stratum_code", [1, 2, 3, 4, 8]), "drift")
