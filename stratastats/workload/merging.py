"""Joins, merges and the map table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rate_per_weight
from ..operators import inner_join, key_report, map_table, map_tables, merge_coverage, total_rows
from ..sources import written
from . import tables as t
from .registry import query, rounded


def _int_code(df):
    return df.withColumn("stratum_code", F.col("stratum_code").cast("int"))


@query(
    "join_parent_attributes",
    t.sql(t.SQL_FACT_PARENT,
          select="select f.parent_id, f.parent_code, f.amount, cast(a.weight as double) as weight, "
                 "round(a.income, 6) as income, round(a.rate, 6) as rate "
                 "from fact_parent f join attr_parent a on a.parent_id = f.parent_id"),
)
def join_parent_attributes(spark, folder):
    joined = inner_join(
        t.cleaned_facts(spark, folder, "parent"), t.cleaned_attributes(spark, folder, "parent"),
        "parent_id", "attr_parent_id", ["weight", "income", "rate"],
    )
    return rounded(joined, "amount", "weight", "income", "rate")


@query(
    "join_parent_prices",
    t.sql(t.SQL_FACT_PARENT,
          select="select f.parent_id, f.parent_code, f.amount, p.parent_name, "
                 "round(p.price, 4) as price "
                 "from fact_parent f join price_parent p on p.price_code = f.parent_code"),
)
def join_parent_prices(spark, folder):
    joined = inner_join(
        t.cleaned_facts(spark, folder, "parent"), t.cleaned_prices(spark, folder, "parent"),
        "parent_code", "price_code", ["parent_name", "price"],
    )
    return rounded(rounded(joined, "amount"), "price", places=4)


@query(
    "join_child_attributes",
    t.sql(t.SQL_FACT_CHILD,
          select="select f.child_id, f.amount, cast(a.weight as double) as weight, a.income, "
                 "cast(a.stratum_code as integer) as stratum_code "
                 "from fact_child f join clean_attributes a on a.child_id = f.child_id"),
)
def join_child_attributes(spark, folder):
    joined = inner_join(
        t.cleaned_facts(spark, folder, "child"), t.cleaned_attributes(spark, folder, "child"),
        "child_id", "attr_child_id", ["weight", "income", "stratum_code"],
    )
    return _int_code(
        rounded(joined.select("child_id", "amount", "weight", "income", "stratum_code"), "amount")
    )


@query(
    "join_on_label",
    t.sql(t.SQL_FACT_CHILD,
          select="select f.region_label, f.amount, round(p.price, 4) as price, p.price_code "
                 "from fact_child f join price_child p on p.price_label = f.region_label"),
)
def join_on_label(spark, folder):
    joined = inner_join(
        t.cleaned_facts(spark, folder, "child"), t.cleaned_prices(spark, folder, "child"),
        "region_label", "price_label", ["price", "price_code"],
    )
    joined = joined.select("region_label", "amount", "price", "price_code")
    return rounded(rounded(joined, "amount"), "price", places=4)


_TWO = ("select f.parent_code, f.amount, cast(a.weight as double) as weight, "
        "round(a.income, 6) as income, round(a.rate, 6) as rate, "
        "round(f.amount / nullif(cast(a.weight as double), 0) * 2000, 4) as amount_per_person "
        "from fact_parent f join attr_parent a on a.code = f.parent_code")


def _two_source(spark, folder):
    joined = inner_join(
        t.cleaned_facts(spark, folder, "parent"), t.cleaned_attributes(spark, folder, "parent"),
        "parent_code", "attr_code", ["weight", "income", "rate"],
    )
    return joined.withColumn("amount_per_person", rate_per_weight("amount", "weight"))


@query("join_two_source", t.sql(t.SQL_FACT_PARENT, select=_TWO))
def join_two_source(spark, folder):
    joined = _two_source(spark, folder).drop("parent_id")
    joined = rounded(joined, "amount", "weight", "income", "rate")
    return rounded(joined, "amount_per_person", places=4)


@query(
    "merge_state",
    t.sql(t.SQL_FACT_PARENT, t.SQL_MERGED_PARENT,
          select="select parent_code, parent_id, amount, cast(weight as double) as weight, "
                 "round(income, 6) as income, round(rate, 6) as rate, round(price, 4) as price, "
                 "parent_name from merged_parent"),
)
def merge_state(spark, folder):
    merged = rounded(t.merged(spark, folder, "STATE"), "amount", "weight", "income", "rate")
    return rounded(merged, "price", places=4)


@query(
    "merge_county",
    t.sql(t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD,
          select="select parent_code, parent_id, child_part_id, child_name, "
                 "cast(stratum_code as integer) as stratum_code, amount, "
                 "cast(weight as double) as weight, income, round(rate, 6) as rate, "
                 "round(price, 4) as price, child_id from merged_child"),
)
def merge_county(spark, folder):
    merged = rounded(t.merged(spark, folder, "COUNTY"), "amount", "weight", "rate")
    return _int_code(rounded(merged, "price", places=4))


@query(
    "merge_county_by_sector",
    t.sql(t.SQL_FACT_CHILD_CLASS, t.SQL_MERGED_CLASS,
          select="select child_id, major_class, amount, cast(stratum_code as integer) as stratum_code, "
                 "cast(weight as double) as weight, income, round(price, 4) as price "
                 "from merged_class"),
)
def merge_county_by_sector(spark, folder):
    merged = t.merged(spark, folder, "COUNTY", "by sector", agg=False).select(
        "child_id", "major_class", "amount", "stratum_code", "weight", "income", "price"
    )
    return _int_code(rounded(rounded(merged, "amount", "weight"), "price", places=4))


@query(
    "merge_coverage",
    t.sql(
        t.SQL_FACT_CHILD,
        select="""
        select 'left' as side, count(distinct region_label) as keys,
          count(distinct case when p.price_label is not null then region_label end) as matched_keys,
          cast(count(*) as bigint) as rows, count(p.price_label) as matched_rows
        from fact_child f left join price_child p on p.price_label = f.region_label
        union all
        select 'right', count(distinct price_label),
          count(distinct case when f.region_label is not null then price_label end),
          cast(count(*) as bigint), count(f.region_label)
        from price_child p left join fact_child f on p.price_label = f.region_label""",
    ),
)
def merge_coverage_(spark, folder):
    return merge_coverage(
        t.cleaned_facts(spark, folder, "child"), t.cleaned_prices(spark, folder, "child"),
        "region_label", "price_label",
    )


def _map_sql(column: str, expression: str, unit: str, label: str) -> str:
    return (
        f"select '{column}' as metric, parent_code as region, round({expression}, 4) as value, "
        f"cast(trunc(round_even({expression}, 3)) as bigint) as z, "
        f"parent_code || ': ' || cast(cast(round_even({expression}, 0) as bigint) as varchar) "
        f"|| ' {unit}' as text, '{unit}' as unit, '{label} {unit}' as title from two"
    )


@query(
    "map_table",
    t.sql(
        t.SQL_FACT_PARENT,
        "two as (select f.parent_code, f.amount, a.weight, a.income, a.rate, "
        "f.amount / nullif(cast(a.weight as double), 0) * 2000 as amount_per_person "
        "from fact_parent f join attr_parent a on a.code = f.parent_code)",
        select=" union all ".join(
            [
                _map_sql("amount_per_person", "amount_per_person", "(lbs)", "CO per Capita"),
                _map_sql("amount", "amount / 2000", "TPY", "Emissions"),
                _map_sql("weight", "cast(weight as double)", "Workers", "Labor Force Size"),
                _map_sql("income", "income", "(USD)", "Median Income"),
                _map_sql("rate", "rate", "(%)", "Unemployment"),
            ]
        ),
    ),
)
def map_table_(spark, folder):
    columns = ("amount_per_person", "amount", "weight", "income", "rate")
    return rounded(map_tables(_two_source(spark, folder), columns, "parent_code"), "value", places=4)


@query(
    "map_table_normalised",
    t.sql(
        t.SQL_FACT_PARENT, t.SQL_MERGED_PARENT,
        select="select region, round(v, 4) as value, cast(trunc(round_even(v, 3)) as bigint) as z, "
               "region || ': ' || cast(cast(round_even(v, 0) as bigint) as varchar) || ' (USD)' as text, "
               "'(USD)' as unit, 'Property Value (USD)' as title from (select parent_code as region, "
               "(price - min(price) over ()) / nullif(max(price) over () - min(price) over (), 0) as v "
               "from merged_parent)",
    ),
)
def map_table_normalised(spark, folder):
    mapped = map_table(t.merged(spark, folder, "parent"), "price", "parent_code", normalise=True)
    return rounded(mapped, "value", places=4)


@query(
    "key_report",
    """
    with k as (
      select p_name, count(*) as row_count, min(p_type) as lo, max(p_type) as hi from part
      where p_name is not null group by p_name having count(*) > 1)
    select p_name, row_count, null::varchar as attribute, null::varchar as least, null::varchar as most from k
    union all select p_name, row_count, 'p_type', lo, hi from k where lo <> hi""",
)
def key_report_(spark, folder):
    """Part names as a lookup key: those that repeat, and those of different types."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    return key_report(part, ["p_name"], ["p_type"])


@query(
    "total_rows",
    f"""
    with {t.SQL_ATTRIBUTES},
    a as (select code, area_name, weight from attributes
          union all select code, 'all of ' || code, sum(weight) from attributes group by code)
    select code, area_name, cast(weight as bigint) as weight from a
    qualify 2 * weight = sum(weight) over (partition by code)
            and count(weight) over (partition by code) > 2""",
)
def total_rows_(spark, folder):
    """Places beside the totals of their parents: the totals are found."""
    places = t.attributes(spark, folder).select(F.col("parent_code").alias("code"), "area_name", "weight")
    totals = places.groupBy("code").agg(
        F.concat(F.lit("all of "), "code").alias("area_name"), F.sum("weight").alias("weight")
    )
    return total_rows(places.unionByName(totals), ["code"], "weight")
