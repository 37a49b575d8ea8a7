"""Cleaning pipelines at both levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables as t
from .registry import query, rounded


@query(
    "clean_prices_parent",
    t.sql(select="select parent_name, price_code, round(price, 4) as price from price_parent"),
)
def clean_prices_parent(spark, folder):
    return rounded(t.cleaned_prices(spark, folder, "parent"), "price", places=4)


@query(
    "clean_prices_child",
    t.sql(select="select price_label, parent_name, price_code, round(price, 4) as price "
                 "from price_child"),
)
def clean_prices_child(spark, folder):
    return rounded(t.cleaned_prices(spark, folder, "child"), "price", places=4)


@query(
    "clean_attributes_parent",
    t.sql(select="select code as attr_code, child_id as attr_child_id, parent_id as attr_parent_id, "
                 "cast(weight as double) as weight, round(income, 6) as income, "
                 "round(rate, 6) as rate from attr_parent"),
)
def clean_attributes_parent(spark, folder):
    return rounded(t.cleaned_attributes(spark, folder, "state"), "weight", "income", "rate")


@query(
    "clean_attributes_child",
    t.sql(select="select child_id as attr_child_id, parent_id as attr_parent_id, area_name, "
                 "code as attr_code, cast(weight as double) as weight, income, round(rate, 6) as rate, "
                 "cast(stratum_code as integer) as stratum_code from clean_attributes"),
)
def clean_attributes_child(spark, folder):
    rows = rounded(t.cleaned_attributes(spark, folder, "county"), "weight", "rate")
    return rows.withColumn("stratum_code", F.col("stratum_code").cast("int"))


_CHILD = ("select parent_id || child_part_id as child_id, min(parent_id) as parent_id, "
          "min(parent_code) as parent_code, min(child_part_id) as child_part_id, "
          "min(child_name) as child_name, cast(sum(amount) as double) as amount, "
          "min(child_name) || ' County, ' || min(parent_code) as region_label "
          "from clean_facts {where} group by parent_id || child_part_id")


@query("clean_facts_residential",
       t.sql(select=_CHILD.format(where=f"where {t.SQL_RESIDENTIAL}")))
def clean_facts_residential(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "child", "residential"), "amount")


@query(
    "clean_facts_commercial",
    t.sql(select="select parent_id, min(parent_code) as parent_code, "
                 "cast(sum(amount) as double) as amount from clean_facts "
                 "where sector_path like '%bolt%' or sector_path like '%gear%' "
                 "or sector_path like '%MEDIUM%' group by parent_id"),
)
def clean_facts_commercial(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "parent", "commercial"), "amount")


@query(
    "clean_facts_industrial",
    t.sql(select="select sector_path, parent_id, min(parent_code) as parent_code, "
                 "cast(sum(amount) as double) as amount from clean_facts "
                 "where sector_path like '%LARGE%' or sector_path like '%widget%' "
                 "group by sector_path, parent_id"),
)
def clean_facts_industrial(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "parent", "industrial", agg=False), "amount")


@query(
    "clean_facts_industrial_rows",
    t.sql(select="select parent_id, parent_code, child_part_id, child_name, sector_path, "
                 "cast(amount as double) as amount, parent_id || child_part_id as child_id, "
                 "child_name || ' County, ' || parent_code as region_label from clean_facts "
                 "where sector_path like '%LARGE%' or sector_path like '%widget%'"),
)
def clean_facts_industrial_rows(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "child", "industrial", agg=False), "amount")


@query(
    "clean_facts_by_sector",
    t.sql(t.SQL_FACT_CHILD_CLASS,
          select="select child_id, major_class, parent_id, parent_code, child_part_id, child_name, "
                 "amount, region_label from fact_child_class"),
)
def clean_facts_by_sector(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "child", "by sector", agg=False), "amount")


@query(
    "clean_facts_by_sector_parent",
    t.sql(select=f"select parent_id, {t.SQL_MAJOR} as major_class, min(parent_code) as parent_code, "
                 "cast(sum(amount) as double) as amount from clean_facts "
                 f"group by parent_id, {t.SQL_MAJOR}"),
)
def clean_facts_by_sector_parent(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "parent", "by sector", agg=False), "amount")


@query("clean_facts_all", t.sql(select=_CHILD.format(where="")))
def clean_facts_all(spark, folder):
    return rounded(t.cleaned_facts(spark, folder, "child", "all"), "amount")
