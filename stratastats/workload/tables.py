"""The supplied tables seen as facts, attributes and prices, and the same in SQL.

A customer is the child place, its nation the parent. Line items are the facts,
with part type and name as the category path; orders give the weight of a place
(their number), its rate (share of urgent ones) and, for one year, its prices.
Nulls come from the data: no stratum for some nations, no price on low-priority
orders, no weight for customers without orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import zero_pad
from ..plans import clean_attributes, clean_facts, clean_prices, with_ratios
from ..operators import merge_sources
from .registry import table

YEAR = 1997
EQUALS = {"region_type": "F"}
EXCLUDED_PARENT = "State NATION_8"
FACT_EXCLUDED = ["NATION_3", "NATION_20"]
ATTRIBUTE_EXCLUDED = ["NATION_3", "NATION_21"]
MAPPING = {"SMALL": "STANDARD"}
EXCLUDED_CLASS = "PROMO"
CONTRIBUTORS = {
    "residential": ["ring", "ECONOMY"],
    "commercial": ["bolt", "gear", "MEDIUM"],
    "industrial": ["LARGE", "widget"],
}
INCOME_EDGES = [0, 2000, 4000, 6000, 8000]
INCOME_LABELS = ["<2k", "2k-4k", "4k-6k", "6k-8k", ">8k"]
STRATUM_LABELS = {i: f"stratum {i}" for i in range(1, 10)}
ID_WIDTH = 13


def facts(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    path = F.concat("p_type", F.lit(" - "), "p_name")
    part = table(spark, folder, "part").select("p_partkey", path.alias("sector_path"))
    # Places first, without the facts: those then move for the part and for the order only.
    places = orders.join(
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            zero_pad(F.col("c_nationkey").cast("string"), 2).alias("parent_id"),
            F.col("n_name").alias("parent_code"),
            zero_pad(F.col("c_custkey").cast("string"), 11).alias("child_part_id"),
            F.col("c_name").alias("child_name"),
            "sector_path",
            F.col("l_extendedprice").alias("amount"),
        )
    )


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    per_customer = (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("weight"), (urgent * 100 / F.count("*")).alias("rate"))
    )
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            (F.col("c_nationkey") * F.lit(100_000_000_000) + F.col("c_custkey")).alias("area_id"),
            F.col("c_name").alias("area_name"),
            F.col("n_name").alias("parent_code"),
            "weight",
            F.col("c_acctbal").alias("income"),
            "rate",
            F.nullif(F.col("c_nationkey") % 10, F.lit(0)).alias("stratum_code"),
        )
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").alias("period_begin"),
            F.col("o_orderstatus").alias("region_type"),
            F.concat(F.lit("State "), "n_name").alias("parent_name"),
            F.col("n_name").alias("parent_code"),
            F.concat("c_name", F.lit(" County, "), "n_name").alias("region_label"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
        )
    )


def cleaned_prices(spark, folder, level, **kw) -> DataFrame:
    return clean_prices(prices(spark, folder), level, YEAR, EQUALS, EXCLUDED_PARENT, **kw)


def cleaned_attributes(spark, folder, level) -> DataFrame:
    return clean_attributes(attributes(spark, folder), level, ATTRIBUTE_EXCLUDED, ID_WIDTH)


def cleaned_facts(spark, folder, level, contributor="residential", agg=True) -> DataFrame:
    return clean_facts(
        facts(spark, folder), level, contributor, agg, CONTRIBUTORS, MAPPING, FACT_EXCLUDED
    )


def merged(spark, folder, level, contributor="residential", agg=True) -> DataFrame:
    return merge_sources(
        cleaned_facts(spark, folder, level, contributor, agg),
        cleaned_attributes(spark, folder, level),
        cleaned_prices(spark, folder, level),
        level,
    )


def rated(spark, folder, level="child") -> DataFrame:
    return with_ratios(merged(spark, folder, level))


# ---------------------------------------------------------------- the same in SQL

SQL_FACTS = """
facts as (
  select lpad(cast(c_nationkey as varchar), 2, '0') as parent_id, n_name as parent_code,
         lpad(cast(c_custkey as varchar), 11, '0') as child_part_id, c_name as child_name,
         p_type || ' - ' || p_name as sector_path,
         cast(l_extendedprice as decimal(14,2)) as amount
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey)"""

SQL_ATTRIBUTES = """
attributes as (
  select lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(c_custkey as varchar), 11, '0')
           as child_id,
         lpad(cast(c_nationkey as varchar), 2, '0') as parent_id, c_name as area_name,
         n_name as code, weight, c_acctbal as income, rate,
         nullif(c_nationkey % 10, 0) as stratum_code
  from customer join nation on c_nationkey = n_nationkey
       left join (select o_custkey, count(*) as weight,
                         100.0 * sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end)
                           / cast(count(*) as double) as rate
                  from orders group by o_custkey) on o_custkey = c_custkey)"""

SQL_PRICES = """
prices as (
  select o_orderdate as period_begin, o_orderstatus as region_type,
         'State ' || n_name as parent_name, n_name as parent_code,
         c_name || ' County, ' || n_name as region_label,
         case when o_orderpriority <> '5-LOW' then o_totalprice end as price
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

SQL_CLEAN_FACTS = """
clean_facts as (
  select * from facts where parent_code not in ('NATION_3', 'NATION_20'))"""

SQL_CLEAN_ATTRIBUTES = """
clean_attributes as (
  select * from attributes
  where weight is not null and income is not null and rate is not null
    and code not in ('NATION_3', 'NATION_21'))"""

SQL_CLEAN_PRICES = """
clean_prices as (
  select * from prices
  where period_begin >= timestamp '1997-01-01 00:00:00'
    and period_begin < timestamp '1998-01-01 00:00:00'
    and region_type = 'F' and price is not null and parent_name <> 'State NATION_8')"""

SQL_RESIDENTIAL = "(contains(sector_path, 'ring') or contains(sector_path, 'ECONOMY'))"
SQL_MAJOR = (
    "case when split_part(sector_path, ' - ', 1) = 'SMALL' then 'STANDARD' "
    "else split_part(sector_path, ' - ', 1) end"
)


def sql_significant(c: str) -> str:
    """Six significant digits, half-even."""
    places = f"(5 - floor(log10(abs({c}))))"
    return (
        f"case when {c} = 0 then 0.0 "
        f"when {places} >= 0 then round_even({c} * pow(10, {places}), 0) / pow(10, {places}) "
        f"else round_even({c} / pow(10, -{places}), 0) * pow(10, -{places}) end"
    )


SQL_PRICE_CHILD = f"""
price_child as (
  select region_label as price_label, parent_name, price_code,
         {sql_significant('m')} as price
  from (select region_label, min(parent_name) as parent_name, min(parent_code) as price_code,
               median(price) as m from clean_prices group by region_label))"""

SQL_PRICE_PARENT = f"""
price_parent as (
  select parent_name, price_code, {sql_significant('m')} as price
  from (select parent_name, min(parent_code) as price_code, median(price) as m
        from clean_prices group by parent_name))"""

SQL_ATTR_PARENT = """
attr_parent as (
  select code, min(child_id) as child_id, min(parent_id) as parent_id, sum(weight) as weight,
         sum(income * weight) / sum(weight) as income, sum(rate * weight) / sum(weight) as rate
  from clean_attributes group by code)"""

SQL_BASE = "with " + ",".join(
    [SQL_FACTS, SQL_ATTRIBUTES, SQL_PRICES, SQL_CLEAN_FACTS, SQL_CLEAN_ATTRIBUTES,
     SQL_CLEAN_PRICES, SQL_PRICE_CHILD, SQL_PRICE_PARENT, SQL_ATTR_PARENT]
)

SQL_FACT_CHILD = f"""
fact_child as (
  select parent_id || child_part_id as child_id, min(parent_id) as parent_id,
         min(parent_code) as parent_code, min(child_part_id) as child_part_id,
         min(child_name) as child_name, cast(sum(amount) as double) as amount,
         min(child_name) || ' County, ' || min(parent_code) as region_label
  from clean_facts where {SQL_RESIDENTIAL} group by parent_id || child_part_id)"""

SQL_FACT_PARENT = f"""
fact_parent as (
  select parent_id, min(parent_code) as parent_code, cast(sum(amount) as double) as amount
  from clean_facts where {SQL_RESIDENTIAL} group by parent_id)"""

SQL_FACT_CHILD_CLASS = f"""
fact_child_class as (
  select parent_id || child_part_id as child_id, {SQL_MAJOR} as major_class,
         min(parent_id) as parent_id, min(parent_code) as parent_code,
         min(child_part_id) as child_part_id, min(child_name) as child_name,
         cast(sum(amount) as double) as amount,
         min(child_name) || ' County, ' || min(parent_code) as region_label
  from clean_facts group by parent_id || child_part_id, {SQL_MAJOR})"""

SQL_MERGED_CHILD = """
merged_child as (
  select f.parent_code, f.parent_id, f.child_part_id, f.child_name, a.stratum_code, f.amount,
         a.weight, a.income, a.rate, p.price, f.child_id
  from fact_child f join clean_attributes a on a.child_id = f.child_id
       join price_child p on p.price_label = f.region_label)"""

SQL_MERGED_PARENT = """
merged_parent as (
  select f.parent_code, f.parent_id, f.amount, a.weight, a.income, a.rate, p.price, p.parent_name
  from fact_parent f join attr_parent a on a.parent_id = f.parent_id
       join price_parent p on p.price_code = a.code)"""

SQL_MERGED_CLASS = """
merged_class as (
  select f.parent_code, f.child_id, f.major_class, f.amount, a.stratum_code, a.weight, a.income,
         a.rate, p.price
  from fact_child_class f join clean_attributes a on a.child_id = f.child_id
       join price_child p on p.price_label = f.region_label)"""

SQL_RATED_CHILD = """
rated_child as (
  select *, amount / nullif(cast(weight as double), 0) * 2000.0 as amount_per_person,
         amount / nullif(cast(weight as double), 0) * 2000.0 / nullif(income, 0) as income_ratio,
         amount / nullif(cast(weight as double), 0) * 2000.0 / nullif(price, 0) as price_ratio
  from merged_child)"""

SQL_RATED_PARENT = SQL_RATED_CHILD.replace("rated_child", "rated_parent").replace(
    "merged_child", "merged_parent"
)


def sql(*ctes: str, select: str) -> str:
    """The shared base, further CTEs in order, and a final select."""
    return ",".join([SQL_BASE, *ctes]) + "\n" + select
