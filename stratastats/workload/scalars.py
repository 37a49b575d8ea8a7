"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    bucket_index,
    bucket_label,
    cast_string,
    concat_ids,
    decode,
    first_token,
    format_label,
    id_prefix,
    map_or_self,
    parse_dates,
    rate_per_weight,
    ratio,
    region_label,
    round_significant,
    round_trunc_int,
    scale_units,
    scientific_label,
    zero_pad,
)
from ..operators import metric_metadata, minmax_normalise
from . import tables as t
from .registry import query, r6, table


@query(
    "parse_dates",
    "select o_orderkey, o_orderdate as period_begin, "
    "cast(o_orderdate + interval 1 day as timestamp) as period_end from orders",
)
def parse_dates_(spark, folder):
    text = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_begin"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd").alias("period_end"),
    )
    return parse_dates(text, ["period_begin", "period_end"])


@query(
    "cast_string",
    "select o_orderkey, cast(nullif(o_custkey, 0) as varchar) as id from orders",
)
def cast_string_(spark, folder):
    as_double = F.nullif("o_custkey", F.lit(0)).cast("double")
    return table(spark, folder, "orders").select(
        "o_orderkey", cast_string(as_double, numeric=True).alias("id")
    )


@query(
    "zero_pad_id",
    "select c_custkey, case when length(cast(c_custkey as varchar)) < 5 "
    "then lpad(cast(c_custkey as varchar), 5, '0') else cast(c_custkey as varchar) end as id, "
    "cast(c_custkey * 1000 as varchar) as long_id from customer where c_custkey >= 10 "
    "union all select c_custkey, lpad(cast(c_custkey as varchar), 5, '0'), "
    "lpad(cast(c_custkey * 1000 as varchar), 5, '0') from customer where c_custkey < 10",
)
def zero_pad_id(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        zero_pad(F.col("c_custkey").cast("string"), 5).alias("id"),
        zero_pad((F.col("c_custkey") * 1000).cast("string"), 5).alias("long_id"),
    )


@query(
    "id_prefix",
    "select c_custkey, left(lpad(cast(c_custkey as varchar), 5, '0'), 2) as parent_id "
    "from customer where c_custkey < 100000 "
    "union all select c_custkey, left(cast(c_custkey as varchar), 2) "
    "from customer where c_custkey >= 100000",
)
def id_prefix_(spark, folder):
    padded = zero_pad(F.col("c_custkey").cast("string"), 5)
    return table(spark, folder, "customer").select("c_custkey", id_prefix(padded).alias("parent_id"))


@query(
    "concat_ids",
    "select c_custkey, case when c_nationkey <> 0 then "
    "cast(c_nationkey as varchar) || cast(c_custkey as varchar) end as id from customer",
)
def concat_ids_(spark, folder):
    parent = F.nullif("c_nationkey", F.lit(0))
    return table(spark, folder, "customer").select(
        "c_custkey", concat_ids(parent, "c_custkey").alias("id")
    )


@query(
    "region_label",
    "select c_custkey, c_name || ' County, ' || c_mktsegment as label from customer",
)
def region_label_(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", region_label("c_name", "c_mktsegment").alias("label")
    )


@query(
    "split_first",
    "select p_partkey, split_part(p_type || ' - ' || p_name, ' - ', 1) as first, "
    "p_name as whole from part",
)
def split_first(spark, folder):
    path = F.concat("p_type", F.lit(" - "), "p_name")
    return table(spark, folder, "part").select(
        "p_partkey", first_token(path).alias("first"), first_token("p_name").alias("whole")
    )


@query(
    "map_default",
    "select p_partkey, case p_type when 'SMALL' then 'STANDARD' when 'PROMO' then 'OTHER' "
    "else p_type end as major from part",
)
def map_default(spark, folder):
    mapping = {"SMALL": "STANDARD", "PROMO": "OTHER"}
    return table(spark, folder, "part").select(
        "p_partkey", map_or_self("p_type", mapping).alias("major")
    )


@query(
    "round_significant",
    f"select o_orderkey, {t.sql_significant('o_totalprice')} as price from orders",
)
def round_significant_(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", round_significant("o_totalprice").alias("price")
    )


@query(
    "rate_per_weight",
    "select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 7, 0) * 2000, 4) "
    "as rate from lineitem",
)
def rate_per_weight_(spark, folder):
    rate = rate_per_weight("l_extendedprice", F.col("l_quantity") - 7)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(rate, 4).alias("rate")
    )


@query(
    "ratio_pair",
    "select l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) as ratio from lineitem",
)
def ratio_pair(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(ratio("l_tax", "l_discount"), "ratio")
    )


@query("scale_units", "select o_orderkey, round(o_totalprice / 1e5, 8) as value from orders")
def scale_units_(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.round(scale_units("o_totalprice", 1e5), 8).alias("value")
    )


@query(
    "minmax_normalise",
    "select o_orderkey, round((o_totalprice - (select min(o_totalprice) from orders)) / "
    "nullif((select max(o_totalprice) - min(o_totalprice) from orders), 0), 6) as scaled from orders",
)
def minmax_normalise_(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return minmax_normalise(orders, "o_totalprice", "scaled").select("o_orderkey", r6("scaled", "scaled"))


@query(
    "metric_metadata",
    "select 'income' as metric, '(USD)' as unit, 'Median Income' as label, "
    "count(*) as regions, round(avg(c_acctbal), 4) as mean from customer",
)
def metric_metadata_(spark, folder):
    metric = metric_metadata("income")
    return table(spark, folder, "customer").agg(
        F.lit("income").alias("metric"), F.lit(metric.unit).alias("unit"),
        F.lit(metric.label).alias("label"), F.count("*").alias("regions"),
        F.round(F.avg(scale_units("c_acctbal", metric.divisor)), 4).alias("mean"),
    )


@query(
    "format_label",
    "select o_orderkey, o_orderstatus || ': ' || cast(cast(round_even(o_totalprice, 0) as bigint) "
    "as varchar) || ' (USD)' as text, printf('%.1e', o_totalprice) as short from orders",
)
def format_label_(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", format_label("o_orderstatus", "o_totalprice", "(USD)").alias("text"),
        scientific_label("o_totalprice").alias("short"),
    )


@query(
    "round_trunc_int",
    "select c_custkey, cast(trunc(round_even(c_acctbal, 3)) as bigint) as whole from customer",
)
def round_trunc_int_(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", round_trunc_int("c_acctbal").alias("whole")
    )


_BUCKET_SQL = """case when {c} < 0 then null when {c} < 2000 then '<2k' when {c} < 4000 then '2k-4k'
 when {c} < 6000 then '4k-6k' when {c} < 8000 then '6k-8k' else '>8k' end"""


@query(
    "bucket_left_closed",
    f"select c_custkey, {_BUCKET_SQL.format(c='c_acctbal')} as bucket, "
    "cast(case when c_acctbal < 0 then null else least(floor(c_acctbal / 2000), 4) end as integer) "
    "as bucket_no from customer",
)
def bucket_left_closed(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        bucket_label("c_acctbal", t.INCOME_EDGES, t.INCOME_LABELS).alias("bucket"),
        bucket_index("c_acctbal", t.INCOME_EDGES).alias("bucket_no"),
    )


@query(
    "decode_labels",
    "select c_custkey, case when c_nationkey between 1 and 9 "
    "then 'stratum ' || cast(c_nationkey as varchar) end as label from customer",
)
def decode_labels(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", decode("c_nationkey", t.STRATUM_LABELS).alias("label")
    )
