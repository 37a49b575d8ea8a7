"""Aggregations, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scale_units, weighted_terms
from ..operators import (
    bottom_n,
    carried,
    category_dictionary,
    exact_sums,
    extremes,
    extremes_panel,
    group_sum,
    grouped_median,
    roll_up,
    sort_custom_order,
    top_n,
    union_all,
    weighted_means,
)
from ..plans import ratio_extremes
from ..sources import written
from . import tables as t
from .registry import query, r6, rounded, table


@query(
    "sum_by_parent",
    f"with {t.SQL_FACTS} select parent_id, min(parent_code) as parent_code, "
    "cast(sum(amount) as double) as amount from facts group by parent_id",
)
def sum_by_parent(spark, folder):
    return rounded(group_sum(t.facts(spark, folder), ["parent_id"], "amount", ["parent_code"]), "amount")


@query(
    "sum_by_child",
    f"with {t.SQL_FACTS} select parent_id, child_part_id, min(parent_code) as parent_code, "
    "min(child_name) as child_name, cast(sum(amount) as double) as amount "
    "from facts group by parent_id, child_part_id",
)
def sum_by_child(spark, folder):
    out = group_sum(
        t.facts(spark, folder), ["parent_id", "child_part_id"], "amount", ["parent_code", "child_name"]
    )
    return rounded(out, "amount")


@query(
    "sum_by_parent_minor",
    f"with {t.SQL_FACTS} select sector_path, parent_id, min(parent_code) as parent_code, "
    "cast(sum(amount) as double) as amount from facts group by sector_path, parent_id",
)
def sum_by_parent_minor(spark, folder):
    out = group_sum(t.facts(spark, folder), ["sector_path", "parent_id"], "amount", ["parent_code"])
    return rounded(out, "amount")


@query(
    "carry_first",
    "select c_nationkey, min(c_mktsegment) as segment, min(n_name) as nation from customer "
    "join nation on c_nationkey = n_nationkey group by c_nationkey",
)
def carry_first_(spark, folder):
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return carried(joined, ["c_nationkey"], {"c_mktsegment": "segment", "n_name": "nation"})


_MEDIAN_PARENT = (
    f"with {t.SQL_PRICES} select parent_code, round(median(price), 4) as price from prices "
    "group by parent_code"
)


@query("median_by_parent", _MEDIAN_PARENT)
def median_by_parent(spark, folder):
    return rounded(grouped_median(t.prices(spark, folder), ["parent_code"], "price", "price"),
                   "price", places=4)


@query("median_large_groups", _MEDIAN_PARENT)
def median_large_groups(spark, folder):
    """The same medians with cuts of a few hundred rows, as of groups too large for one task."""
    medians = grouped_median(t.prices(spark, folder), ["parent_code"], "price", "price",
                             task_rows=500)
    return rounded(medians, "price", places=4)


@query(
    "median_by_child",
    f"with {t.SQL_PRICES} select region_label, round(median(price), 4) as price from prices "
    "group by region_label",
)
def median_by_child(spark, folder):
    return rounded(grouped_median(t.prices(spark, folder), ["region_label"], "price", "price"),
                   "price", places=4)


@query(
    "weighted_avg_global",
    f"with {t.SQL_ATTRIBUTES} select round(sum(income * weight) / "
    "sum(case when income is not null then weight end), 6) as income from attributes",
)
def weighted_avg_global(spark, folder):
    found = weighted_means(t.attributes(spark, folder), [], {"income": weighted_terms("income", "weight")})
    return found.select(r6("income", "income"))


@query(
    "weighted_avg_by_group",
    f"with {t.SQL_ATTRIBUTES} select code, cast(sum(weight) as bigint) as weight, "
    "round(sum(income * weight) / sum(weight), 6) as income, "
    "round(sum(rate * weight) / sum(weight), 6) as rate from attributes group by code",
)
def weighted_avg_by_group(spark, folder):
    rows = t.attributes(spark, folder).withColumnRenamed("parent_code", "code").dropna(subset=["code"])
    terms = {c: weighted_terms(c, "weight") for c in ("income", "rate")}
    names, sums = ["weight"], [F.col("weight")]
    for c, term in terms.items():
        names += [f"{c}_num", f"{c}_den"]
        sums += [term.num, term.den]
    found = exact_sums(rows, ["code"], dict(zip(names, sums)))
    return found.select(
        "code", F.col("weight").cast("bigint").alias("weight"),
        *[r6(F.try_divide(f"{c}_num", f"{c}_den"), c) for c in terms],
    )


@query(
    "sum_exact",
    f"with {t.SQL_FACTS} select parent_id, child_part_id, min(parent_code) as parent_code, "
    "min(child_name) as child_name, cast(sum(amount) as double) as amount "
    "from facts group by parent_id, child_part_id",
)
def sum_exact(spark, folder):
    """Sums that no order of rows or tasks changes, not in the last bit."""
    out = group_sum(
        t.facts(spark, folder), ["parent_id", "child_part_id"], "amount",
        ["parent_code", "child_name"], exact=True,
    )
    return rounded(out, "amount")


@query(
    "rollup_child",
    f"with {t.SQL_FACTS} select parent_id || child_part_id as child_id, {t.SQL_MAJOR} as major_class, "
    "min(parent_code) as parent_code, cast(sum(amount) as double) as amount "
    f"from facts group by parent_id || child_part_id, {t.SQL_MAJOR}",
)
def rollup_child(spark, folder):
    facts = t.facts(spark, folder).withColumn("child_id", F.concat("parent_id", "child_part_id"))
    out = roll_up(facts, ["child_id"], "sector_path", "amount", t.MAPPING, ["parent_code"])
    return rounded(out, "amount")


@query(
    "rollup_parent",
    f"with {t.SQL_FACTS} select parent_id, {t.SQL_MAJOR} as major_class, "
    "min(parent_code) as parent_code, cast(sum(amount) as double) as amount "
    f"from facts group by parent_id, {t.SQL_MAJOR}",
)
def rollup_parent(spark, folder):
    out = roll_up(t.facts(spark, folder), ["parent_id"], "sector_path", "amount", t.MAPPING,
                  ["parent_code"])
    return rounded(out, "amount")


@query(
    "category_dictionary",
    f"with {t.SQL_FACTS} select distinct {t.SQL_MAJOR} as major, sector_path as minor from facts",
)
def category_dictionary_(spark, folder):
    return category_dictionary(t.facts(spark, folder), "sector_path", t.MAPPING)


_TOP = ("select c_custkey, c_acctbal from (select c_custkey, case when c_nationkey <> 4 "
        "then c_acctbal end as c_acctbal from customer) order by c_acctbal {} nulls last, c_custkey limit 5")


def _balances(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") != 4, F.col("c_acctbal")).alias("c_acctbal")
    )


@query("top_n", _TOP.format("desc"))
def top_n_(spark, folder):
    return top_n(_balances(spark, folder), "c_acctbal", ["c_custkey"])


@query("bottom_n", _TOP.format("asc"))
def bottom_n_(spark, folder):
    return bottom_n(_balances(spark, folder), "c_acctbal", ["c_custkey"])


def extremes_sql(frame: str, value: str, key: str, columns: str) -> str:
    """Both halves, numbered."""
    return " union all ".join(
        f"select * from (select {columns}, '{side}' as side, cast(row_number() over "
        f"(order by {value} {way} nulls last, {key}) as integer) as rank_no from {frame}) "
        "where rank_no <= 5"
        for side, way in (("top", "desc"), ("bottom", "asc"))
    )


@query("extremes", extremes_sql("orders", "o_totalprice", "o_orderkey", "o_orderkey, o_totalprice"))
def extremes_(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return extremes(orders, "o_totalprice", ["o_orderkey"])


def _panel_sql(metric: str, value: str, divisor: str) -> str:
    picked = extremes_sql("rated_parent", value, "parent_code",
                          f"{value} as v, parent_code, weight")
    return (
        f"select '{metric}' as metric, side, rank_no, parent_code as location, "
        f"round(v / {divisor}, 6) as value, round(weight / 100000.0, 6) as secondary, "
        f"printf('%.1e', v / {divisor}) as label from ({picked})"
    )


_PANEL = [("Income", "income", "1e3"), ("Property Value", "price", "1e5"),
          ("Unemployment Rate", "rate", "1.0"), ("Emission", "amount", "1e5"),
          ("P2I Ratio", "income_ratio", "1.0"), ("P2PV Ratio", "price_ratio", "1.0")]


@query(
    "extremes_panel",
    t.sql(t.SQL_FACT_PARENT, t.SQL_MERGED_PARENT, t.SQL_RATED_PARENT,
          select=" union all ".join(_panel_sql(*p) for p in _PANEL)),
)
def extremes_panel_(spark, folder):
    rated = written(t.rated(spark, folder, "parent"), "rated")
    panels = [(m, rated, c, float(d), "parent_code") for m, c, d in _PANEL]
    out = extremes_panel(panels, ["parent_code"], secondary="weight")
    return rounded(out, "value", "secondary")


@query(
    "ratio_extremes",
    t.sql(
        t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD, t.SQL_RATED_CHILD,
        select=" union all ".join(
            f"select '{m}' as metric, side, rank_no, child_id, parent_code, "
            f"round({m}, 6) as ratio, round(amount_per_person, 4) as amount_per_person from ("
            + extremes_sql("rated_child", m, "child_id",
                           f"{m}, child_id, parent_code, amount_per_person")
            + ")"
            for m in ("income_ratio", "price_ratio")
        ),
    ),
)
def ratio_extremes_(spark, folder):
    found = ratio_extremes(t.merged(spark, folder, "child"), ["child_id"])
    return found.select(
        "metric", "side", "rank_no", "child_id", "parent_code", r6("ratio", "ratio"),
        F.round("amount_per_person", 4).alias("amount_per_person"),
    )


@query(
    "sort_by_measure",
    "select c_custkey, round(c_acctbal / 1000, 6) as balance from customer "
    "order by c_acctbal desc, c_custkey",
)
def sort_by_measure(spark, folder):
    return (
        table(spark, folder, "customer")
        .orderBy(F.desc("c_acctbal"), "c_custkey")
        .select("c_custkey", r6(scale_units("c_acctbal", 1000), "balance"))
    )


@query(
    "sort_custom_order",
    "select p_type, count(*) as parts, cast(case p_type when 'PROMO' then 0 when 'SMALL' then 1 "
    "when 'LARGE' then 2 end as integer) as label_no from part group by p_type",
)
def sort_custom_order_(spark, folder):
    counted = table(spark, folder, "part").groupBy("p_type").agg(F.count("*").alias("parts"))
    return sort_custom_order(counted, "p_type", ["PROMO", "SMALL", "LARGE"], "p_type")


@query(
    "union_all",
    "select s_suppkey as id, s_acctbal as balance, 'supplier' as kind from supplier "
    "union all select c_custkey, c_acctbal, 'customer' from customer",
)
def union_all_(spark, folder):
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"),
        F.lit("supplier").alias("kind"),
    )
    customer = table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
    )
    return union_all([supplier, customer])
