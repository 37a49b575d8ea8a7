"""Ranks and Spearman correlation."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import average_rank, pivot_matrix, spearman
from ..plans import correlation_lines
from ..sources import written
from . import tables as t
from .registry import query, r6, rounded, table

COLUMNS = ["amount_per_person", "income", "rate", "price", "stratum_code"]


def _rank(c: str, over: str = "") -> str:
    part = f"partition by {over}" if over else ""
    same = f"{over}, {c}" if over else c
    return (f"rank() over ({part} order by {c}) + "
            f"(count(*) over (partition by {same}) - 1) / 2.0")


@query(
    "average_rank_global",
    f"select l_orderkey, l_linenumber, l_partkey, "
    f"cast({_rank('l_extendedprice')} as double) as avg_rank from lineitem",
)
def average_rank_global(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    ranked = average_rank(rows, "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return ranked.drop("l_extendedprice")


@query(
    "average_rank_by_group",
    f"select l_orderkey, l_linenumber, l_partkey, l_returnflag, "
    f"cast({_rank('l_quantity', 'l_returnflag')} as double) as avg_rank from lineitem",
)
def average_rank_by_group(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"
    )
    ranked = average_rank(
        rows, "l_quantity", ["l_orderkey", "l_linenumber"], by=["l_returnflag"]
    )
    return ranked.drop("l_quantity")


def _pair_sql(a: str, b: str, frame: str, by: str = "") -> str:
    """Correlation of the ranks of one pair on its complete rows."""
    keep = f"{by} as stratum_code, " if by else ""
    where = f"{a} is not null and {b} is not null" + (f" and {by} is not null" if by else "")
    rho = "case when isnan(corr(ra, rb)) then null else round(corr(ra, rb), 6) end"
    return (
        f"select {'stratum_code, ' if by else ''}'{a}' as a, '{b}' as b, {rho} as rho "
        f"from (select {keep} cast({_rank(a, by)} as double) as ra, "
        f"cast({_rank(b, by)} as double) as rb from {frame} where {where}) "
        f"{'group by stratum_code' if by else ''}"
    )


def _matrix_sql(columns) -> str:
    return t.sql(
        t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD, t.SQL_RATED_CHILD,
        select=" union all ".join(
            f"({_pair_sql(a, b, 'rated_child')})" for a, b in itertools.product(columns, columns)
        ),
    )


@query("spearman_matrix", _matrix_sql(COLUMNS))
def spearman_matrix(spark, folder):
    return rounded(spearman(t.rated(spark, folder), COLUMNS, ["child_id"]), "rho")


@query("spearman_matrix_without_stratum", _matrix_sql(COLUMNS[:-1]))
def spearman_matrix_without_stratum(spark, folder):
    return rounded(spearman(t.rated(spark, folder), COLUMNS[:-1], ["child_id"]), "rho")


@query(
    "pivot_matrix",
    t.sql(
        t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD, t.SQL_RATED_CHILD,
        "long as (" + " union all ".join(
            f"({_pair_sql(a, b, 'rated_child')})"
            for a, b in itertools.product(COLUMNS, COLUMNS)
        ) + ")",
        select="select a, " + ", ".join(
            f"max(case when b = '{c}' then rho end) as {c}" for c in COLUMNS
        ) + " from long group by a",
    ),
)
def pivot_matrix_(spark, folder):
    long = rounded(spearman(t.rated(spark, folder), COLUMNS, ["child_id"]), "rho")
    return pivot_matrix(long, COLUMNS)


@query(
    "spearman_by_stratum",
    t.sql(
        t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD, t.SQL_RATED_CHILD,
        f"i as ({_pair_sql('amount_per_person', 'income', 'rated_child', 'stratum_code')})",
        f"p as ({_pair_sql('amount_per_person', 'price', 'rated_child', 'stratum_code')})",
        select="select cast(i.stratum_code as integer) as stratum_code, i.rho as rho_income, "
               "p.rho as rho_price, 'stratum ' || cast(i.stratum_code as varchar) as label "
               "from i join p on i.stratum_code = p.stratum_code",
    ),
)
def spearman_by_stratum(spark, folder):
    rated = t.rated(spark, folder).withColumn("stratum_code", F.col("stratum_code").cast("int"))
    lines = correlation_lines(rated, ["child_id"], labels=t.STRATUM_LABELS)
    return rounded(lines, "rho_income", "rho_price")
