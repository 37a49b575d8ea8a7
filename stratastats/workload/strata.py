"""Composition, drift, reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amount_terms, sign_flag
from ..operators import (
    composition,
    drift_domain,
    flatten_map,
    union_all,
    unpivot_drop_null,
    with_drift_flags,
)
from ..plans import bucket_drift, class_drift
from ..sources import written
from . import tables as t
from .filters import drift_sql
from .registry import query, rounded, table

_CTES = (t.SQL_FACT_CHILD_CLASS, t.SQL_MERGED_CLASS)
_DRIFT_CTES = (*_CTES, drift_sql("stratum_code"))


def _by_class(spark, folder):
    merged = t.merged(spark, folder, "child", "by sector", agg=False)
    return merged.withColumn("stratum_code", F.col("stratum_code").cast("int"))


def _drift(spark, folder):
    return class_drift(_by_class(spark, folder), excluded=t.EXCLUDED_CLASS)


@query(
    "composition_baseline",
    t.sql(*_DRIFT_CTES, select="select major_class, round(share, 6) as share from base"),
)
def composition_baseline(spark, folder):
    terms = amount_terms("amount", "weight")
    out = composition(_by_class(spark, folder), "major_class", terms, excluded=t.EXCLUDED_CLASS)
    return rounded(out, "share")


@query(
    "composition_by_stratum",
    t.sql(*_DRIFT_CTES,
          select="select cast(t.stratum as integer) as stratum_code, t.major_class, "
                 "round(100 * t.m / s.s, 6) as share from strat_mean t "
                 "join strat_total s on s.stratum = t.stratum where t.major_class <> 'PROMO'"),
)
def composition_by_stratum(spark, folder):
    out = composition(
        _by_class(spark, folder), "major_class", amount_terms("amount", "weight"),
        ["stratum_code"], t.EXCLUDED_CLASS,
    )
    return rounded(out, "share")


@query(
    "drift_by_code",
    t.sql(*_DRIFT_CTES,
          select="select cast(stratum as integer) as stratum_code, major_class, "
                 "round(drift, 6) as drift from drift"),
)
def drift_by_code(spark, folder):
    return rounded(_drift(spark, folder), "drift")


_BUCKET_CTES = (
    *_CTES,
    "bucketed as (select *, case when income < 0 then null when income < 2000 then '<2k' "
    "when income < 4000 then '2k-4k' when income < 6000 then '4k-6k' when income < 8000 then '6k-8k' "
    "else '>8k' end as bucket from merged_class)",
    drift_sql("bucket", "bucketed"),
)


@query(
    "drift_by_bucket",
    t.sql(*_BUCKET_CTES,
          select="select stratum as bucket, major_class, round(drift, 6) as drift, "
                 "cast(case stratum when '<2k' then 0 when '2k-4k' then 1 when '4k-6k' then 2 "
                 "when '6k-8k' then 3 else 4 end as integer) as label_no from drift"),
)
def drift_by_bucket(spark, folder):
    drift = bucket_drift(
        _by_class(spark, folder), "income", edges=t.INCOME_EDGES, labels=t.INCOME_LABELS,
        excluded=t.EXCLUDED_CLASS,
    )
    return rounded(drift, "drift")


@query(
    "drift_domain",
    t.sql(*_DRIFT_CTES,
          select="select 'shared' as axis, null::integer as stratum_code, "
                 "round(greatest(abs(min(drift)), abs(max(drift))) * 1.2, 6) as domain from drift "
                 "union all select 'own', cast(stratum as integer), "
                 "round(greatest(abs(min(drift)), abs(max(drift))) * 1.2, 6) from drift "
                 "group by stratum"),
)
def drift_domain_(spark, folder):
    drift = written(_drift(spark, folder), "drift")
    shared = drift_domain(drift).withColumn("axis", F.lit("shared"))
    own = drift_domain(drift, ["stratum_code"]).withColumn("axis", F.lit("own"))
    return rounded(union_all([own, shared]), "domain")


@query(
    "sign_flag",
    "select c_custkey, case when c_acctbal > 0 then 'above' else 'not_above' end as flag from customer",
)
def sign_flag_(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", sign_flag("c_acctbal").alias("flag"))


@query(
    "near_zero_flag",
    t.sql(*_DRIFT_CTES,
          select="select cast(stratum as integer) as stratum_code, major_class, "
                 "round(drift, 6) as drift, "
                 "case when drift > 0 then 'above' else 'not_above' end as flag, "
                 "abs(drift) < 0.02 * (select greatest(abs(min(drift)), abs(max(drift))) from drift) "
                 "as near_zero from drift"),
)
def near_zero_flag_(spark, folder):
    return rounded(with_drift_flags(_drift(spark, folder)), "drift")


@query(
    "near_zero_flag_own_axis",
    t.sql(*_DRIFT_CTES,
          select="select cast(stratum as integer) as stratum_code, major_class, "
                 "round(drift, 6) as drift, "
                 "case when drift > 0 then 'above' else 'not_above' end as flag, "
                 "abs(drift) < 0.02 * max(abs(drift)) over (partition by stratum) "
                 "as near_zero from drift"),
)
def near_zero_flag_own_axis_(spark, folder):
    return rounded(with_drift_flags(_drift(spark, folder), by=["stratum_code"]), "drift")


_WIDE = ["F", "O", "P"]


@query(
    "unpivot_drop_null",
    "select o_custkey, o_orderstatus as sector, max(o_totalprice) as value from orders "
    "group by o_custkey, o_orderstatus",
)
def unpivot_drop_null_(spark, folder):
    wide = (
        table(spark, folder, "orders").groupBy("o_custkey").pivot("o_orderstatus", _WIDE)
        .agg(F.max("o_totalprice"))
    )
    return unpivot_drop_null(wide, ["o_custkey"], _WIDE)


@query(
    "flatten_map",
    "select o_orderkey, 'status' as inner_key, o_orderstatus as value from orders union all "
    "select o_orderkey, 'priority', o_orderpriority from orders",
)
def flatten_map_(spark, folder):
    nested = F.create_map(
        F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")
    )
    return flatten_map(table(spark, folder, "orders"), "o_orderkey", nested, "inner_key")
