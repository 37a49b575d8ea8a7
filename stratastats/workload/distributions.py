"""Histograms, moments, normal curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    excess_kurtosis,
    histogram,
    histogram_panel,
    normal_curve,
    normal_fit,
    normality_report,
)
from ..plans import presets
from ..sources import written
from . import tables as t
from .registry import query, r6, rounded, table


def histogram_sql(frame: str, column: str, bins: int, divisor: str = "1.0",
                  extra: str = "", density: bool = False) -> str:
    """Bins by comparing every value with the bin edges."""
    tail = ", round(count / (n * (w)), 9) as density" if density else ""
    return f"""
    select {extra} bin, round(lo, 6) as lo, round(hi, 6) as hi, count {tail} from (
      select b.bin, b.lo, b.hi, b.n, b.w, count(v.x) as count
      from (select cast(i as integer) as bin, e.n, (e.hi - e.lo) / {bins} as w,
                   e.lo + i * ((e.hi - e.lo) / {bins}) as lo,
                   case when i = {bins} - 1 then e.hi
                        else e.lo + (i + 1) * ((e.hi - e.lo) / {bins}) end as hi
            from range({bins}) r(i), (select min({column} / {divisor}) as lo,
              max({column} / {divisor}) as hi, count({column}) as n from {frame}) e) b
      left join (select {column} / {divisor} as x from {frame} where {column} is not null) v
        on v.x >= b.lo and (v.x < b.hi or (b.bin = {bins} - 1 and v.x <= b.hi))
      group by b.bin, b.lo, b.hi, b.n, b.w)"""


@query("histogram", histogram_sql("orders", "o_totalprice", 20, "1e5"))
def histogram_(spark, folder):
    out = histogram(table(spark, folder, "orders"), "o_totalprice", 20, 1e5)
    return rounded(out, "lo", "hi")


@query("histogram_density", histogram_sql("lineitem", "l_extendedprice", 50, density=True))
def histogram_density(spark, folder):
    out = histogram(table(spark, folder, "lineitem"), "l_extendedprice", 50, density=True)
    return rounded(rounded(out, "lo", "hi"), "density", places=9)


_PANEL = [
    ("Income", "customer", "c_acctbal", "1e3", 9),
    ("Property Value", "orders", "o_totalprice", "1e5", 40),
    ("Unemployment", "lineitem", "l_discount", "1.0", 11),
    ("Emissions", "lineitem", "l_extendedprice", "1e5", 200),
]


@query(
    "histogram_panel",
    " union all ".join(
        f"({histogram_sql(frame, c, bins, div, extra=f'{chr(39)}{metric}{chr(39)} as metric,')})"
        for metric, frame, c, div, bins in _PANEL
    ),
)
def histogram_panel_(spark, folder):
    frames = {frame: table(spark, folder, frame) for _, frame, *_ in _PANEL}
    panels = [(metric, frames[frame], c, float(div), bins) for metric, frame, c, div, bins in _PANEL]
    return rounded(histogram_panel(panels), "lo", "hi")


def _level_panels(level: str) -> list[tuple[str, str, str, str, int]]:
    """Title, SQL frame, column, divisor and bins of the published panels at a level."""
    attributes = "attr_parent" if level == "parent" else "clean_attributes"
    frames = [attributes, f"price_{level}", attributes, f"fact_{level}"]
    return list(
        zip(
            ["Income", "Property Value", "Unemployment Rates", "Emissions"], frames,
            presets.PANEL_METRICS, ["1e3", "1e5", "1.0", "1e5"], presets.PANEL_BINS[level],
        )
    )


def _level_sql(level: str) -> str:
    facts = t.SQL_FACT_PARENT if level == "parent" else t.SQL_FACT_CHILD
    return t.sql(
        facts,
        select=" union all ".join(
            f"({histogram_sql(frame, c, bins, div, extra=f'{chr(39)}{title}{chr(39)} as metric,')})"
            for title, frame, c, div, bins in _level_panels(level)
        ),
    )


def _level_panel(spark, folder, level):
    frames = {
        "attributes": written(t.cleaned_attributes(spark, folder, level), "attributes"),
        "price": written(t.cleaned_prices(spark, folder, level), "prices"),
        "fact": written(t.cleaned_facts(spark, folder, level), "facts"),
    }
    source = {"income": "attributes", "rate": "attributes", "price": "price", "amount": "fact"}
    panels = [
        (title, frames[source[c]], c, float(div), bins)
        for title, _, c, div, bins in _level_panels(level)
    ]
    return rounded(histogram_panel(panels), "lo", "hi")


@query("histogram_panel_parent", _level_sql("parent"))
def histogram_panel_parent(spark, folder):
    return _level_panel(spark, folder, "parent")


@query("histogram_panel_child", _level_sql("child"))
def histogram_panel_child(spark, folder):
    return _level_panel(spark, folder, "child")


_FIT_SQL = ("select count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mu, "
            "round(stddev_pop(l_extendedprice), 4) as sigma, "
            "round(kurtosis_pop(l_extendedprice), 6) as kurtosis from lineitem")


@query("normal_fit", _FIT_SQL)
def normal_fit_(spark, folder):
    fit = normal_fit(table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(rounded(fit, "mu", "sigma", places=4), "kurtosis")


def curve_sql(frame: str, column: str) -> str:
    return f"""
    select cast(i as integer) as point, l + (r - l) * i / 99 as x,
           exp(-power((l + (r - l) * i / 99 - mu) / sigma, 2) / 2) / (sigma * sqrt(2 * pi())) as density
    from range(100) g(i), (
      select min({column}) - 0.05 * (max({column}) - min({column})) as l,
             max({column}) + 0.05 * (max({column}) - min({column})) as r,
             avg({column}) as mu, stddev_pop({column}) as sigma from {frame})"""


@query(
    "normal_curve",
    "select point, round(x, 4) as x, round(density, 9) as density from ("
    + curve_sql("lineitem", "l_extendedprice") + ")",
)
def normal_curve_(spark, folder):
    curve = normal_curve(table(spark, folder, "lineitem"), "l_extendedprice")
    return rounded(rounded(curve, "x", places=4), "density", places=9)


@query(
    "excess_kurtosis",
    "select l_returnflag, round(kurtosis_pop(l_quantity), 6) as kurtosis from lineitem "
    "group by l_returnflag",
)
def excess_kurtosis_(spark, folder):
    return (
        table(spark, folder, "lineitem").groupBy("l_returnflag")
        .agg(r6(excess_kurtosis("l_quantity"), "kurtosis"))
    )


@query(
    "normality_report",
    t.sql(
        t.SQL_FACT_CHILD, t.SQL_MERGED_CHILD, t.SQL_RATED_CHILD,
        select=f"""
        select 'histogram' as part, bin as i, round(lo, 4) as x, density as y
        from ({histogram_sql('rated_child', 'amount_per_person', 50, density=True)})
        union all
        select 'curve', point, round(x, 4), round(density, 9)
        from ({curve_sql('rated_child', 'amount_per_person')})
        union all select 'mu', 0, null, round(avg(amount_per_person), 4) from rated_child
        union all select 'sigma', 0, null, round(stddev_pop(amount_per_person), 4) from rated_child
        union all select 'kurtosis', 0, null, round(kurtosis_pop(amount_per_person), 4)
        from rated_child""",
    ),
)
def normality_report_(spark, folder):
    rated = written(t.rated(spark, folder).select("amount_per_person"), "rated")
    report = rounded(normality_report(rated, "amount_per_person"), "x", places=4)
    fine = F.col("part").isin("histogram", "curve")
    return report.withColumn("y", F.when(fine, F.round("y", 9)).otherwise(F.round("y", 4)))
