"""Cleaning rules at both levels, and the shape of the physical plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stratastats.functions import format_label, round_trunc_int
from stratastats.operators import average_rank, extremes_panel, histogram_panel, map_tables, merge_sources, top_n
from stratastats.plans import bucket_drift, clean_attributes, clean_facts, clean_prices, presets
from stratastats.plans import ratio_extremes, with_ratios
from stratastats.sources import written
from stratastats.workload import QUERIES
from stratastats.workload import tables as t


def rows_by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("01", "AL", "001", "Autauga", "Mobile - Light Duty", 1.0),
        ("01", "AL", "001", "Autauga", "Fires - Wild", 2.0),
        ("01", "AL", "003", "Baldwin", "Fuel Comb - Residential - Wood", 4.0),
        ("01", "AL", "003", "Baldwin", "Gas Stations", 8.0),
        ("72", "PR", "001", "Adjuntas", "Mobile - Light Duty", 16.0),
        ("02", None, "005", "Unknown", "Mobile - Aircraft", 32.0),
    ]
    return spark.createDataFrame(
        rows, "parent_id string, parent_code string, child_part_id string, child_name string, "
        "sector_path string, amount double",
    )


def test_clean_facts_levels_and_contributors(facts):
    home = rows_by(clean_facts(facts, "STATE"), "parent_id")
    assert {k: r.amount for k, r in home.items()} == {("01",): 5.0}
    child = rows_by(clean_facts(facts, "COUNTY"), "child_id")
    assert {k[0]: (r.amount, r.region_label) for k, r in child.items()} == {
        "01001": (1.0, "Autauga County, AL"), "01003": (4.0, "Baldwin County, AL"),
    }
    every = rows_by(clean_facts(facts, "STATE", "all"), "parent_id")
    assert {k[0]: (r.amount, r.parent_code) for k, r in every.items()} == {
        "01": (15.0, "AL"), "02": (32.0, None),
    }


def test_clean_facts_grain(facts):
    major = clean_facts(facts, "parent", "by sector", agg=False, mapping={"Gas Stations": "Trade"})
    assert {(r.parent_id, r.major_class): r.amount for r in major.collect()} == {
        ("01", "Mobile"): 1.0, ("01", "Fires"): 2.0, ("01", "Fuel Comb"): 4.0, ("01", "Trade"): 8.0,
        ("02", "Mobile"): 32.0,
    }
    total = clean_facts(facts, "parent", "by sector", agg=True)
    assert "major_class" not in total.columns and total.count() == 2
    minor = clean_facts(facts, "parent", "industrial", agg=False)
    assert {(r.sector_path, r.amount) for r in minor.collect()} == {("Mobile - Aircraft", 32.0)}
    assert clean_facts(facts, "child", "residential", agg=False).count() == 2
    for bad in (lambda: clean_facts(facts, "town"), lambda: clean_facts(facts, "state", "maritime")):
        with pytest.raises(ValueError):
            bad()


def test_clean_prices(spark):
    day = dt.datetime(2021, 5, 1)
    rows = [
        (day, "All Residential", "county", "Ohio", "OH", "A County, OH", 100.0),
        (day, "All Residential", "county", "Ohio", "OH", "A County, OH", 123456.7),
        (day, "All Residential", "county", "Ohio", "OH", "B County, OH", None),
        (day, "All Residential", "county", "Columbia", "DC", "C County, DC", 5.0),
        (day, "Condo", "county", "Ohio", "OH", "A County, OH", 9.0),
        (day, "All Residential", "zip", "Ohio", "OH", "A County, OH", 9.0),
        (dt.datetime(2020, 5, 1), "All Residential", "county", "Ohio", "OH", "A County, OH", 9.0),
        (day, "All Residential", "county", None, "XX", "D County, XX", 7.0),
    ]
    df = spark.createDataFrame(
        rows, "period_begin timestamp_ntz, property_type string, region_type string, "
        "parent_name string, parent_code string, region_label string, price double",
    )
    for limit in (100, 0):
        state = rows_by(clean_prices(df, "STATE", task_rows=limit), "parent_name")
        assert {k[0]: (r.price, r.price_code) for k, r in state.items()} == {"Ohio": (61778.4, "OH")}
        county = rows_by(clean_prices(df, "COUNTY", task_rows=limit), "price_label")
        assert {k[0]: (r.price, r.parent_name) for k, r in county.items()} == {
            "A County, OH": (61778.4, "Ohio"), "D County, XX": (7.0, None),
        }
    with pytest.raises(ValueError):
        clean_prices(df, "zip")


def attributes(spark):
    rows = [
        (1001.0, "Autauga", "AL", 10.0, 50.0, 4.0, 2),
        (1003.0, "Baldwin", "AL", 30.0, 70.0, 2.0, None),
        (1005.0, "Barbour", "AL", None, 70.0, 2.0, 3),
        (72001.0, "Adjuntas", "PR", 5.0, 10.0, 9.0, 1),
        (2013.0, "Nowhere", None, 5.0, 20.0, 9.0, 1),
    ]
    return spark.createDataFrame(
        rows, "area_id double, area_name string, parent_code string, weight double, income double, "
        "rate double, stratum_code int",
    )


def test_clean_attributes(spark):
    child = rows_by(clean_attributes(attributes(spark), "COUNTY"), "attr_child_id")
    assert sorted(k[0] for k in child) == ["01001", "01003", "02013"]
    assert child["01003",].stratum_code is None and child["01003",].attr_parent_id == "01"
    parent = clean_attributes(attributes(spark), "STATE").collect()
    assert len(parent) == 1
    row = parent[0]
    assert (row.attr_code, row.attr_parent_id, row.attr_child_id) == ("AL", "01", "01001")
    assert (row.weight, row.income, row.rate) == (40.0, 65.0, 2.5)
    dropped = clean_attributes(
        attributes(spark), "STATE", drop_parent_totals=F.col("area_name") == "Autauga"
    ).first()
    assert dropped.weight == 30.0


def test_text_ids_are_padded_too(spark):
    df = attributes(spark).withColumn("area_id", F.col("area_id").cast("bigint").cast("string"))
    assert clean_attributes(df, "STATE").first().attr_child_id == "01001"


def test_merge_and_ratios(spark, facts):
    prices = spark.createDataFrame([("Baldwin County, AL", "Alabama", "AL", 200.0)],
                                   "price_label string, parent_name string, price_code string, price double")
    merged = merge_sources(
        clean_facts(facts, "COUNTY"), clean_attributes(attributes(spark), "COUNTY"), prices, "COUNTY"
    )
    row = with_ratios(merged).first()
    assert merged.count() == 1 and row.child_id == "01003"
    assert row.amount_per_person == pytest.approx(4 / 30 * 2000)
    assert row.income_ratio == pytest.approx(4 / 30 * 2000 / 70)
    assert row.price_ratio == pytest.approx(4 / 30 * 2000 / 200)
    assert "major_class" not in merged.columns
    by_class = merge_sources(
        clean_facts(facts, "COUNTY", "by sector", agg=False),
        clean_attributes(attributes(spark), "COUNTY"), prices, "COUNTY",
    )
    assert "major_class" in by_class.columns
    found = ratio_extremes(merged, ["child_id"]).collect()
    assert len(found) == 4 and {r.metric for r in found} == {"income_ratio", "price_ratio"}


def test_bucket_drift_presets(spark):
    rows = [("a", "Mobile", 10.0, 5.0, 47999.0), ("a", "Works", 10.0, 5.0, 47999.0),
            ("b", "Mobile", 30.0, 5.0, 105000.0), ("b", "Works", 10.0, 5.0, 105000.0),
            ("c", "Works", 10.0, 5.0, -3.0)]
    df = spark.createDataFrame(rows, "id string, major_class string, amount double, weight double, income double")
    got = bucket_drift(df).collect()
    assert [r.bucket for r in got] == ["<48k", "<48k", ">105k", ">105k"]
    assert set(presets.STRATUM_LABELS) == set(range(1, 10))


# ------------------------------------------------------------------ physical plans


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_any_operator(spark, folder):
    for name in ("ratio_extremes", "drift_by_code", "spearman_matrix", "histogram", "median_by_parent",
                 "describe_large_columns", "map_table"):
        plan = physical(QUERIES[name](spark, folder))
        assert not re.search("PythonUDF|ArrowEval|MapInArrow|MapInPandas", plan), name


def test_top_n_keeps_only_n_rows_per_task(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    plan = physical(top_n(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]))
    assert "TakeOrderedAndProject(limit=5" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan)


def test_facts_are_hashed_not_sorted_before_the_sum(spark, folder):
    plan = physical(t.cleaned_facts(spark, folder, "parent"))
    lowest = plan[plan.rindex("Aggregate"):]
    assert "HashAggregate(keys=[parent_id" in plan
    assert "SortAggregate" not in lowest


def test_category_filter_reaches_the_part_scan(spark, folder):
    plan = physical(t.cleaned_facts(spark, folder, "child", "residential"))
    part = plan[plan.index("Filter ((Contains(concat(p_type"):]
    assert part.index("FileScan parquet [p_partkey") < part.index("Join") if "Join" in part else True
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in plan


def test_rank_has_one_row_shuffle(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice")
    plan = physical(average_rank(orders, "o_totalprice", ["o_orderkey"], keep_nulls=False))
    main = plan[: plan.index("BroadcastExchange")]
    assert main.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in main


def test_drift_reads_the_data_once(spark, folder):
    plan = physical(QUERIES["drift_by_code"](spark, folder))
    assert plan.count("FileScan parquet [l_orderkey") == 1


def scans(plan: str) -> int:
    return plan.count("FileScan parquet")


def test_panels_read_a_frame_once(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    measures = ["l_quantity", "l_extendedprice", "l_discount"]
    panels = [(c, lineitem, c, 1.0, "l_orderkey") for c in measures]
    plan = physical(extremes_panel(panels, ["l_orderkey", "l_linenumber"]))
    assert scans(plan) == 1 and "WindowGroupLimit" in plan
    panels = [(c, lineitem, c, 1.0, 20) for c in measures]
    panel = histogram_panel(panels)
    panel.collect()
    # One scan for the extents of all columns, one for the bins; the extents are computed once
    final = physical(panel).split("== Initial Plan ==")[0]
    assert scans(final) == 2 and "ReusedExchange" in final
    plan = physical(map_tables(spark.read.parquet(f"{folder}/customer.parquet").selectExpr("c_name as n", "c_acctbal as income", "c_acctbal as price"), ["income", "price"], "n"))
    assert scans(plan) == 1
    merged = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], "child_id string, amount double, weight double, income double, price double")
    plan = physical(ratio_extremes(written(merged), ["child_id"]))
    assert scans(plan) == 1 and "WindowGroupLimit" in plan


def test_drift_flags_do_not_repeat_the_drift(spark, folder):
    plan = physical(QUERIES["near_zero_flag"](spark, folder))
    assert plan.count("FileScan parquet [l_orderkey") == 1 and "Subquery" not in plan


def test_nan_is_missing_in_whole_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (2.5,), (None,)], "x double")
    got = df.select(round_trunc_int("x").alias("z"), format_label(F.lit("n"), "x", "u").alias("t")).collect()
    assert [tuple(r) for r in got] == [(None, None), (2, "n: 2 u"), (None, None)]
