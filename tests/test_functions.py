"""Null rules, identifiers, rounding, buckets: one small fixture per trap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratastats import functions as fn


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([(None,), ("a",), ("z",)], "k string")


def test_not_equal_and_not_in_keep_null(letters):
    assert values(letters.where(fn.not_equal("k", "a")), "k") == [None, "z"]
    assert values(letters.where(fn.not_in("k", ["a"])), "k") == [None, "z"]
    assert values(letters.where(fn.in_list("k", ["a"])), "k") == ["a"]


def test_contains_any_is_literal_and_case_sensitive(spark):
    df = spark.createDataFrame([("a.c",), ("abc",), ("A.C",), (None,)], "s string")
    assert values(df.where(fn.contains_any("s", ["."])), "s") == ["a.c", "A.C"]
    assert values(df.where(fn.contains_any("s", ["a.", "bc"])), "s") == ["a.c", "abc"]
    assert df.where(fn.contains_any("s", [])).count() == 0


def test_within_year_is_half_open(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 12, 31, 23, 59),), (dt.datetime(2021, 1, 1),),
         (dt.datetime(2021, 12, 31, 23, 59, 59),), (dt.datetime(2022, 1, 1),), (None,)],
        "t timestamp_ntz",
    )
    assert df.where(fn.within_year("t", 2021)).count() == 2


def test_year_filter_reaches_the_scan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    plan = orders.where(fn.within_year("o_orderdate", 1997))._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert values(df, fn.nan_as_null("x")) == [None, None, 1.0]


def test_zero_pad_and_prefix(spark):
    df = spark.createDataFrame([("1001",), ("01001",), ("123456",), (None,)], "id string")
    padded = fn.zero_pad("id", 5)
    assert values(df, padded) == ["01001", "01001", "123456", None]
    assert values(df, fn.id_prefix(padded)) == ["01", "01", "12", None]


def test_cast_string_of_a_float_id(spark):
    df = spark.createDataFrame([(1001.0,), (None,)], "id double")
    assert values(df, fn.zero_pad(fn.cast_string("id", numeric=True), 5)) == ["01001", None]


def test_concat_ids_null_part(spark):
    df = spark.createDataFrame([("01", "001"), (None, "001")], "a string, b string")
    assert values(df, fn.concat_ids("a", "b")) == ["01001", None]


def test_first_token_and_mapping(spark):
    df = spark.createDataFrame(
        [("Solvent - X",), ("Gas Stations",), ("Mobile - Light Duty",), (None,)], "s string"
    )
    major = fn.map_or_self(fn.first_token("s"), {"Solvent": "Works", "Gas Stations": "Trade"})
    assert values(df, major) == ["Works", "Trade", "Mobile", None]
    assert values(df, fn.map_or_self("s", {}))[1] == "Gas Stations"


def test_parse_dates(spark):
    df = spark.createDataFrame([("2021-03-04",), (None,)], "d string")
    assert values(fn.parse_dates(df, ["d"]), "d") == [dt.datetime(2021, 3, 4), None]
    bad = spark.createDataFrame([("soon",)], "d string")
    assert values(fn.parse_dates(bad, ["d"], strict=False), "d") == [None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP"):
        fn.parse_dates(bad, ["d"]).collect()


@pytest.mark.parametrize(
    "x, want",
    [(123456.7, 123457.0), (99999.55, 99999.6), (1234567.0, 1234570.0), (250000.5, 250000.0),
     (12.3456789, 12.3457), (0.0, 0.0), (-123456.7, -123457.0), (1234565.0, 1234560.0),
     (1e-7, 1e-7), (987654321.0, 987654000.0)],
)
def test_round_significant(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert values(df, fn.round_significant("x")) == [want]


def test_round_significant_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert values(df, fn.round_significant("x")) == [None]


def test_rates_and_ratios_divide_by_zero_to_null(spark):
    df = spark.createDataFrame([(10.0, 4), (10.0, 0), (None, 4)], "e double, w int")
    assert values(df, fn.rate_per_weight("e", "w")) == [5000.0, None, None]
    assert values(df, fn.ratio("e", F.col("w").cast("double"))) == [2.5, None, None]


def test_format_label_is_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.4,), (1e6,), (None,)], "v double")
    got = values(df, fn.format_label(F.lit("TX"), "v", "(lbs)"))
    assert got == [f"TX: {v:.0f} (lbs)" for v in (2.5, 3.5, -0.4, 1e6)] + [None]


def test_scientific_label_matches_python(spark):
    xs = [12.5, 13.5, 0.125, 0.375, 1.25, 1.0, 9.96, 12345.0, 1250.0, 1350.0, 3.2e-7, 0.00125,
          -12.5, -0.0625]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double")
    got = values(df, fn.scientific_label("v"))
    assert got == [f"{x:.1e}" for x in xs] + [None]


def test_round_trunc_int(spark):
    df = spark.createDataFrame([(1.9996,), (1.9994,), (-1.5,), (None,)], "v double")
    assert values(df, fn.round_trunc_int("v")) == [2, 1, -1, None]


def test_buckets_are_left_closed(spark):
    xs = [-1.0, 0.0, 47999.0, 48000.0, 104999.0, 105000.0, 1e9, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    edges = [0, 48000, 57000, 71000, 105000]
    assert values(df, fn.bucket_index("x", edges)) == [None, 0, 0, 1, 3, 4, 4, None, None]
    labels = ["a", "b", "c", "d", "e"]
    assert values(df, fn.bucket_label("x", edges, labels)) == [
        None, "a", "a", "b", "d", "e", "e", None, None,
    ]
    assert edges == [0, 48000, 57000, 71000, 105000]
    with pytest.raises(ValueError):
        fn.bucket_index("x", [1, 1])
    with pytest.raises(ValueError):
        fn.bucket_label("x", edges, ["a"])


def test_decode_and_label_order(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "code int")
    assert values(df, fn.decode("code", {1: "city"})) == ["city", None, None]
    names = spark.createDataFrame([("b",), ("x",)], "s string")
    assert values(names, fn.label_order("s", ["a", "b"])) == [1, None]


def test_weighted_average(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("zero", 5.0, 0.0), ("skip", None, 7.0),
         ("skip", 2.0, 1.0), ("even", 1.0, 2.0), ("even", 2.0, 2.0)],
        "g string, x double, w double",
    )
    got = dict(df.groupBy("g").agg(fn.weighted_avg("x", "w")).collect())
    assert got == {"a": 2.5, "zero": None, "skip": 2.0, "even": 1.5}


def test_flags(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-0.1,)], "v double")
    assert values(df, fn.sign_flag("v")) == ["above", "not_above", "not_above"]
    assert values(df, fn.near_zero_flag("v", F.lit(10.0))) == [False, True, True]
