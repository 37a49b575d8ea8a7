"""NaN is missing in every operator that takes a measure; money sums do not depend on order."""

import random

from pyspark.sql import functions as F

import stratastats.operators as op
from stratastats.functions import amount_terms, weighted_avg

NAN = float("nan")


def frame(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", NAN, 1.0), ("b", 7.0, NAN), ("b", 5.0, 1.0), ("c", NAN, 3.0)],
        "k string, x double, w double",
    )


def test_sums_and_extremes_skip_nan(spark):
    df = frame(spark)
    assert {r.k: r.x for r in op.group_sum(df, ["k"], "x").collect()} == {"a": 1.0, "b": 12.0, "c": 0.0}
    assert [r.x for r in op.top_n(df, "x", ["k"], 2).collect()] == [7.0, 5.0]
    assert [r.x for r in op.bottom_n(df, "x", ["k"], 4).collect()][3] is None


def test_means_and_compositions_skip_nan(spark):
    df = frame(spark)
    assert df.agg(weighted_avg("x", "w").alias("m")).first().m == (1.0 * 2 + 5.0 * 1) / 3
    shares = {r.k: r.share for r in op.composition(df, "k", amount_terms("x", "w")).collect()}
    assert shares["a"] == 100 * 0.5 / 5.5 and shares["b"] == 100 * 5 / 5.5 and shares["c"] is None


def test_normalise_and_map_skip_nan(spark):
    df = frame(spark)
    got = [r.y for r in op.minmax_normalise(df, "x", "y").collect()]
    assert got == [0.0, None, 1.0, 4 / 6, None]
    table = op.map_table(df.withColumnRenamed("x", "income"), "income", "k").collect()
    assert [r.z for r in table] == [1, None, 7, 5, None]


def test_exact_sums_do_not_depend_on_order(spark):
    values = [1e13 + 0.01, -1e13, 0.02, 0.07] * 200
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([("a", v) for v in values], "k string, x double").repartition(7)
        found.add(op.group_sum(df, ["k"], "x", exact=2).first().x)
    assert len(found) == 1 and abs(found.pop() - 20.0) < 0.6  # a double near 1e13 has steps of 0.002


def test_carried(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit("t").alias("v"))
    got = op.carried(df, ["k"], {"v": "first"})
    assert {(r.k, r.first) for r in got.collect()} == {(i, "t") for i in range(7)}


def test_flags_on_own_axes(spark):
    drift = spark.createDataFrame(
        [("a", "x", 10.0), ("a", "y", 0.15), ("b", "x", 1.0), ("b", "y", 0.15)], "s string, c string, drift double"
    )
    own = {(r.s, r.c): r.near_zero for r in op.with_drift_flags(drift, by=["s"]).collect()}
    assert own == {("a", "x"): False, ("a", "y"): True, ("b", "x"): False, ("b", "y"): False}
    shared = {(r.s, r.c): r.near_zero for r in op.with_drift_flags(drift).collect()}
    assert shared[("b", "y")] is True
