"""Operators against pandas, numpy or brute force, with skewed and null-ridden inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stratastats import functions as fn, operators as op
from stratastats.operators.splits import find_ranges, with_range


def skewed(n=4000, seed=1):
    """A third of the rows share one value, a third one group; some values are missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).round(2)
    x[: n // 3] = 0.5
    g = rng.integers(0, 6, n)
    g[n // 2 :][: n // 3] = 1
    x[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x})


@pytest.mark.parametrize("task_rows", [10**6, 100, 2])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank_matches_pandas(spark, task_rows, by):
    pdf = skewed()
    df = spark.createDataFrame(pdf).repartition(5)
    got = op.average_rank(df, "x", ["id"], by, task_rows=task_rows).toPandas().set_index("id").sort_index()
    want = (pdf.groupby("g").x if by else pdf.x).rank()
    np.testing.assert_array_equal(got.avg_rank.to_numpy(), want.to_numpy())
    assert len(got) == len(pdf)


@pytest.mark.parametrize("task_rows", [10**6, 30, 2])
def test_ranges_keep_the_order_and_part_frequent_values(spark, task_rows):
    df = spark.createDataFrame(skewed()).where(~F.isnan("x")).select(fn.nan_as_null("x").alias("x"))
    rows = df.count()
    binned = with_range(df, "x", find_ranges(df, "x", rows, task_rows), "r")
    assert binned.columns == ["x", "r"] and binned.count() == rows
    found = sorted((r.r, r.least, r.most, r.n) for r in binned.groupBy("r").agg(
        F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("n")).collect())
    assert all(a[2] < b[1] for a, b in zip(found, found[1:]))
    assert max((n for _, least, most, n in found if least < most), default=0) <= max(task_rows, 60)
    assert any(least == most == 0.5 and n > rows / 4 for _, least, most, n in found)


def test_number_of_ranges_follows_the_rows(spark):
    """No fixed number of ranges: 20,000 different values, some four of them to a task."""
    df = spark.range(20_000).select((F.col("id") * 0.5).alias("x"))
    ranges = find_ranges(df, "x", 20_000, 4)
    assert ranges.size >= 20
    counts = with_range(df, "x", ranges, "r").groupBy("r").count()
    assert counts.count() > 4096 and counts.agg(F.max("count")).first()[0] <= 16


def test_a_value_of_one_percent_is_spread_when_tasks_are_small(spark):
    pdf = pd.DataFrame({"id": np.arange(8000), "x": np.arange(8000.0)})
    pdf.loc[pdf.id % 100 == 7, "x"] = 17.25
    df = spark.createDataFrame(pdf)
    for task_rows, spread in ((10**6, False), (20, True)):
        ranked = op.average_rank(df, "x", ["id"], task_rows=task_rows)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert ("xxhash64(id" in plan) == spread
        got = ranked.toPandas().set_index("id").sort_index()
        np.testing.assert_array_equal(got.avg_rank.to_numpy(), pdf.x.rank().to_numpy())


def test_cut_points_from_a_sample_give_the_same_ranks(spark, monkeypatch):
    monkeypatch.setattr("stratastats.operators.splits.SAMPLE_ROWS", 200)
    pdf = skewed(seed=4)
    df = spark.createDataFrame(pdf)
    got = op.average_rank(df, "x", ["id"], ["g"]).toPandas().set_index("id").sort_index()
    np.testing.assert_array_equal(got.avg_rank.to_numpy(), pdf.groupby("g").x.rank().to_numpy())
    medians = {r.g: r.m for r in op.grouped_median(df, ["g"], "x", "m", 0).collect()}
    assert medians == pytest.approx(pdf.groupby("g").x.median().to_dict())


def test_many_groups_take_the_unhinted_joins(spark, monkeypatch):
    monkeypatch.setattr("stratastats.operators.rank.BROADCAST_ROWS", 0)
    monkeypatch.setattr("stratastats.operators.quantiles.BROADCAST_ROWS", 0)
    pdf = skewed(seed=6)
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = op.average_rank(df, "x", ["id"], ["g"], task_rows=100)
        assert "BroadcastHashJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
        got = ranked.toPandas().set_index("id").sort_index()
        np.testing.assert_array_equal(got.avg_rank.to_numpy(), pdf.groupby("g").x.rank().to_numpy())
        medians = {r.g: r.m for r in op.grouped_median(df, ["g"], "x", "m", 500).collect()}
        assert medians == pytest.approx(pdf.groupby("g").x.median().to_dict())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([-2.5, -0.0, 0.0, 1.0, 1.0, 7.25, None]), min_size=1, max_size=30))
def test_average_rank_property(spark, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    got = {r.id: r.avg_rank for r in op.average_rank(df, "x", ["id"], task_rows=4).collect()}
    want = pd.Series([np.nan if x is None else x for x in xs]).rank()
    assert [got[i] for i in range(len(xs))] == [None if math.isnan(w) else w for w in want]


def test_average_rank_drops_null_groups(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "a", 1.0)], "id int, g string, x double")
    assert [r.id for r in op.average_rank(df, "x", ["id"], ["g"]).collect()] == [2]


@pytest.mark.parametrize("limit", [10**9, 300, 0])
def test_grouped_percentiles_match_numpy(spark, limit):
    pdf = skewed(seed=2)
    pdf.loc[pdf.g == 5, "x"] = np.nan
    pdf.loc[pdf.g == 4, "x"] = 3.0
    df = spark.createDataFrame(pdf).withColumn("name", F.concat(F.lit("n"), "g"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = op.grouped_percentiles(df, ["g"], "x", probs, limit, {"label": "name"}).collect()
    seen = {r.g: r for r in got}
    for g, part in pdf.groupby("g").x:
        part = part.dropna()
        if part.empty:
            assert g not in seen or seen[g].percentiles is None
            continue
        assert seen[g].n == len(part) and seen[g].label == f"n{g}"
        np.testing.assert_allclose(seen[g].percentiles, np.quantile(part, probs), rtol=0, atol=1e-12)


def test_percentiles_do_not_depend_on_the_cuts(spark):
    """Equal to the last bit whatever a task takes, and to the formula itself."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.integers(0, 40, 6000), "x": rng.normal(size=6000) * 10.0 ** rng.integers(-8, 9, 6000)})
    pdf.loc[pdf.g < 3, "g"] = 0
    pdf.loc[rng.random(6000) < 0.3, "x"] = 0.1
    df = spark.createDataFrame(pdf)
    probs = [0.1, 0.3, 0.5, 0.9, 0.99]

    def formula(x, p):
        x = np.sort(x)
        at = (len(x) - 1) * p
        low, high, share = x[math.floor(at)], x[math.ceil(at)], at - math.floor(at)
        return low if low == high else low * (1 - share) + high * share

    want = {g: [formula(x.to_numpy(), p) for p in probs] for g, x in pdf.groupby("g").x}
    for task_rows in (10**9, 150, 20, 1):
        got = op.grouped_percentiles(df.repartition(3), ["g"], "x", probs, task_rows).collect()
        assert {r.g: list(r.percentiles) for r in got} == want


def test_only_cuts_that_hold_a_wanted_place_are_ordered(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
    picked = op.grouped_percentiles(df, ["g"], "x", [0.5], 500)
    picked.collect()
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    sorted_rows = op.quantiles._selected(
        df.select("g", F.col("x").alias("_v")), df.groupBy("g").agg(F.count("*").alias("n")), ["g"], [0.5], 500, 2
    )
    assert sorted_rows.count() < 2_000


def test_grouped_median_small_cases(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 4.0), ("b", None), ("c", 5.0), (None, 9.0)], "g string, x double"
    )
    for limit in (10, 1):
        got = {r.g: r.m for r in op.grouped_median(df, ["g"], "x", "m", limit).collect()}
        assert got["a"] == 2.5 and got["c"] == 5.0 and got.get("b") is None and None not in got


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id int, g string, x double")
    assert op.average_rank(empty, "x", ["id"]).count() == 0
    assert op.grouped_median(empty, ["g"], "x", "m").count() == 0
    assert op.grouped_median(empty, ["g"], "x", "m", 0).count() == 0
    assert op.spearman(empty, ["x"], ["id"]).collect()[0].rho is None
    hist = op.histogram(empty, "x", 3).collect()
    assert [r["count"] for r in hist] == [0, 0, 0]


def correlation_frame(n=600, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "s": rng.integers(1, 5, n).astype(float),
            "a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n),
            "c": rng.normal(size=n), "k": 4.0,
        }
    )
    pdf["c"] = pdf.c + pdf.b
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    pdf.loc[:3, "s"] = np.nan
    return pdf


def test_spearman_is_pairwise_complete(spark):
    pdf = correlation_frame()
    columns = ["a", "b", "c", "k"]
    got = op.spearman(spark.createDataFrame(pdf), columns, ["id"]).collect()
    want = pdf[columns].corr(method="spearman")
    assert len(got) == 16
    for r in got:
        w = want.loc[r.a, r.b]
        assert r.rho is None if math.isnan(w) else abs(r.rho - w) < 1e-12, (r.a, r.b)


def test_spearman_per_stratum(spark):
    pdf = correlation_frame()
    pdf.loc[pdf.index[-1], "s"] = 9.0
    pairs = [("a", "c"), ("b", "c")]
    got = op.spearman(spark.createDataFrame(pdf), ["a", "b", "c"], ["id"], ["s"], pairs).collect()
    assert {r.s for r in got} == {1.0, 2.0, 3.0, 4.0, 9.0}
    for r in got:
        want = pdf[pdf.s == r.s][[r.a, r.b]].corr(method="spearman").iloc[0, 1]
        assert r.rho is None if math.isnan(want) else abs(r.rho - want) < 1e-12


def test_spearman_properties(spark):
    pdf = correlation_frame()
    df = spark.createDataFrame(pdf)
    rho = {(r.a, r.b): r.rho for r in op.spearman(df, ["a", "b", "c"], ["id"]).collect()}
    monotone = df.withColumn("b", F.exp("b")).withColumn("c", F.col("c") * 3 + 1)
    again = {(r.a, r.b): r.rho for r in op.spearman(monotone, ["a", "b", "c"], ["id"]).collect()}
    for x, y in itertools.product("abc", "abc"):
        assert rho[x, y] == rho[y, x] and -1 <= rho[x, y] <= 1
        assert rho[x, y] == pytest.approx(again[x, y], abs=1e-12)
    assert rho["a", "a"] == 1.0


def test_pivot_matrix(spark):
    df = spark.createDataFrame(correlation_frame())
    square = op.pivot_matrix(op.spearman(df, ["b", "c"], ["id"]), ["b", "c"]).collect()
    table = {r.a: r for r in square}
    assert table["b"]["c"] == table["c"]["b"] and table["c"]["c"] == 1.0


@pytest.mark.parametrize(
    "xs, bins",
    [([0.0, 1.0, 2.0, 3.0, 10.0], 5), ([7.0, 7.0, 7.0], 4), ([0.1 * i for i in range(31)], 30),
     ([-5.0, 5.0], 10), ([0.3, 0.6, 0.9, 1.2], 3)],
)
def test_histogram_matches_numpy(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    counts, edges = np.histogram(xs, bins)
    got = op.histogram(df, "x", bins, density=True).orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r.lo for r in got], edges[:-1], atol=1e-12)
    density, _ = np.histogram(xs, bins, density=True)
    np.testing.assert_allclose([r.density for r in got], density)
    assert sum(r["count"] for r in got) == len(xs)


def test_normal_fit_and_report(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    fit = op.normal_fit(df, "x").first()
    z = (x - x.mean()) / x.std()
    assert fit.mu == pytest.approx(x.mean()) and fit.sigma == pytest.approx(x.std())
    assert fit.kurtosis == pytest.approx((z**4).mean() - 3)
    curve = op.normal_curve(df, "x").orderBy("point").collect()
    pad = 0.05 * (x.max() - x.min())
    grid = np.linspace(x.min() - pad, x.max() + pad, 100)
    np.testing.assert_allclose([r.x for r in curve], grid)
    want = np.exp(-(((grid - x.mean()) / x.std()) ** 2) / 2) / (x.std() * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r.density for r in curve], want)
    parts = {r.part: r["count"] for r in op.normality_report(df, "x").groupBy("part").count().collect()}
    assert parts == {"histogram": 50, "curve": 100, "mu": 1, "sigma": 1, "kurtosis": 1}


def test_constant_column_moments(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    fit = op.normal_fit(df, "x").first()
    assert fit.sigma == 0.0 and fit.kurtosis is None
    assert {r.density for r in op.normal_curve(df, "x", 5).collect()} == {None}
    assert {r.y for r in op.minmax_normalise(df, "x", "y").collect()} == {None}


def test_extremes_ties_nulls_and_overlap(spark):
    df = spark.createDataFrame(
        [(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 2.0), (6, 5.0), (7, 0.0)], "k int, v double"
    )
    got = op.extremes(df, "v", ["k"]).collect()
    top = [r.k for r in sorted(got, key=lambda r: r.rank_no) if r.side == "top"]
    bottom = [r.k for r in sorted(got, key=lambda r: r.rank_no) if r.side == "bottom"]
    assert top == [1, 2, 6, 5, 3] and bottom == [7, 3, 5, 1, 2]
    pdf = df.toPandas()
    assert top == pdf.nlargest(5, "v").k.tolist() and bottom == pdf.nsmallest(5, "v").k.tolist()


def test_group_sum_rules(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "x"), ("a", 2.0, None), ("b", None, "y"), (None, 9.0, "z")],
        "g string, v double, name string",
    )
    got = {r.g: (r.v, r.name) for r in op.group_sum(df, ["g"], "v", ["name"]).collect()}
    assert got == {"a": (3.0, "x"), "b": (0.0, "y")}


def test_roll_up_keeps_totals(spark):
    df = spark.createDataFrame(
        [("p", "Solvent - X", 1.0), ("p", "Works - Y", 2.0), ("q", "Gas", 4.0), ("q", "Gas - Z", 8.0)],
        "place string, path string, v double",
    )
    got = op.roll_up(df, ["place"], "path", "v", {"Solvent": "Works"})
    assert {(r.place, r.major_class): r.v for r in got.collect()} == {
        ("p", "Works"): 3.0, ("q", "Gas"): 12.0,
    }
    pairs = {tuple(r) for r in op.category_dictionary(df, "path", {"Solvent": "Works"}).collect()}
    assert ("Works", "Solvent - X") in pairs and len(pairs) == 4


def test_inner_join_and_coverage(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("c", 4)], "k string, v int")
    right = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("d", 4)], "j string, w int")
    assert op.inner_join(left, right, "k", "j", ["w"]).count() == 4
    with pytest.raises(ValueError):
        op.inner_join(left, right.withColumnRenamed("w", "V"), "k", "j", ["V"])
    got = {r.side: tuple(r)[1:] for r in op.merge_coverage(left, right, "k", "j").collect()}
    assert got == {"left": (2, 1, 4, 2), "right": (2, 1, 4, 2)}


def composition_frame(spark):
    rows = [
        ("u", "Fires", 50.0, 5.0), ("u", "Mobile", 10.0, 5.0), ("u", "Works", 30.0, 10.0),
        ("r", "Mobile", 40.0, 10.0), ("r", "Mobile", 10.0, 5.0), (None, "Works", 5.0, 1.0),
    ]
    return spark.createDataFrame(rows, "s string, cls string, amount double, w double")


def shares(rows):
    means = {}
    for cls in {r[0] for r in rows} - {"Fires"}:
        mine = [r for r in rows if r[0] == cls]
        means[cls] = sum(a for _, a, _ in mine) / sum(w for _, _, w in mine)
    total = sum(means.values())
    return {c: 100 * m / total for c, m in means.items()}


def test_composition_and_drift_by_class_name(spark):
    df = composition_frame(spark)
    terms = fn.amount_terms("amount", "w")
    data = [tuple(r) for r in df.collect()]
    base = shares([r[1:] for r in data])
    got = {r.cls: r.share for r in op.composition(df, "cls", terms, excluded="Fires").collect()}
    assert got == pytest.approx(base) and sum(got.values()) == pytest.approx(100)
    by = op.composition(df, "cls", terms, ["s"], "Fires").groupBy("s").agg(F.sum("share").alias("t"))
    assert {r.s: r.t for r in by.collect()} == pytest.approx({"u": 100.0, "r": 100.0})
    drift = {(r.s, r.cls): r.drift for r in op.nominal_drift(df, "s", "cls", terms, "Fires").collect()}
    want = {}
    for s in ("u", "r"):
        for cls, share in shares([r[1:] for r in data if r[0] == s]).items():
            want[s, cls] = base[cls] - share
    assert drift == pytest.approx(want)
    flipped = op.nominal_drift(df, "s", "cls", terms, "Fires", sign=-1).collect()
    assert {(r.s, r.cls): -r.drift for r in flipped} == pytest.approx(want)


def test_rate_terms_equal_amount_terms(spark):
    df = composition_frame(spark).withColumn("rate", fn.rate_per_weight("amount", "w"))
    a = op.composition(df, "cls", fn.amount_terms("amount", "w"), excluded="Fires").collect()
    b = op.composition(df, "cls", fn.weighted_terms("rate", "w"), excluded="Fires").collect()
    assert {r.cls: r.share for r in a} == pytest.approx({r.cls: r.share for r in b})


def test_drift_of_a_single_stratum_is_zero(spark):
    df = composition_frame(spark).withColumn("s", F.lit("all"))
    drift = op.nominal_drift(df, "s", "cls", fn.amount_terms("amount", "w"), "Fires").collect()
    assert [r.drift for r in drift] == pytest.approx([0.0, 0.0])


def test_drift_without_the_excluded_class(spark):
    df = composition_frame(spark)
    drift = op.nominal_drift(df, "s", "cls", fn.amount_terms("amount", "w"), "Absent")
    assert drift.where("cls = 'Fires'").count() == 1


def test_drift_domain_and_flags(spark):
    df = spark.createDataFrame([("a", "m", -4.0), ("a", "n", 0.05), ("b", "m", 2.0)],
                               "s string, cls string, drift double")
    assert op.drift_domain(df).first().domain == pytest.approx(4.8)
    own = {r.s: r.domain for r in op.drift_domain(df, ["s"]).collect()}
    assert own == pytest.approx({"a": 4.8, "b": 2.4})
    flags = {r.drift: (r.flag, r.near_zero) for r in op.with_drift_flags(df).collect()}
    assert flags == {-4.0: ("not_above", False), 0.05: ("above", True), 2.0: ("above", False)}


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None), (2, 1.0, "a"), (3, None, "b")], "id int, x double, s string"
    )
    assert {r.column: r.nulls for r in op.null_profile(df).collect()} == {"id": 0, "x": 2, "s": 1}
    got = {r.column: (r.dtype, r.non_null, r.row_count) for r in op.schema_profile(df).collect()}
    assert got == {"id": ("int", 3, 3), "x": ("double", 1, 3), "s": ("string", 2, 3)}


def test_describe_matches_pandas(spark):
    pdf = skewed(seed=8)
    want = pdf[["x", "g"]].describe()
    for limit in (10**9, 0):
        got = op.describe_numeric(spark.createDataFrame(pdf), ["x", "g"], limit).collect()
        for r in got:
            mine = [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
            np.testing.assert_allclose(mine, want[r.column].to_numpy(), rtol=1e-12)


def test_sample_and_head(spark):
    df = spark.range(100)
    a, b = (sorted(r.id for r in op.sample_n(df, 7, ["id"], seed).collect()) for seed in (1, 2))
    again = sorted(r.id for r in op.sample_n(df.repartition(9), 7, ["id"], 1).collect())
    assert a == again and a != b and len(a) == 7
    assert [r.id for r in op.head_n(df.repartition(3), 3, "id").collect()] == [0, 1, 2]


def test_unpivot_flatten_union(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, None, 5.0)], "id int, a double, b double")
    got = {tuple(r) for r in op.unpivot_drop_null(wide, ["id"], ["a", "b"]).collect()}
    assert got == {(1, "a", 2.0), (2, "b", 5.0)}
    nested = spark.createDataFrame([("s", {"m": 1.0, "n": 2.0})], "k string, d map<string,double>")
    assert {tuple(r) for r in op.flatten_map(nested, "k", "d").collect()} == {
        ("s", "m", 1.0), ("s", "n", 2.0),
    }
    both = op.union_all([spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit("y"))])
    assert {tuple(r) for r in both.collect()} == {(0, None), (0, "y")}


def test_map_table(spark):
    df = spark.createDataFrame([("TX", 4001.0, 50.0), ("OH", 1000.0, 70.5)],
                               "code string, amount double, income double")
    got = {r.region: (r.value, r.z, r.text, r.title) for r in op.map_table(df, "amount", "code").collect()}
    assert got["TX"] == (2.0005, 2, "TX: 2 TPY", "Emissions TPY")
    scaled = {r.region: r.value for r in op.map_table(df, "income", "code", normalise=True).collect()}
    assert scaled == {"TX": 0.0, "OH": 1.0}
    with pytest.raises(ValueError):
        op.map_table(df, "code", "code")


def test_exact_sums_do_not_depend_on_the_order(spark):
    """Equal to the last bit over 20 ways to deal the rows, and to the true sum."""
    rng = np.random.default_rng(21)
    n = 3000
    x = rng.normal(size=n) * 10.0 ** rng.integers(-8, 14, n)
    g = rng.integers(0, 4, n)
    x[:8], g[:8] = [1e300, -1e300, 5e-324, 1e-310, 2.0**24, 2.0**-24, 0.1, -0.0], 9
    x[8:10], g[8:10] = [np.inf, 1.0], 10
    x[10:12], g[10:12] = [np.inf, -np.inf], 11
    x[12:13], g[12:13] = [np.nan], 12
    pdf = pd.DataFrame({"g": g, "c": g * 2, "x": x, "w": np.abs(np.where(np.isfinite(x), x, 1.0)) % 7 + 0.1})
    df = spark.createDataFrame(pdf)
    seen = set()
    for i in range(20):
        dealt = df.repartition(1 + i % 7, F.rand(i))
        sums = {r.g: r.x for r in op.exact_sums(dealt, ["g"], {"x": F.col("x")}).collect()}
        seen.add(tuple(sorted((k, str(v)) for k, v in sums.items())))
        if i % 5 == 0:
            means = op.weighted_means(dealt, [], {"m": fn.weighted_terms("x", "w")}).first().m
            assert str(means) == "nan"  # infinities of both signs
            kept = dealt.where("g < 5")
            mean = op.weighted_means(kept, [], {"m": fn.weighted_terms("x", "w")}).first().m
            part = pdf[pdf.g < 5]
            assert mean == math.fsum(part.x * part.w) / math.fsum(part.w)
            grouped = op.group_sum(kept, ["g"], "x", ["c"], exact=True).collect()
            assert {r.g: (r.x, r.c) for r in grouped} == {k: (math.fsum(v), 2 * k) for k, v in part.groupby("g").x}
    assert len(seen) == 1
    for k in (0, 1, 2, 3, 9):
        assert sums[k] == math.fsum(x[g == k])
    assert sums[10] == math.inf and math.isnan(sums[11]) and sums[12] is None
    assert op.exact_sums(df.limit(0), [], {"x": F.col("x")}).collect()[0].x is None
    assert op.group_sum(df.where("g = 12"), ["g"], "x", exact=True).first().x == 0.0


def test_drift_does_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": rng.integers(0, 3, 900), "cls": rng.choice(list("abc"), 900),
                        "amount": rng.normal(5, 1, 900) * 10.0 ** rng.integers(-6, 9, 900), "w": rng.random(900)})
    df = spark.createDataFrame(pdf)
    seen = {
        tuple(sorted((r.s, r.cls, r.drift) for r in op.nominal_drift(
            df.repartition(1 + i, F.rand(i)), "s", "cls", fn.amount_terms("amount", "w"), "c").collect()))
        for i in range(6)
    }
    assert len(seen) == 1


def test_key_report(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, None), ("c", 1, "x"), (None, 1, "x"), (None, 2, "y"), ("d", 9, "p"), ("d", 9, "q"), ("d", 10, "q")],
        "k string, m int, t string",
    )
    got = {(r.k, r.attribute): (r.row_count, r.least, r.most) for r in op.key_report(df, ["k"], ["m", "t"]).collect()}
    assert got == {
        ("a", None): (2, None, None), ("b", None): (2, None, None), ("b", "m"): (2, "1", "2"),
        ("d", None): (3, None, None), ("d", "m"): (3, "10", "9"), ("d", "t"): (3, "p", "q"),
    }
    assert not op.key_report(df.limit(0), ["k"], ["m"]).collect()


def test_total_rows(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.7), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0), ("c", 0.0),
            ("d", 5.0), ("d", None), ("d", 2.0), ("d", 3.0), (None, 1.0), ("e", 1.0), ("e", 2.0), ("e", 4.0)]
    df = spark.createDataFrame(rows, "p string, x double")
    for parts in (1, 5):
        got = sorted(tuple(r) for r in op.total_rows(df.repartition(parts), ["p"], "x").collect())
        assert got == [("a", 1.0), ("d", 5.0)]
