"""The whole analysis from files in the published layout, against plain pandas."""

import json

import numpy as np
import pandas as pd
import pytest

from stratastats.plans import Study, presets
from stratastats.sources import Sources

SECTORS = ["Mobile - On-Road Light Duty", "Mobile - Aircraft", "Fuel Comb - Residential - Wood",
           "Solvent - Degreasing", "Gas Stations", "Fires - Wildfires", "Fuel Comb - Electric Generation"]
MAPPING = {"Solvent": "Works", "Gas Stations": "Trade"}
CODES = {"01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "72": "PR"}


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(11)
    facts, attrs, prices = [], [], []
    for state, code in CODES.items():
        for c in range(1, 12):
            county, name = f"{c:03d}", f"Place {state}-{c}"
            for s in SECTORS:
                if rng.random() < 0.9:
                    facts.append({"STATE FIPS": state, "COUNTY FIPS": county, "STATE": code,
                                  "COUNTY": name, "POLLUTANT": "CO", "SECTOR": s,
                                  "EMISSIONS": round(float(rng.gamma(2, 50)), 2)})
            attrs.append({"FIPS_Code": int(state + county), "State": code,
                          "Area_Name": f"{name}, {code}", "Median_Household_Income_2020": 1,
                          "Rural_Urban_Continuum_Code_2013": rng.integers(1, 4) if c != 5 else None,
                          "Civilian_labor_force_2021": int(rng.integers(100, 9000)),
                          "Unemployment_rate_2021": round(float(rng.uniform(2, 9)), 1),
                          "Median_Household_Income_2021": int(rng.integers(30000, 130000)) if c != 7 else None})
            for month in (1, 6, 12):
                for year in (2020, 2021):
                    for kind in ("All Residential", "Condo"):
                        if c != 9:
                            prices.append({"period_begin": f"{year}-{month:02d}-01",
                                           "period_end": f"{year}-{month:02d}-28", "period_duration": 30,
                                           "region_type": "county", "region": f"{name} County, {code}",
                                           "state": f"State {code}", "state_code": code,
                                           "property_type": kind,
                                           "median_sale_price": round(float(rng.uniform(9e4, 9e5)), 1)
                                           if rng.random() < 0.9 else None})
    return pd.DataFrame(facts), pd.DataFrame(attrs), pd.DataFrame(prices)


@pytest.fixture(scope="module")
def study(spark, raw, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    facts, attrs, prices = raw
    (folder / "f.json").write_text(json.dumps(facts.to_dict("records")))
    (folder / "a.csv").write_text("Title\n\nNote\nSource\n" + attrs.to_csv(index=False))
    prices.to_csv(folder / "p.tsv", sep="\t", index=False)
    sources = Sources.load(spark, *(str(folder / n) for n in ("f.json", "a.csv", "p.tsv")))
    return Study(sources, MAPPING)


@pytest.fixture(scope="module")
def want(raw):
    """Child frame of the residential contributor, in pandas."""
    facts, attrs, prices = (f.copy() for f in raw)
    facts["id"] = facts["STATE FIPS"] + facts["COUNTY FIPS"]
    home = facts[facts.SECTOR.str.contains("Residential|Light Duty") & (facts.STATE != "PR")]
    home = home.groupby("id").agg(amount=("EMISSIONS", "sum"), code=("STATE", "first"),
                                  name=("COUNTY", "first")).reset_index()
    attrs = attrs.dropna(subset=["Median_Household_Income_2021"])
    attrs["id"] = attrs.FIPS_Code.astype(str).str.zfill(5)
    p = prices[prices.period_begin.str.startswith("2021") & (prices.property_type == "All Residential")]
    p = p.groupby("region").median_sale_price.median().dropna().reset_index()
    m = home.merge(attrs, on="id")
    m["region"] = m.name + " County, " + m.code
    m = m.merge(p, on="region")
    m["pp"] = m.amount / m.Civilian_labor_force_2021 * 2000
    return m


def test_rated_child(study, want):
    got = study.rated("child").toPandas().set_index("child_id").sort_index()
    m = want.set_index("id").sort_index()
    assert got.index.tolist() == m.index.tolist() and len(m) > 40
    np.testing.assert_allclose(got.amount_per_person, m.pp)
    np.testing.assert_allclose(got.income_ratio, m.pp / m.Median_Household_Income_2021)
    # Rounded to six significant digits.
    np.testing.assert_allclose(got.price, m.median_sale_price, rtol=5e-6)
    assert [f"{p:.6g}" for p in got.price] == [f"{p:.6g}" for p in m.median_sale_price]


def test_parent_attributes(study, raw):
    attrs = raw[1].dropna(subset=["Median_Household_Income_2021"])
    got = study.attributes("parent").toPandas().set_index("attr_code")
    assert "PR" not in got.index
    for code, part in attrs[attrs.State != "PR"].groupby("State"):
        w = part.Civilian_labor_force_2021
        assert got.weight[code] == w.sum()
        assert got.income[code] == pytest.approx(np.average(part.Median_Household_Income_2021, weights=w))
        assert got.attr_parent_id[code] == next(s for s, c in CODES.items() if c == code)


def test_correlations(study, want):
    columns = {"amount_per_person": "pp", "income": "Median_Household_Income_2021",
               "rate": "Unemployment_rate_2021", "price": "median_sale_price",
               "stratum_code": "Rural_Urban_Continuum_Code_2013"}
    frame = want[list(columns.values())].astype(float)
    corr = frame.corr(method="spearman")
    got = study.correlation_matrix().toPandas().set_index("a")
    for a, pa in columns.items():
        for b, pb in columns.items():
            assert got.loc[a, b] == pytest.approx(corr.loc[pa, pb], abs=1e-9)
    assert study.correlation_matrix(with_stratum=False, stratum=2).count() == 4
    lines = study.correlation_by_stratum().toPandas().set_index("stratum_code")
    for code, part in want.groupby("Rural_Urban_Continuum_Code_2013"):
        rho = part[["pp", "Median_Household_Income_2021"]].corr(method="spearman").iloc[0, 1]
        assert lines.rho_income[code] == pytest.approx(rho, abs=1e-9)
        assert lines.label[code] == presets.STRATUM_LABELS[int(code)]


def sector_frame(raw):
    """Child and major class, for every place with attributes and a price."""
    facts, attrs, prices = (f.copy() for f in raw)
    facts["id"] = facts["STATE FIPS"] + facts["COUNTY FIPS"]
    facts["major"] = facts.SECTOR.str.split(" - ").str[0].replace(MAPPING)
    by = facts.groupby(["id", "major"]).EMISSIONS.sum().reset_index()
    attrs = attrs.dropna(subset=["Median_Household_Income_2021"])
    attrs = attrs[attrs.State != "PR"]
    attrs["id"] = attrs.FIPS_Code.astype(str).str.zfill(5)
    attrs["region"] = attrs.Area_Name.str.replace(", ", " County, ")
    sold = prices.dropna(subset=["median_sale_price"])
    sold = sold[sold.period_begin.str.startswith("2021") & (sold.property_type == "All Residential")]
    by = by.merge(attrs[attrs.region.isin(sold.region)], on="id")
    by["pp"] = by.EMISSIONS / by.Civilian_labor_force_2021 * 2000
    return by


def mix(rows):
    means = {k: np.average(g.pp, weights=g.Civilian_labor_force_2021) for k, g in rows.groupby("major")}
    total = sum(means.values()) - means["Fires"]
    return {k: 100 * v / total for k, v in means.items() if k != "Fires"}


def test_drift(study, raw):
    rows = sector_frame(raw)
    base = mix(rows)
    got = {(r.stratum_code, r.major_class): r.drift for r in study.drift_by_stratum().collect()}
    expected = {}
    for code, part in rows.groupby("Rural_Urban_Continuum_Code_2013"):
        for cls, share in mix(part).items():
            expected[int(code), cls] = base[cls] - share
    assert got == pytest.approx(expected)
    labels = pd.cut(rows.Median_Household_Income_2021, [*presets.INCOME_EDGES, np.inf], right=False,
                    labels=presets.INCOME_LABELS)
    got = {(r.bucket, r.major_class): r.drift for r in study.drift_by_income().collect()}
    expected = {}
    for label, part in rows.groupby(labels, observed=True):
        for cls, share in mix(part).items():
            expected[label, cls] = base[cls] - share
    assert got == pytest.approx(expected)
    widest = max(abs(v) for v in (r.drift for r in study.drift_by_stratum().collect()))
    assert study.drift_axis().first().domain == pytest.approx(1.2 * widest)
    assert {r.stratum_code for r in study.drift_by_stratum(shown=True).collect()} <= set(presets.SHOWN_STRATA)


def test_histograms_extremes_maps(study, want):
    child = study.histograms("child").toPandas()
    assert child.groupby("metric")["count"].size().to_dict() == {
        "Income": 7, "Property Value": 40, "Unemployment Rate": 11, "Emissions": 200,
    }
    assert study.histograms("parent").count() == 29
    found = study.ratio_extremes().toPandas()
    assert len(found) == 40
    ratio = (want.pp / want.Median_Household_Income_2021).nlargest(5)
    top = found[(found.metric == "Income child") & (found.side == "top")].sort_values("rank_no")
    np.testing.assert_allclose(top.value, ratio)
    assert top.label.tolist() == [f"{v:.1e}" for v in ratio]
    assert top.location.tolist() == want.loc[ratio.index].name.tolist()
    np.testing.assert_allclose(top.secondary, want.loc[ratio.index].Civilian_labor_force_2021 / 1e5)
    assert study.parent_extremes().count() == 40
    maps = study.maps().toPandas()
    assert maps.groupby("metric").size().to_dict() == dict.fromkeys(
        ["amount", "amount_per_person", "income", "price", "rate", "weight"], 6
    )
    assert maps[maps.metric == "rate"].text.str.endswith(" (%)").all()
    assert study.normality().count() == 153
