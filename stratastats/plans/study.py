"""The whole analysis on one set of sources: every table behind its charts and maps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.correlation import pivot_matrix, spearman
from ..operators.distribution import histogram_panel, normality_report
from ..operators.extremes import extremes_panel
from ..operators.maptable import map_tables
from ..operators.merge import inner_join, merge_sources
from ..operators.strata import drift_domain, select_strata, sort_custom_order, with_drift_flags
from ..functions import decode, rate_per_weight
from ..sources import Sources, written
from . import presets
from .clean import clean_attributes, clean_facts, clean_prices
from .pipelines import bucket_drift, class_drift, correlation_lines, with_ratios

MEASURES = ["amount_per_person", "income", "rate", "price", "stratum_code"]
PANEL_TITLES = ["Income", "Property Value", "Unemployment Rate", "Emissions"]


@dataclass
class Study:
    """Tables by question. Cleaned and merged frames are stored once and shared.

    ``mapping`` renames first-level categories to major classes.
    """

    sources: Sources
    mapping: Mapping[str, str] = field(default_factory=dict)
    contributor: str = "residential"

    def __post_init__(self) -> None:
        self._stored: dict[tuple, DataFrame] = {}

    def _once(self, *name: str, build) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = written(build(), "-".join(name))
        return self._stored[name]

    def prices(self, level: str) -> DataFrame:
        return self._once("prices", level, build=lambda: clean_prices(self.sources.prices, level))

    def attributes(self, level: str) -> DataFrame:
        return self._once(
            "attributes", level, build=lambda: clean_attributes(self.sources.attributes, level)
        )

    def facts(self, level: str) -> DataFrame:
        return self._once(
            "facts", level, build=lambda: clean_facts(self.sources.facts, level, self.contributor)
        )

    def rated(self, level: str) -> DataFrame:
        """One row per place of all three sources, with ratios."""
        return self._once(
            "rated", level,
            build=lambda: with_ratios(
                merge_sources(self.facts(level), self.attributes(level), self.prices(level), level)
            ),
        )

    def rated_by_class(self, level: str = "child") -> DataFrame:
        """One row per place and major class."""

        def build():
            by_class = clean_facts(
                self.sources.facts, level, "by sector", agg=False, mapping=self.mapping
            )
            return with_ratios(
                merge_sources(by_class, self.attributes(level), self.prices(level), level)
            )

        return self._once("rated-by-class", level, build=build)

    def histograms(self, level: str) -> DataFrame:
        attributes = self.attributes(level)
        frames = {"income": attributes, "price": self.prices(level), "rate": attributes,
                  "amount": self.facts(level)}
        panels = zip(PANEL_TITLES, presets.PANEL_METRICS, presets.PANEL_DIVISORS,
                     presets.PANEL_BINS[level])
        return histogram_panel([(t, frames[c], c, d, b) for t, c, d, b in panels])

    def parent_extremes(self) -> DataFrame:
        """Top and bottom five parents of each source."""
        attributes, prices, facts = (
            frame("parent").withColumn("place", F.col(code))
            for frame, code in (
                (self.attributes, "attr_code"), (self.prices, "price_code"), (self.facts, "parent_code")
            )
        )
        frames = {"income": attributes, "price": prices, "rate": attributes, "amount": facts}
        panels = []
        for title, column, divisor in zip(
            PANEL_TITLES, presets.PANEL_METRICS, presets.PANEL_DIVISORS
        ):
            panels.append((title, frames[column], column, divisor, "place"))
        return extremes_panel(panels, ["place"])

    def ratio_extremes(self) -> DataFrame:
        """Top and bottom five places by ratio to income and to price, at both levels."""
        panels = []
        for level, location, key in (
            ("child", "child_name", "child_id"), ("parent", "parent_code", "parent_id")
        ):
            frame = self.rated(level).withColumn("place", F.col(key))
            for ratio, title in (("income_ratio", "Income"), ("price_ratio", "Property Value")):
                panels.append((f"{title} {level}", frame, ratio, 1.0, location))
        return extremes_panel(panels, ["place"], secondary="weight")

    def correlation_matrix(self, with_stratum: bool = True, stratum: int | None = None) -> DataFrame:
        """Square Spearman matrix, of one stratum if a code is given."""
        columns = MEASURES if with_stratum else MEASURES[:-1]
        rows = self.rated("child")
        if stratum is not None:
            rows = rows.where(F.col("stratum_code") == stratum)
        return pivot_matrix(spearman(rows, columns, ["child_id"], stored=True), columns)

    def correlation_by_stratum(self) -> DataFrame:
        return correlation_lines(self.rated("child"), ["child_id"], labels=presets.STRATUM_LABELS)

    def normality(self) -> DataFrame:
        return normality_report(self.rated("child"), "amount_per_person")

    def drift_by_stratum(self, shown: bool = False) -> DataFrame:
        """Class drift per urbanisation stratum; ``shown`` keeps the charted strata."""
        drift = with_drift_flags(class_drift(self.rated_by_class()))
        drift = drift.withColumn("label", decode("stratum_code", presets.STRATUM_LABELS))
        drift = sort_custom_order(drift, "major_class", presets.CLASS_ORDER)
        return select_strata(drift, "stratum_code", presets.SHOWN_STRATA) if shown else drift

    def drift_by_income(self) -> DataFrame:
        return with_drift_flags(bucket_drift(self.rated_by_class()))

    def drift_axis(self, shared: bool = True) -> DataFrame:
        drift = class_drift(self.rated_by_class())
        return drift_domain(drift, [] if shared else ["stratum_code"])

    def maps(self) -> DataFrame:
        """Map tables of all measures; prices come from the three-source merge."""
        two = inner_join(
            self.facts("parent"), self.attributes("parent"), "parent_code", "attr_code",
            ["weight", "income", "rate"],
        ).withColumn("amount_per_person", rate_per_weight("amount", "weight"))
        columns = ("amount_per_person", "amount", "weight", "income", "rate")
        price = map_tables(self.rated("parent"), ["price"], "parent_code")
        return map_tables(two, columns, "parent_code").unionByName(price)
