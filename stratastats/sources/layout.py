"""How source columns map to canonical ones.

Canonical names differ in more than case, so frames can be joined without clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nan_as_null


def _typed(c: Column, read_as: str, kind: str) -> Column:
    """A column in its canonical type; NaN is missing."""
    return (nan_as_null(c) if read_as == "double" else c).cast(kind)


@dataclass(frozen=True)
class Table:
    """Source column name -> (canonical name, type in the file, canonical type)."""

    columns: dict[str, tuple[str, str, str]]

    def types(self) -> dict[str, str]:
        return {source: read_as for source, (_, read_as, _) in self.columns.items()}

    def ddl(self) -> str:
        return ", ".join(f"`{source}` {kind}" for source, kind in self.types().items())

    def canonical(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                _typed(F.col(f"`{source}`"), read_as, kind).alias(name)
                for source, (name, read_as, kind) in self.columns.items()
            ]
        )


@dataclass(frozen=True)
class Layout:
    facts: Table
    attributes: Table
    prices: Table


# Column names of the three published data sets.
PUBLISHED = Layout(
    facts=Table(
        {
            "STATE FIPS": ("parent_id", "string", "string"),
            "COUNTY FIPS": ("child_part_id", "string", "string"),
            "STATE": ("parent_code", "string", "string"),
            "COUNTY": ("child_name", "string", "string"),
            "SECTOR": ("sector_path", "string", "string"),
            "EMISSIONS": ("amount", "double", "double"),
        }
    ),
    attributes=Table(
        {
            "FIPS_Code": ("area_id", "string", "string"),
            "Area_Name": ("area_name", "string", "string"),
            "State": ("parent_code", "string", "string"),
            "Civilian_labor_force_2021": ("weight", "double", "double"),
            "Median_Household_Income_2021": ("income", "double", "double"),
            "Unemployment_rate_2021": ("rate", "double", "double"),
            "Rural_Urban_Continuum_Code_2013": ("stratum_code", "double", "int"),
        }
    ),
    prices=Table(
        {
            "period_begin": ("period_begin", "timestamp_ntz", "timestamp_ntz"),
            "period_end": ("period_end", "timestamp_ntz", "timestamp_ntz"),
            "region_type": ("region_type", "string", "string"),
            "region": ("region_label", "string", "string"),
            "state": ("parent_name", "string", "string"),
            "state_code": ("parent_code", "string", "string"),
            "property_type": ("property_type", "string", "string"),
            "median_sale_price": ("price", "double", "double"),
        }
    ),
)
