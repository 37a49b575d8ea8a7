"""File readers. Schemas are declared, so no pass over the data infers types."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from .layout import PUBLISHED, Layout
from .records import LINES, OBJECTS, read_records


def read_json_records(
    spark: SparkSession, path: str, schema: StructType | str, array: bool | None = None
) -> DataFrame:
    """JSON records with declared types, so ids keep their leading zeros.

    Files hold one record per line, or one top-level array of objects each (``array``); None
    looks at how the first file begins. Both are read split by split, an array on one line too.
    """
    if array is None:
        top = spark.read.option("lineSep", OBJECTS.separator).text(path).head(1)
        array = bool(top) and top[0].value.lstrip("\ufeff \t\r\n").startswith("[")
    if not array:
        return spark.read.schema(schema).json(path)
    records, _ = read_records(spark, path, OBJECTS)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return records.select(F.from_json("value", kind).alias("r")).select("r.*")


def read_tsv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Tab-separated text with a header line, the same in every file.

    ``columns`` maps the wanted header names to Spark types; the others are not parsed. Where a
    quoted field holds a line break (a look at the quotes tells), records are put together first.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
        return read_preamble_table(spark, path, columns, 0, "\t")
    text = (
        spark.read.option("sep", "\t").option("header", True).option("escape", '"')
        .option("enforceSchema", False).csv(path)
    )
    _require(columns, text.columns)
    return text.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def _require(columns: dict[str, str], header: list[str]) -> None:
    missing = sorted(set(columns) - set(header))
    if missing:
        raise ValueError(f"columns not in the header: {missing}")


def read_preamble_table(
    spark: SparkSession,
    path: str,
    columns: dict[str, str],
    preamble_lines: int = 4,
    sep: str = ",",
) -> DataFrame:
    """Delimited exports whose header follows a few lines of preamble.

    ``path`` may hold many such files; their headers must be the same. ``columns`` maps the
    wanted header names to Spark types; other columns are never converted. Header names and
    fields may be quoted, and then hold the separator, doubled quotes and line breaks; a quote
    that is never closed raises an error. Blank lines are dropped.
    """
    rows, headers = read_records(spark, path, LINES, preamble_lines, header=True)
    if not headers:
        raise ValueError(f"no header after {preamble_lines} lines in {path}")
    names = [[n.strip() for n in next(csv.reader([h.removeprefix("\ufeff")], delimiter=sep))] for h in headers]
    if any(n != names[0] for n in names):
        raise ValueError(f"headers differ: {names[0]} and {names[1]}")
    _require(columns, names[0])
    # By place: names may repeat among the columns that nobody asked for
    as_text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names[0]))])
    options = {"sep": sep, "escape": '"'}
    parsed = rows.where(F.trim("value") != "").select(
        F.from_csv("value", as_text.simpleString(), options).alias("r")
    )
    return parsed.select(
        *[
            F.col("r").getField(f"c{names[0].index(name)}").cast(kind).alias(name)
            for name, kind in columns.items()
        ]
    )


@dataclass(frozen=True)
class Sources:
    """The three inputs of the analysis in canonical columns, read lazily."""

    facts: DataFrame
    attributes: DataFrame
    prices: DataFrame

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        facts_path: str,
        attributes_path: str,
        prices_path: str,
        facts_array: bool | None = None,
        preamble_lines: int = 4,
        layout: Layout = PUBLISHED,
    ) -> "Sources":
        facts = read_json_records(spark, facts_path, layout.facts.ddl(), array=facts_array)
        attributes = read_preamble_table(
            spark, attributes_path, layout.attributes.types(), preamble_lines
        )
        prices = read_tsv(spark, prices_path, layout.prices.types())
        return cls(
            layout.facts.canonical(facts),
            layout.attributes.canonical(attributes),
            layout.prices.canonical(prices),
        )
