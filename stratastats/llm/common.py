"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_ROWS = 1024  # rows that a worker holds as Python objects at a time
WORD = r"[^\x20\x09-\x0D]+"  # a word: anything between ASCII white space


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns named, under the names an operator uses inside; others cannot clash."""
    return df.select(*[F.col(f"`{column}`").alias(own) for own, column in names.items()])


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def map_rows(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Apply ``fn`` to the columns of each slice of rows; both sides are dicts of lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def stream_rows(
    df: DataFrame,
    fn: Callable[[Iterator[tuple]], Iterator[tuple]],
    schema: str,
    batch_rows: int = 4096,
    batch_bytes: int = 16 << 20,
) -> DataFrame:
    """Stream each partition's rows, as tuples and in order, through the generator ``fn``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target
        )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield from zip(*[c.to_pylist() for c in part.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in fn(rows_of(batches)):
            rows.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if len(rows) >= batch_rows or size >= batch_bytes:
                yield pack(rows)
                rows, size = [], 0
        if rows:
            yield pack(rows)

    return df.mapInArrow(run, schema)


def text_slices(text: str, most: int = 1 << 20) -> Iterator[str]:
    """The whole text in slices of bounded size, cut after white space where there is some."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most)) + 1
        cut = cut if cut > at else at + most
        yield text[at:cut]
        at = cut
    yield text[at:]
