"""Readers on small files, and stored intermediate tables."""

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratastats.sources import (
    read_json_records,
    read_preamble_table,
    read_tsv,
    scratch_path,
    written,
)

FACTS = "`STATE FIPS` string, `COUNTY FIPS` string, EMISSIONS double"


def test_json_array_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"STATE FIPS": "01", "COUNTY FIPS": "001", "EMISSIONS": 1.5},
                                {"STATE FIPS": "02", "COUNTY FIPS": "010", "EMISSIONS": None}]))
    got = read_json_records(spark, str(path), FACTS, array=True).collect()
    assert [tuple(r) for r in got] == [("01", "001", 1.5), ("02", "010", None)]


def test_json_numbers_forced_to_text(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"STATE FIPS": 1, "COUNTY FIPS": "001", "EMISSIONS": 2}\n')
    assert tuple(read_json_records(spark, str(path), FACTS).first()) == ("1", "001", 2.0)


def test_tsv(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("region\tx\tprice\nA County, OH\t1\t5.5\nB County, OH\t\t\n")
    got = read_tsv(spark, str(path), {"price": "double", "region": "string"})
    got = got.select("region", "price").collect()
    with pytest.raises(ValueError, match="not in the header"):
        read_tsv(spark, str(path), {"absent": "int"})
    assert [tuple(r) for r in got] == [("A County, OH", 5.5), ("B County, OH", None)]


PREAMBLE = "Title\n\nSource: office\nfigures,by,area\nFIPS_Code,Area_Name,Income_2020,Income_2021\n"


def test_preamble_table(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(PREAMBLE + '01001,"Autauga, AL",1,5.5\n01003,Baldwin,,\n\n01005,Title,3,7\n')
    columns = {"FIPS_Code": "string", "Area_Name": "string", "Income_2021": "double"}
    got = read_preamble_table(spark, str(path), columns).collect()
    assert [tuple(r) for r in got] == [
        ("01001", "Autauga, AL", 5.5), ("01003", "Baldwin", None), ("01005", "Title", 7.0),
    ]
    with pytest.raises(ValueError, match="not in the header"):
        read_preamble_table(spark, str(path), {"Absent": "string"})


def test_preamble_in_many_files_and_splits(spark, tmp_path):
    """Rows that look like the preamble are kept; only the first lines of each file go."""
    want = 0
    for f in range(6):
        lines = [f"{i:06d},Title,{i},{i}" for i in range(50 if f % 2 else 4000)] + ["Title"]
        want += len(lines)
        (tmp_path / f"part{f}.csv").write_text(PREAMBLE + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = read_preamble_table(spark, str(tmp_path), {"FIPS_Code": "string", "Income_2021": "int"})
        assert got.rdd.getNumPartitions() > 6
        assert got.count() == want
        assert got.where("FIPS_Code = 'Title'").count() == 6
        assert got.agg(F.max("Income_2021")).first()[0] == 3999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_written_goes_to_the_checkpoint_folder(spark):
    df = written(spark.range(10).withColumn("x", F.lit(1.5)), "t")
    assert df.count() == 10
    folder = spark.sparkContext.getCheckpointDir()
    assert folder and all(folder.split(":")[-1] in f for f in df.inputFiles())
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    for name in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.{name}")


def test_quoted_header_and_line_breaks_over_splits(spark, tmp_path, small_splits, monkeypatch):
    """Fields with the separator, quotes and line breaks, some longer than several splits."""
    rng = np.random.default_rng(1)
    parts = ["a", "b,", '"', "\n", "\n\n", " word", "é", "1"]
    want = []
    for f in range(3):
        lines = io.StringIO()
        out = csv.writer(lines, lineterminator="\r\n" if f == 1 else "\n")
        for i in range(120):
            text = "".join(rng.choice(parts, rng.integers(0, 12))).strip() + "."
            if i % 40 == 3:
                text = 'line "of" it\n' * 200 + "end"
            out.writerow([f"{f}{i:03d}", text, i / 4])
            want.append((f"{f}{i:03d}", text, i / 4))
        top = 'Title "of\n\nSource\nfigures\n' + '"FIPS","Name, ""long""","Rate"' + ("\r\n" if f == 1 else "\n")
        (tmp_path / f"part{f}.csv").write_bytes((top + lines.getvalue()).encode())
    columns = {"FIPS": "string", 'Name, "long"': "string", "Rate": "double"}
    for limit in (50_000, 0):
        monkeypatch.setattr("stratastats.sources.records.BROADCAST_ROWS", limit)
        got = read_preamble_table(spark, str(tmp_path), columns)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_quotes_and_headers_that_cannot_be_read_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="within a record"):
        read_preamble_table(spark, str(tmp_path), {"x": "int"}, 0)
    (tmp_path / "a.csv").write_text('x,y\n1,2\n')
    (tmp_path / "b.csv").write_text('y,x\n1,2\n')
    with pytest.raises(ValueError, match="headers differ"):
        read_preamble_table(spark, str(tmp_path), {"x": "int"}, 0)
    (tmp_path / "b.csv").write_text("x\n")
    with pytest.raises(ValueError, match="no header"):
        read_preamble_table(spark, str(tmp_path), {"x": "int"}, 1)


def test_tsv_with_quoted_line_breaks(spark, tmp_path, small_splits):
    want = [(f"r{i}", "two\nlines\tand a tab" if i % 3 else 'a "word"', float(i)) for i in range(200)]
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\n").writerows([("region", "text", "price"), *want])
    (tmp_path / "a.tsv").write_text(out.getvalue())
    got = read_tsv(spark, str(tmp_path), {"region": "string", "text": "string", "price": "double"})
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    """The rows of the reader that takes a file in one task; braces and quotes within strings."""
    rng = np.random.default_rng(3)
    parts = ["a", "}", "{", '"', "\\", "[", "},", '"}', "\n", "é", ' {"b": 1}']
    made = []
    for i in range(300):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        made.append({"id": f"{i:04d}", "text": text * (150 if i % 90 == 5 else 1), "x": i / 8, "deep": {"list": [{"k": text}, {}], "n": None}})
    schema = "id string, text string, x double, deep struct<list: array<struct<k: string>>, n: int>"
    (tmp_path / "a.json").write_text(json.dumps(made[:200], indent=indent))
    (tmp_path / "b.json").write_text("  " + json.dumps(made[200:], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "c.json").write_text("[]")
    got = read_json_records(spark, str(tmp_path), schema)
    want = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    assert want.count() == 300 and sorted(got.collect()) == sorted(want.collect())
    assert got.rdd.getNumPartitions() > 10
    (tmp_path / "c.json").write_text('[{"id": "1", "text": "}')
    with pytest.raises(ValueError, match="within a record"):
        read_json_records(spark, str(tmp_path), schema)


def test_json_lines_are_told_from_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "01"}\n{"id": "[{"}\n')
    assert [r.id for r in read_json_records(spark, str(tmp_path), "id string").collect()] == ["01", "[{"]
