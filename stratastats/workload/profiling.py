"""Scans, profiles, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import zero_pad
from ..operators import (
    describe_numeric,
    distinct_values,
    head_n,
    null_profile,
    sample_n,
    schema_profile,
    union_all,
)
from ..sources import (
    Layout,
    Sources,
    Table,
    read_json_records,
    read_preamble_table,
    read_tsv,
    scratch_path,
)
from . import tables as t
from .registry import query, rounded, table


def _as_json(spark, folder) -> str:
    path = scratch_path(spark, "json")
    customer = table(spark, folder, "customer")
    customer.select(
        zero_pad(F.col("c_custkey").cast("string"), 11).alias("child_part_id"), "c_name",
        F.col("c_acctbal").alias("amount"),
    ).write.json(path)
    return path


def _as_exports(spark, folder, top: list[str], row, end: list[str] = ()) -> str:
    """Every customer in one of several text files: leading lines, a line of each row, last lines."""
    path = scratch_path(spark, "exports")
    exports = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def frame(lines, first):
        numbered = [F.struct(F.lit(first + i).alias("no"), F.lit(x).alias("value")) for i, x in enumerate(lines)]
        return spark.range(exports).select(F.col("id").alias("part"), F.inline(F.array(*numbered)))

    body = table(spark, folder, "customer").select(
        F.pmod(F.xxhash64("c_custkey"), F.lit(exports)).alias("part"), F.lit(len(top)).alias("no"),
        row.alias("value"),
    )
    lines = frame(top, 0).unionByName(body)
    if end:
        lines = lines.unionByName(frame(end, len(top) + 1))
    lines = lines.repartition("part").sortWithinPartitions("part", "no")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


def _as_preamble_exports(spark, folder) -> str:
    """Four lines of preamble, a header, rows."""
    top = ["Area figures", "", "Source, made from customer", "See notes", "area_id,name,income,code"]
    return _as_exports(
        spark, folder, top, F.to_csv(F.struct("c_custkey", "c_name", "c_acctbal", "c_nationkey"))
    )


def _as_quoted_exports(spark, folder) -> str:
    """The same with quoted names, and a text field of two lines with separators and quotes."""
    top = ["Area figures", "", "Source", "Notes", 'area_id,"name, ""long""",income,"code"']
    name = F.concat(F.lit('"'), "c_name", F.lit(' ""of""\nnation, '), "c_nationkey", F.lit('"'))
    return _as_exports(
        spark, folder, top, F.concat_ws(",", "c_custkey", name, "c_acctbal", "c_nationkey")
    )


def _as_json_arrays(spark, folder) -> str:
    """Files that hold one array of objects each."""
    row = F.to_json(
        F.struct(
            zero_pad(F.col("c_custkey").cast("string"), 11).alias("child_part_id"),
            F.concat(F.lit('} "'), "c_name", F.lit("\\ {")).alias("c_name"),
            F.struct(F.array("c_nationkey").alias("keys")).alias("place"),
            F.col("c_acctbal").alias("amount"),
        )
    )
    last = '{"child_part_id": null}]'
    return _as_exports(spark, folder, ["["], F.concat(row, F.lit(",")), [last])


def _as_tsv(spark, folder) -> str:
    path = scratch_path(spark, "tsv")
    table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("date").alias("period_begin"),
        F.col("o_orderstatus").alias("region_type"),
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    return path


JSON_SCHEMA = "child_part_id string, c_name string, amount double"
TSV_COLUMNS = {"period_begin": "date", "region_type": "string", "o_orderkey": "bigint",
               "price": "double"}
PREAMBLE_COLUMNS = {"area_id": "string", "income": "double", "code": "int"}


@query(
    "scan_json",
    "select lpad(cast(c_custkey as varchar), 11, '0') as child_part_id, c_name, "
    "c_acctbal as amount from customer",
)
def scan_json(spark, folder):
    return read_json_records(spark, _as_json(spark, folder), JSON_SCHEMA)


@query(
    "scan_preamble",
    "select cast(c_custkey as varchar) as area_id, c_acctbal as income, c_nationkey as code "
    "from customer",
)
def scan_preamble(spark, folder):
    return read_preamble_table(spark, _as_preamble_exports(spark, folder), PREAMBLE_COLUMNS)


@query(
    "scan_quoted_records",
    """select cast(c_custkey as varchar) as area_id, c_name || ' "of"' || chr(10) || 'nation, ' || c_nationkey as name,
    c_acctbal as income, c_nationkey as code from customer""",
)
def scan_quoted_records(spark, folder):
    """Names and fields in quotes, records over two lines, read split by split."""
    name = 'name, "long"'
    columns = {"area_id": "string", name: "string", "income": "double", "code": "int"}
    found = read_preamble_table(spark, _as_quoted_exports(spark, folder), columns)
    return found.withColumnRenamed(name, "name")


@query(
    "scan_json_array",
    """select lpad(cast(c_custkey as varchar), 11, '0') as child_part_id,
    '} "' || c_name || '\\ {' as c_name, c_nationkey as nation, c_acctbal as amount from customer""",
)
def scan_json_array(spark, folder):
    """Arrays of objects, found to be such, read split by split; the last object is empty."""
    schema = "child_part_id string, c_name string, amount double, place struct<keys: array<int>>"
    found = read_json_records(spark, _as_json_arrays(spark, folder), schema)
    return found.where("child_part_id is not null").select(
        "child_part_id", "c_name", F.get("place.keys", F.lit(0)).alias("nation"), "amount"
    )


@query(
    "scan_tsv",
    "select cast(o_orderdate as date) as period_begin, o_orderstatus as region_type, o_orderkey, "
    "case when o_orderpriority <> '5-LOW' then o_totalprice end as price from orders",
)
def scan_tsv(spark, folder):
    return read_tsv(spark, _as_tsv(spark, folder), TSV_COLUMNS)


LAYOUT = Layout(
    facts=Table({"child_part_id": ("child_part_id", "string", "string"),
                 "amount": ("amount", "double", "double")}),
    attributes=Table({"area_id": ("area_id", "string", "string"),
                      "income": ("income", "double", "double"),
                      "code": ("stratum_code", "double", "int")}),
    prices=Table({"period_begin": ("period_begin", "timestamp_ntz", "date"),
                  "region_type": ("region_type", "string", "string"),
                  "price": ("price", "double", "double")}),
)


@query(
    "load_sources",
    """
    select 'facts' as source, count(*) as row_count, round(sum(c_acctbal), 2) as total from customer
    union all select 'attributes', count(*), round(sum(c_nationkey), 2) from customer
    union all select 'prices', count(*),
      round(sum(case when o_orderpriority <> '5-LOW' then o_totalprice end), 2) from orders""",
)
def load_sources(spark, folder):
    s = Sources.load(
        spark, _as_json(spark, folder), _as_preamble_exports(spark, folder), _as_tsv(spark, folder),
        layout=LAYOUT,
    )
    counted = [
        df.agg(F.lit(name).alias("source"), F.count("*").alias("row_count"),
               F.round(F.sum(measure).cast("double"), 2).alias("total"))
        for name, df, measure in [
            ("facts", s.facts, "amount"), ("attributes", s.attributes, "stratum_code"),
            ("prices", s.prices, "price"),
        ]
    ]
    return union_all(counted)


@query(
    "null_profile",
    f"with {t.SQL_ATTRIBUTES} "
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as nulls from attributes"
        for c in ["weight", "income", "rate", "stratum_code", "area_name"]
    ),
)
def null_profile_(spark, folder):
    return null_profile(
        t.attributes(spark, folder).select("weight", "income", "rate", "stratum_code", "area_name")
    )


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@query(
    "schema_profile",
    " union all ".join(
        f"select '{c}' as \"column\", '{kind}' as dtype, count({c}) as non_null, "
        "count(*) as row_count from orders"
        for c, kind in _ORDER_TYPES.items()
    ),
)
def schema_profile_(spark, folder):
    return schema_profile(table(spark, folder, "orders"))


@query(
    "sample_n",
    "select o_orderkey, o_totalprice from orders "
    "order by md5(cast(o_orderkey as varchar) || '|7'), o_orderkey limit 20",
)
def sample_n_(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample_n(orders, 20, ["o_orderkey"], seed=7)


@query(
    "head_n",
    "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem "
    "order by l_orderkey, l_linenumber, l_partkey, l_extendedprice limit 10",
)
def head_n_(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return head_n(table(spark, folder, "lineitem").select(*columns), 10, *columns)


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]
_DESCRIBE_SQL = " union all ".join(
    f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean,
    round(stddev_samp({c}), 4) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 4) as q25,
    round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75,
    max({c}) as max from lineitem"""
    for c in _DESCRIBED
)


@query("describe_numeric", _DESCRIBE_SQL)
def describe_numeric_(spark, folder):
    described = describe_numeric(table(spark, folder, "lineitem"), _DESCRIBED)
    return rounded(described, "mean", "std", "q25", "q50", "q75", places=4)


@query("describe_large_columns", _DESCRIBE_SQL)
def describe_large_columns(spark, folder):
    """The same figures on the path for columns too long for one task."""
    described = describe_numeric(table(spark, folder, "lineitem"), _DESCRIBED, task_rows=2000)
    return rounded(described, "mean", "std", "q25", "q50", "q75", places=4)


@query("distinct_values", "select distinct p_type from part")
def distinct_values_(spark, folder):
    return distinct_values(table(spark, folder, "part"), "p_type")
