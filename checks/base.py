"""Shared inputs of the registered queries, in Spark and as SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from recordloom.operators.extract import extract
from recordloom.session import shared_folder
from recordloom.sources.readers import records_from_table

# Key and columns of the tables used as record datasets; "d" decimal text, "t" date text.
TABLES = {
    "region": ("r_regionkey", {"r_regionkey": "", "r_name": ""}),
    "nation": ("n_nationkey", {"n_nationkey": "", "n_name": "", "n_regionkey": ""}),
    "customer": ("c_custkey", {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "d", "c_mktsegment": ""}),
    "supplier": ("s_suppkey", {"s_suppkey": "", "s_name": "", "s_nationkey": "", "s_acctbal": "d"}),
    "part": ("p_partkey", {"p_partkey": "", "p_name": "", "p_brand": "", "p_type": "", "p_size": "", "p_retailprice": "d"}),
    "orders": (
        "o_orderkey",
        {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": ""},
    ),
    "documents": ("doc_id", {"doc_id": "", "text": "", "lang": "", "source": "", "n_chars": ""}),
    "pages": ("page_id", {"page_id": "", "url": "", "html": ""}),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    parts = [
        records_from_table(table(spark, sf, n), n, TABLES[n][0], list(TABLES[n][1])) for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def key_values(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return extract(records(spark, sf, *names))


def scratch(spark: SparkSession) -> str:
    """A new folder for a query that goes through files: in the shared checkpoint folder if set."""
    return shared_folder(spark)


def text_sql(column: str, kind: str) -> str:
    if kind == "d":
        return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"
    if kind == "t":
        return f"strftime({column}, '%Y-%m-%d')"
    return f"CAST({column} AS VARCHAR)"


def melted_sql(*names: str) -> str:
    """CTE list ending in ``melted(dataset, record_index, field_pos, field, value)``."""
    ctes, parts = [], []
    for name in names:
        key, columns = TABLES[name]
        ctes.append(f"rec_{name} AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS record_index FROM {name})")
        for pos, (column, kind) in enumerate(columns.items()):
            parts.append(
                f"SELECT '{name}' AS dataset, record_index, {pos} AS field_pos, '{column}' AS field, "
                f"{text_sql(column, kind)} AS value FROM rec_{name}"
            )
    ctes.append("melted AS (" + " UNION ALL ".join(parts) + ")")
    return ", ".join(ctes)


def kv_sql(*names: str) -> str:
    """CTE list ending in ``kv(dataset, record_index, doc_id, key_name, value)``."""
    return melted_sql(*names) + (
        ", kv AS (SELECT dataset, record_index, printf('%s_%04d', dataset, record_index) AS doc_id,"
        " field AS key_name, trim(value) AS value FROM melted WHERE trim(coalesce(value, '')) <> '')"
    )


def values_sql(rows: list[tuple]) -> str:
    """SQL VALUES list of strings, numbers and nulls."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)
