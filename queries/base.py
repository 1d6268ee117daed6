"""Registration of queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Columns of the given tables, for SQL that is generated per column.
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {
        "c_custkey": "int", "c_name": "text", "c_nationkey": "int",
        "c_acctbal": "number", "c_mktsegment": "text",
    },
    "supplier": {
        "s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "number",
    },
    "part": {
        "p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text",
        "p_size": "int", "p_retailprice": "number",
    },
    "orders": {
        "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text",
        "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text",
    },
    "lineitem": {
        "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
        "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number",
        "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text",
        "l_shipdate": "time",
    },
    "events": {
        "event_id": "int", "ts": "time", "user_id": "int", "event_type": "text",
        "value": "number", "props": "text",
    },
    "documents": {
        "doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int",
    },
    "embeddings": {"vec_id": "int", "embedding": "nested", "label": "int"},
    "pages": {"page_id": "int", "url": "text", "html": "text"},
    "benchmark": {"item_id": "int", "text": "text"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}
CLASS = {"int": "INTEGER", "number": "NUMBER", "text": "STRING", "time": "DATETIME", "nested": "OTHER"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TABLES}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
