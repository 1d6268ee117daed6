"""SRC-1, 6, 7: tables in, results out, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from plumbline.functions.masking import mask


def read_table(spark: SparkSession, where: str, format: str = "parquet", **options) -> DataFrame:
    """SRC-1: a table by path, or by catalog name when it is no path. Read-only."""
    if "/" in where:
        return spark.read.options(**options).format(format).load(where)
    return spark.table(where)


def save_results(results: DataFrame, path: str) -> None:
    """SRC-6: append rules, rule runs or profiles, one folder per table.

    Rebalancing merges small parts and splits large tables, so files come out even.
    """
    results.hint("rebalance", "table_name").write.mode("append").partitionBy("table_name").parquet(path)


def preview(df: DataFrame, n: int, *order: Column | str, masked: bool = True) -> DataFrame:
    """SRC-7: the first n rows, sensitive columns masked."""
    rows = (df.orderBy(*order) if order else df).limit(n)
    return mask(rows) if masked else rows
