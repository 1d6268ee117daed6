"""Small results kept on the driver as local tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Jobs submitted side by side; Spark shares the executors between them.
JOBS_AT_ONCE = 8


def local_frame(
    spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: T.StructType
) -> DataFrame:
    """Rows of profile or rule size as a local table, whose size Spark knows for its joins."""
    table = pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def on_driver(small: DataFrame) -> DataFrame:
    """A profile- or rule-sized frame computed once and kept as a local table."""
    return small.sparkSession.createDataFrame(small.toArrow(), small.schema)


def side_by_side(job: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """The job's result for every item, several at once."""
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(job, list(items)))
