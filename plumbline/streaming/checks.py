"""Row rules need no state, so a stream is checked row by row as it arrives."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import rules as rule_ops


def violations(stream: DataFrame, rules: DataFrame | Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows of the stream that break a rule, with the ids of the rules (CHK-9)."""
    return rule_ops.failing_rules(stream, rules).where(F.size("failed") > 0)


def write_violations(
    stream: DataFrame,
    rules: DataFrame | Iterable[Mapping[str, Any]],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Violating rows appended to a parquet folder, exactly once over restarts."""
    return (
        violations(stream, rules)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
