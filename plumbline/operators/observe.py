"""Observability over tables, rule runs and profile snapshots (OBS-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks
from plumbline.operators.skew import look_up

# Dimension of each rule type, and the grades of a score in percent.
DIMENSIONS = {
    checks.NOT_NULL: "completeness",
    checks.ROW_COUNT: "completeness",
    checks.UNIQUE: "uniqueness",
    checks.BETWEEN: "validity",
    checks.IN_SET: "validity",
    checks.LENGTH: "validity",
    checks.REGEX: "validity",
    "TEMPORAL": "timeliness",
    "CROSS_COLUMN": "consistency",
    "CONDITIONAL_DEPENDENCY": "consistency",
    checks.DEPENDENCY: "consistency",
    checks.CUSTOM_SQL: "consistency",
}
TRAILING_DAYS = 7
HISTORY_DAYS = 7
SIGMAS = 3.0


def freshness(
    df: DataFrame, timestamp: str, target_minutes: float, now: Column | None = None
) -> DataFrame:
    """OBS-1: minutes since the newest timestamp, against a target."""
    at = now if now is not None else F.current_timestamp()
    newest = df.agg(F.max(timestamp).alias("newest"))
    delay = F.timestamp_diff("SECOND", F.col("newest"), at) / 60.0
    return newest.select(
        "newest",
        delay.alias("delay_minutes"),
        F.lit(float(target_minutes)).alias("target_minutes"),
        (delay <= F.lit(float(target_minutes))).alias("on_time"),
    )


def _with_gaps(daily: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, day, until, rows) with the days between the first and the last of each group filled in.

    The days of a long gap that have TRAILING_DAYS empty days before and after are one row from
    ``day`` to ``until``, so a group has a few rows for each day with rows, whatever its span.
    """
    order = Window.partitionBy(*groups, F.lit(0)).orderBy("day")
    last = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    day, last_day = F.col("day"), F.col("last")
    head, tail = F.date_add("day", TRAILING_DAYS + 1), F.date_sub("last", TRAILING_DAYS)
    single = lambda first, until: F.transform(
        F.sequence(first, until), lambda d: F.struct(d.alias("day"), d.alias("until"))
    )
    middle = F.array(F.struct(F.date_add("day", TRAILING_DAYS + 2).alias("day"), tail.alias("until")))
    spans = F.when(
        F.date_diff("last", "day") > 2 * TRAILING_DAYS + 2,
        F.concat(single(day, head), middle, single(F.date_add(tail, 1), last_day)),
    ).otherwise(single(day, last_day))
    filled = daily.withColumn("last", last).select(*groups, "day", "rows", F.explode(spans).alias("span"))
    rows = F.when(F.col("span.day") == day, F.col("rows")).otherwise(F.lit(0).cast("bigint"))
    return filled.select(*groups, "span.day", "span.until", rows.alias("rows"))


def daily_volume(
    df: DataFrame,
    timestamp: str,
    by: list[str] | None = None,
    sigmas: float = SIGMAS,
    gaps_as_ranges: bool = False,
) -> DataFrame:
    """OBS-2: rows per day, change from the day before, expected range, anomaly flag.

    The range is mean +- sigmas * deviation of the TRAILING_DAYS days before. Days without rows
    between the first and the last day of a group count 0; rows without a time are left out.
    Rows are counted per day before the window runs, and the inner days of a long gap, which are
    all alike, go through it as one row, so that one odd date costs the window nothing. With
    ``gaps_as_ranges`` they stay one row, from ``day`` to ``until``; else each is a row.
    """
    groups = list(by or [])
    daily = _with_gaps(
        df.where(F.col(timestamp).isNotNull())
        .groupBy(*groups, F.to_date(timestamp).alias("day"))
        .agg(F.count(F.lit(1)).alias("rows")),
        groups,
    )
    ordered = Window.partitionBy(*groups, F.lit(0)).orderBy("day")
    trailing = ordered.rowsBetween(-TRAILING_DAYS, -1)
    previous = F.lag("rows").over(ordered)
    mean, spread = F.avg("rows").over(trailing), F.stddev("rows").over(trailing)
    low, high = mean - sigmas * spread, mean + sigmas * spread
    judged = daily.select(
        *groups,
        "day",
        "until",
        "rows",
        (F.col("rows") - previous).alias("change"),
        (F.try_divide(F.col("rows") - previous, previous) * F.lit(100.0)).alias("change_pct"),
        low.alias("expected_low"),
        high.alias("expected_high"),
    ).withColumn(
        "anomaly",
        F.coalesce(
            (F.col("rows") < F.col("expected_low")) | (F.col("rows") > F.col("expected_high")),
            F.lit(False),
        ),
    )
    if gaps_as_ranges:
        return judged
    rest = [c for c in judged.columns if c not in (*groups, "day", "until")]
    return judged.select(*groups, F.explode(F.sequence("day", "until")).alias("day"), *rest)


def suite_status(runs: DataFrame) -> DataFrame:
    """OBS-3: passed, warning, failed and total rule runs, with the pass rate in percent."""
    total, passed = F.count(F.lit(1)), F.count_if(F.col("status") == "PASSED")
    return runs.agg(
        total.alias("total_tests"),
        passed.alias("passed"),
        F.count_if(F.col("status") == "WARNING").alias("warning"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.when(total > 0, passed / total * F.lit(100.0)).otherwise(F.lit(0.0)).alias("pass_rate"),
    )


def schema_snapshot(df: DataFrame, table_name: str) -> DataFrame:
    """Columns and types of a table, without reading it."""
    rows = [
        {"table_name": table_name, "column_name": f.name, "data_type": f.dataType.simpleString()}
        for f in df.schema.fields
    ]
    text = schemas.S
    return local_frame(df.sparkSession, rows, schemas.struct(table_name=text, column_name=text, data_type=text))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """OBS-4: columns added, removed or retyped between two snapshots of profiles or schemas."""
    on = ["table_name", "column_name"]
    old = before.select(*on, F.col("data_type").alias("old_type"))
    new = after.select(*on, F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "ADDED")
        .when(F.col("new_type").isNull(), "REMOVED")
        .when(F.col("old_type") != F.col("new_type"), "RETYPED")
    )
    return (
        old.join(new, on, "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
    )


def dimension(rule_type: Column) -> Column:
    pairs = [F.lit(x) for kv in DIMENSIONS.items() for x in kv]
    return F.create_map(*pairs)[rule_type]


def dimension_scores(runs: DataFrame) -> DataFrame:
    """OBS-5: mean pass rate in percent per dimension."""
    return (
        runs.withColumn("dimension", dimension(F.col("rule_type")))
        .where(F.col("dimension").isNotNull())
        .groupBy("dimension")
        .agg((F.avg("pass_rate") * F.lit(100.0)).alias("score"), F.count(F.lit(1)).alias("runs"))
    )


def run_history(runs: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """OBS-6: passed, warning and failed runs on each of the last days, 0 where none ran."""
    dated = runs.select(F.to_date("run_at").alias("day"), "status").where(F.col("day").isNotNull())
    newest = dated.agg(F.max("day").alias("newest"))
    calendar = newest.where(F.col("newest").isNotNull()).select(
        F.explode(F.sequence(F.date_sub("newest", days - 1), "newest")).alias("day")
    )
    counted = dated.groupBy("day").pivot("status", ["PASSED", "WARNING", "FAILED"]).count()
    return calendar.join(counted, "day", "left").select(
        "day",
        *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("PASSED", "WARNING", "FAILED")],
    )


def health_score(scores: DataFrame) -> DataFrame:
    """OBS-8: mean of the dimension scores."""
    return scores.agg(F.avg("score").alias("health_score"))


def history_bounds(snapshots: DataFrame, min_snapshots: int = 3) -> DataFrame:
    """OBS-9: row count range of every table, over its profile snapshots.

    ``snapshots``: table_name, column_name, timestamp, row_count, top_values.
    """
    per_time = snapshots.groupBy("table_name", "timestamp").agg(F.max("row_count").alias("n"))
    return per_time.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        F.avg("n").alias("mean_rows"),
        (F.count(F.lit(1)) >= min_snapshots).alias("reliable"),
    )


def stable_values(snapshots: DataFrame) -> DataFrame:
    """OBS-9: values present in every snapshot of a column, and those seen only in some."""
    keys = ["table_name", "column_name"]
    times = snapshots.groupBy(*keys).agg(F.count_distinct("timestamp").alias("snapshots"))
    values = snapshots.select(
        *keys, "timestamp", F.explode("top_values.value").alias("value")
    )
    seen = values.groupBy(*keys, "value").agg(F.count_distinct("timestamp").alias("seen"))
    return look_up(seen, times, keys).select(
        *keys, "value", "seen", "snapshots", (F.col("seen") == F.col("snapshots")).alias("stable")
    )


def profile_drift(snapshots: DataFrame, metric: str) -> DataFrame:
    """OBS-9: change of a profile metric from one snapshot of a column to the next."""
    order = Window.partitionBy("table_name", "column_name").orderBy("timestamp")
    before = F.lag(metric).over(order)
    return snapshots.select(
        "table_name",
        "column_name",
        "timestamp",
        F.col(metric),
        (F.col(metric) - before).alias("change"),
    )
