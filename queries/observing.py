"""OBS-*."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks, drift, observe, states
from plumbline.streaming import volume
from queries.base import TABLES, query, table
from queries.sources import shared_folder

NOW = "2024-02-01 00:00:00"


@query(
    f"""SELECT CAST(max(ts) AS VARCHAR) AS newest, date_sub('second', max(ts), TIMESTAMP '{NOW}') / 60 AS delay_minutes, 1440.0::DOUBLE AS target_minutes,
        date_sub('second', max(ts), TIMESTAMP '{NOW}') / 60 <= 1440 AS on_time FROM events"""
)
def obs_freshness(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    found = observe.freshness(table(spark, sf_dir, "events"), "ts", 1440, now)
    return found.withColumn("newest", F.col("newest").cast("string"))


@query(
    """
    WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events WHERE dayofmonth(ts) % 5 <> 0),
    n AS (SELECT event_type, day, count(*) AS rows FROM e GROUP BY ALL),
    d AS (SELECT c.event_type, c.day, COALESCE(rows, 0) AS rows
          FROM (SELECT event_type, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e GROUP BY 1) c
          LEFT JOIN n ON n.event_type = c.event_type AND n.day = c.day),
    w AS (SELECT *, lag(rows) OVER o AS before, avg(rows) OVER t AS mean, stddev_samp(rows) OVER t AS sd FROM d
          WINDOW o AS (PARTITION BY event_type ORDER BY day), t AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT event_type, CAST(day AS VARCHAR) AS day, rows, rows - before AS change, round((rows - before) / NULLIF(before, 0) * 100, 4) AS change_pct,
           round(mean - 2 * sd, 4) AS expected_low, round(mean + 2 * sd, 4) AS expected_high,
           COALESCE(rows < mean - 2 * sd OR rows > mean + 2 * sd, FALSE) AS anomaly FROM w
    """
)
def obs_daily_volume(spark, sf_dir):
    """Every fifth day of a month has no events, and some events have no time."""
    events = table(spark, sf_dir, "events").select(
        "event_type", F.when(F.dayofmonth("ts") % 5 != 0, F.col("ts")).alias("ts")
    )
    found = observe.daily_volume(events, "ts", ["event_type"], 2.0)
    rounded = [F.round(c, 4).alias(c) for c in ("change_pct", "expected_low", "expected_high")]
    return found.select("event_type", F.col("day").cast("string").alias("day"), "rows", "change", *rounded, "anomaly")


TYPES = {
    "1-URGENT": checks.NOT_NULL,
    "2-HIGH": checks.UNIQUE,
    "3-MEDIUM": checks.BETWEEN,
    "4-NOT SPECIFIED": "TEMPORAL",
    "5-LOW": "CROSS_COLUMN",
}
TYPES_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in TYPES.items()) + " END"
RUNS_SQL = f"""(SELECT {TYPES_SQL} AS rule_type, CASE o_orderstatus WHEN 'O' THEN 'PASSED' WHEN 'F' THEN 'FAILED' ELSE 'WARNING' END AS status,
    o_totalprice / 500000 AS pass_rate, o_orderdate AS run_at FROM orders)"""


def runs(spark, sf_dir) -> DataFrame:
    """Orders as rule runs: the priority is the rule type, the status the outcome."""
    status = F.col("o_orderstatus")
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return table(spark, sf_dir, "orders").select(
        types[F.col("o_orderpriority")].alias("rule_type"),
        F.when(status == "O", "PASSED").when(status == "F", "FAILED").otherwise("WARNING").alias("status"),
        (F.col("o_totalprice") / 500000).alias("pass_rate"),
        F.col("o_orderdate").alias("run_at"),
    )


@query(
    f"""SELECT count(*) AS total_tests, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'WARNING') AS warning,
        count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PASSED') / count(*) * 100 AS pass_rate FROM {RUNS_SQL}"""
)
def obs_suite_status(spark, sf_dir):
    return observe.suite_status(runs(spark, sf_dir))


@query(
    """SELECT * FROM (VALUES ('lineitem', 'l_tax', 'double', NULL, 'REMOVED'), ('lineitem', 'l_linenumber', 'int', 'string', 'RETYPED'),
       ('lineitem', 'l_note', NULL, 'string', 'ADDED')) AS v(table_name, column_name, old_type, new_type, change)"""
)
def obs_schema_drift(spark, sf_dir):
    before = table(spark, sf_dir, "lineitem")
    after = before.drop("l_tax").withColumns(
        {"l_linenumber": F.col("l_linenumber").cast("string"), "l_note": F.col("l_returnflag")}
    )
    old, new = (observe.schema_snapshot(df, "lineitem") for df in (before, after))
    return observe.schema_drift(old, new)


DIMENSION_SQL = f"""(SELECT CASE rule_type WHEN '{checks.NOT_NULL}' THEN 'completeness' WHEN '{checks.UNIQUE}' THEN 'uniqueness'
    WHEN '{checks.BETWEEN}' THEN 'validity' WHEN 'TEMPORAL' THEN 'timeliness' ELSE 'consistency' END AS dimension, avg(pass_rate) * 100 AS score, count(*) AS runs
    FROM {RUNS_SQL} GROUP BY 1)"""


@query(f"SELECT dimension, round(score, 6) AS score, runs FROM {DIMENSION_SQL}")
def obs_dimension_scores(spark, sf_dir):
    return observe.dimension_scores(runs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"SELECT round(avg(score), 6) AS health_score FROM {DIMENSION_SQL}")
def obs_health_score(spark, sf_dir):
    found = observe.health_score(observe.dimension_scores(runs(spark, sf_dir)))
    return found.select(F.round("health_score", 6).alias("health_score"))


@query(
    f"""SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'WARNING') AS warning,
        count(*) FILTER (status = 'FAILED') AS failed
        FROM (SELECT CAST(max(run_at) AS DATE) - CAST(unnest(range(7)) AS INTEGER) AS day FROM {RUNS_SQL})
        LEFT JOIN {RUNS_SQL} ON CAST(run_at AS DATE) = day GROUP BY day"""
)
def obs_run_history(spark, sf_dir):
    return observe.run_history(runs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


SNAPSHOT_SQL = """(SELECT event_type AS table_name, 'mark' AS column_name, CAST(ts AS DATE) AS day, count(*) AS row_count,
    list(DISTINCT user_id % 12) AS marks FROM events GROUP BY ALL)"""


def mark_snapshots(spark, sf_dir) -> DataFrame:
    """Daily profile snapshots of a twelve-valued column per event type."""
    mark = (F.col("user_id") % 12).cast("string")
    per_value = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("table_name"), F.to_date("ts").alias("timestamp"), mark.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return per_value.groupBy("table_name", "timestamp").agg(
        F.lit("mark").alias("column_name"),
        F.sum("count").alias("row_count"),
        F.collect_list(F.struct("value", "count")).alias("top_values"),
    )


@query(
    f"""SELECT table_name, count(*) AS snapshots, min(row_count) AS min_rows, max(row_count) AS max_rows, avg(row_count) AS mean_rows,
        count(*) >= 3 AS reliable FROM {SNAPSHOT_SQL} GROUP BY 1"""
)
def obs_history_bounds(spark, sf_dir):
    return observe.history_bounds(mark_snapshots(spark, sf_dir))


@query(
    f"""SELECT table_name, column_name, CAST(m AS VARCHAR) AS value, count(DISTINCT day) AS seen, snapshots, count(DISTINCT day) = snapshots AS stable
        FROM (SELECT table_name, column_name, day, unnest(marks) AS m FROM {SNAPSHOT_SQL})
        JOIN (SELECT table_name, count(DISTINCT day) AS snapshots FROM {SNAPSHOT_SQL} GROUP BY 1) USING (table_name) GROUP BY table_name, column_name, m, snapshots"""
)
def obs_stable_values(spark, sf_dir):
    return observe.stable_values(mark_snapshots(spark, sf_dir))


@query(
    f"""SELECT table_name, column_name, CAST(day AS VARCHAR) AS day, row_count, row_count - lag(row_count) OVER (PARTITION BY table_name ORDER BY day) AS change
        FROM {SNAPSHOT_SQL}"""
)
def obs_profile_drift(spark, sf_dir):
    found = observe.profile_drift(mark_snapshots(spark, sf_dir), "row_count")
    return found.select("table_name", "column_name", F.col("timestamp").cast("string").alias("day"), "row_count", "change")


DRIFT_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "days"]
DRIFT_CATEGORIES = ["l_returnflag", "l_linenumber"]
SNAPSHOT_SQL = """(SELECT l_orderkey % 3 = 0 AS is_new, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity * 1.05 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 7 > 0 THEN l_extendedprice END AS l_extendedprice, l_discount, CAST(l_linenumber AS DOUBLE) AS days,
    CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linenumber FROM lineitem)"""


def snapshots(spark, sf_dir):
    """Two thirds of the orders, and the rest with somewhat other quantities and flags."""
    is_new = F.col("l_orderkey") % 3 == 0
    rows = table(spark, sf_dir, "lineitem").select(
        is_new.alias("is_new"),
        F.when(is_new, F.col("l_quantity") * 1.05).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_suppkey") % 7 > 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
        F.col("l_linenumber").cast("double").alias("days"),
        F.when(is_new & (F.col("l_linenumber") == 1), "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linenumber",
    )
    return rows.where(~F.col("is_new")), rows.where("is_new")


def drift_sql(bins: int = drift.BINS) -> str:
    numbers = " UNION ALL ".join(
        f"""SELECT 'NUMBER' AS kind, '{c}' AS column_name, is_new, CAST(CASE WHEN x < low THEN -1 WHEN x > high THEN {bins} WHEN high = low THEN 0
            ELSE least(floor((x - low) / (high - low) * {bins}), {bins - 1}) END AS INTEGER)::VARCHAR AS key
            FROM (SELECT is_new, {c} AS x FROM {SNAPSHOT_SQL}), (SELECT min({c}) AS low, max({c}) AS high FROM {SNAPSHOT_SQL} WHERE NOT is_new)
            WHERE x IS NOT NULL"""
        for c in DRIFT_NUMBERS
    )
    categories = " UNION ALL ".join(
        f"SELECT 'CATEGORY', '{c}', is_new, CAST({c} AS VARCHAR) FROM {SNAPSHOT_SQL} WHERE {c} IS NOT NULL" for c in DRIFT_CATEGORIES
    )
    return f"""
    WITH n AS (
      SELECT kind, column_name, key, count(*) FILTER (NOT is_new) AS old, count(*) FILTER (is_new) AS new
      FROM ({numbers} UNION ALL {categories}) GROUP BY ALL),
    t AS (
      SELECT *, sum(old) OVER c AS all_old, sum(new) OVER c AS all_new, count(*) OVER c AS cells,
             sum(old) OVER s AS old_so_far, sum(new) OVER s AS new_so_far
      FROM n WINDOW c AS (PARTITION BY kind, column_name),
        s AS (PARTITION BY kind, column_name ORDER BY CASE WHEN kind = 'NUMBER' THEN CAST(key AS INTEGER) END ROWS UNBOUNDED PRECEDING)),
    p AS (
      SELECT *, (old + 0.5) / (all_old + 0.5 * CASE kind WHEN 'NUMBER' THEN {bins + 2} ELSE cells END) AS p,
             (new + 0.5) / (all_new + 0.5 * CASE kind WHEN 'NUMBER' THEN {bins + 2} ELSE cells END) AS q FROM t),
    f AS (
      SELECT kind, column_name, CAST(any_value(all_old) AS BIGINT) AS rows_old, CAST(any_value(all_new) AS BIGINT) AS rows_new,
             CASE kind WHEN 'NUMBER' THEN max(abs(old_so_far / all_old - new_so_far / all_new)) ELSE sum(abs(old / all_old - new / all_new)) / 2 END AS distance,
             sum((q - p) * ln(q / p)) AS psi
      FROM p GROUP BY kind, column_name)
    SELECT column_name, kind, rows_old, rows_new, round(distance, 6) AS distance, round(psi, 6) AS psi, 
           CASE kind WHEN 'NUMBER' THEN distance > {drift.FACTOR} * sqrt((rows_old + rows_new) / (CAST(rows_old AS DOUBLE) * rows_new)) ELSE psi > 0.1 END AS drifted
    FROM f
    """


@query(drift_sql())
def obs_drift(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    found = drift.drift(old, new, DRIFT_NUMBERS, DRIFT_CATEGORIES)
    return found.drop("critical").withColumns({c: F.round(c, 6) for c in ("distance", "psi")})


def merged_sql() -> str:
    parts = []
    for c, kind in TABLES["orders"].items():
        x = {"int": c, "number": c, "text": f"length({c})", "time": f"epoch({c})"}[kind]
        blanks = f"count(*) FILTER (trim({c}) = '')" if kind == "text" else "0"
        parts.append(
            f"""SELECT '{c}' AS column_name, count(DISTINCT year(o_orderdate))::VARCHAR AS part, count(*) AS rows, count(*) - count({c}) AS nulls,
                CAST({blanks} AS BIGINT) AS blanks, CAST(min({x}) AS DOUBLE) AS low, CAST(max({x}) AS DOUBLE) AS high FROM orders"""
        )
    return " UNION ALL ".join(parts)


@query(merged_sql())
def obs_merged_states(spark, sf_dir):
    """States of the orders of each year, merged."""
    orders = table(spark, sf_dir, "orders")
    years = [r[0] for r in orders.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]
    parts = [states.state(orders.where(F.year("o_orderdate") == y), "orders", str(y)) for y in years]
    found = states.read(states.merged(reduce(DataFrame.unionByName, parts)))
    return found.select("column_name", "part", "rows", "nulls", "blanks", "low", "high")


@query(
    """
    WITH days AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS rows, max(ts) AS newest FROM events WHERE ts IS NOT NULL GROUP BY ALL)
    SELECT CAST(day AS VARCHAR) AS day, event_type, rows, CAST(newest AS VARCHAR) AS newest FROM days
    WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
    """
)
def obs_stream_volume(spark, sf_dir):
    """Daily volumes of the events as a stream: the days that the watermark has passed."""
    folder = shared_folder(spark)
    batch = table(spark, sf_dir, "events")
    # a pattern, as a stream reads folders, and the table may be a file or a folder
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parque[t]")
    volume.write_daily_volume(stream, "ts", f"{folder}/days", f"{folder}/checkpoint", ["event_type"])
    days = spark.read.schema("day date, event_type string, rows bigint, first_at timestamp, newest timestamp").parquet(f"{folder}/days")
    text = lambda c: F.col(c).cast("string").alias(c)
    return days.select(text("day"), "event_type", "rows", text("newest"))
