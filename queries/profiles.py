"""PROF-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile
from queries.base import CLASS, TABLES, all_tables, query, table


def profile_sql(tables: dict[str, dict[str, str]] = TABLES, source: dict[str, str] | None = None) -> str:
    """One SELECT per column of the tables."""
    parts = []
    for t, columns in tables.items():
        frm = (source or {}).get(t, t)
        for i, (c, kind) in enumerate(columns.items()):
            v = f"NULLIF({c}, '')" if kind == "text" else c
            num, text, time = kind in ("int", "number"), kind == "text", kind == "time"
            distinct = "CAST(NULL AS BIGINT)" if kind == "nested" else f"count(DISTINCT {v})"
            null_d, null_i = "CAST(NULL AS DOUBLE)", "CAST(NULL AS INTEGER)"
            null_s = "CAST(NULL AS VARCHAR)"
            parts.append(
                f"""SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name,
                '{CLASS[kind]}' AS type_class, count(*) AS row_count,
                count(*) - count({v}) AS null_count,
                {distinct} AS distinct_count, count({v}) AS non_null,
                {f'CAST(min({v}) AS DOUBLE)' if num else null_d} AS min_num,
                {f'CAST(max({v}) AS DOUBLE)' if num else null_d} AS max_num,
                {f'CAST(min({v}) AS VARCHAR)' if time else null_s} AS min_str,
                {f'CAST(max({v}) AS VARCHAR)' if time else null_s} AS max_str,
                {f'CAST(min(length({v})) AS INTEGER)' if text else null_i} AS min_length,
                {f'CAST(max(length({v})) AS INTEGER)' if text else null_i} AS max_length
                FROM {frm}"""
            )
    return " UNION ALL ".join(parts)


RATIOS = """
    CASE WHEN row_count > 0 THEN null_count / row_count ELSE 0 END AS null_ratio,
    CASE WHEN type_class = 'OTHER' THEN NULL WHEN row_count > 0 THEN distinct_count / row_count ELSE 0 END AS distinct_ratio,
    CASE WHEN type_class = 'OTHER' THEN NULL WHEN non_null > 0 THEN distinct_count / non_null ELSE 0 END AS distinct_ratio_nonnull
"""
METRICS = [
    "table_name", "ordinal", "column_name", "type_class", "row_count", "null_count",
    "null_ratio", "distinct_count", "distinct_ratio", "distinct_ratio_nonnull",
    "min_num", "max_num", "min_str", "max_str", "min_length", "max_length",
]
PLAIN = ", ".join(m for m in METRICS if not m.endswith(("ratio", "nonnull")))


@query(f"SELECT {PLAIN}, {RATIOS} FROM ({profile_sql()})")
def profile_all_tables(spark, sf_dir):
    return profile.profile_tables(all_tables(spark, sf_dir)).select(*METRICS)


SPARSE = """(SELECT NULLIF(l_linenumber, 3) AS line, CASE WHEN l_linenumber = 4 THEN '' ELSE l_returnflag END AS flag,
             NULLIF(l_quantity, 7) AS quantity, CASE WHEN l_tax > 0.04 THEN NULL ELSE l_shipdate END AS shipped FROM lineitem)"""
SPARSE_COLUMNS = {"sparse": {"line": "int", "flag": "text", "quantity": "number", "shipped": "time"}}


@query(
    f"SELECT {PLAIN}, {RATIOS} FROM ({profile_sql(SPARSE_COLUMNS, {'sparse': SPARSE})})"
)
def profile_nulls_and_blanks(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_linenumber", F.lit(3)).alias("line"),
        F.when(F.col("l_linenumber") == 4, "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.nullif("l_quantity", F.lit(7.0)).alias("quantity"),
        F.when(F.col("l_tax") <= 0.04, F.col("l_shipdate")).alias("shipped"),
    )
    return profile.profile(sparse, "sparse").select(*METRICS)


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
            CAST(round(avg({c}), 3) AS DOUBLE) AS mean, CAST(round(stddev_samp({c}), 3) AS DOUBLE) AS stddev FROM {t}"""
        for t in ("lineitem", "orders", "events", "part")
        for c, kind in TABLES[t].items()
        if kind in ("int", "number")
    )
)
def profile_moments(spark, sf_dir):
    chosen = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "events", "part")}
    return (
        profile.profile_tables(chosen, approx=True)
        .where(F.col("mean").isNotNull())
        .select(
            "table_name", "column_name",
            F.round("mean", 3).alias("mean"), F.round("stddev", 3).alias("stddev"),
        )
    )


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, TRUE AS close, count(*) AS row_count FROM {t}"
        for t in ("lineitem", "events")
        for c in TABLES[t]
    )
)
def profile_approx(spark, sf_dir):
    """Approximate distinct counts lie within ten percent of the exact ones."""
    chosen = {t: table(spark, sf_dir, t) for t in ("lineitem", "events")}
    near = profile.profile_tables(chosen, approx=True).select(
        "column_name", "row_count", F.col("distinct_count").alias("near")
    )
    exact = profile.profile_tables(chosen).select("column_name", "distinct_count")
    gap = F.abs(F.col("near") - F.col("distinct_count"))
    return near.join(exact, "column_name").select(
        "column_name", (gap <= F.col("distinct_count") * 0.1).alias("close"), "row_count"
    )


def top_sql(percent: str) -> str:
    parts = []
    for t, columns in TABLES.items():
        for c, kind in columns.items():
            if kind != "nested":
                v = f"NULLIF({c}, '')" if kind == "text" else c
                parts.append(
                    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({v} AS VARCHAR) AS value, count(*) AS n,
                    (SELECT count(*) FROM {t}) AS rows, (SELECT count(DISTINCT {v}) FROM {t}) AS d
                    FROM {t} WHERE {v} IS NOT NULL GROUP BY {v}"""
                )
    return f"""SELECT table_name, column_name, value, n AS count, {percent} AS percentage
               FROM ({' UNION ALL '.join(parts)}) WHERE d <= 20"""


@query(top_sql("n * 100.0::DOUBLE / rows"))
def top_values(spark, sf_dir):
    return profile.profile_tables(all_tables(spark, sf_dir)).select(
        "table_name", "column_name", F.inline("top_values")
    )


@query(
    f"""SELECT table_name, column_name, value AS label, count, percentage
        FROM ({top_sql('round(n * 100.0::DOUBLE / rows, 1)')}) WHERE table_name IN ('orders', 'part')"""
)
def category_distribution(spark, sf_dir):
    chosen = {t: table(spark, sf_dir, t) for t in ("orders", "part")}
    return profile.category_distribution(profile.profile_tables(chosen))


def histogram_sql(t: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""
            SELECT '{c}' AS column_name, s.bin, lo + s.bin * step AS low, lo + (s.bin + 1) * step AS high,
                   COALESCE(n, 0) AS count, COALESCE(n, 0) * 100.0::DOUBLE / rows AS percentage
            FROM (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / 5 AS step, count(*) AS rows FROM {t}) b
            CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS bin) s
            LEFT JOIN (
              SELECT CAST(least(floor(({c} - lo) / step), 4) AS INTEGER) AS bin, count(*) AS n
              FROM {t}, (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / 5 AS step FROM {t})
              GROUP BY 1) h ON h.bin = s.bin"""
        )
    return " UNION ALL ".join(parts)


HISTOGRAM_COLUMNS = [c for c, kind in TABLES["lineitem"].items() if kind in ("int", "number")]


@query(histogram_sql("lineitem", HISTOGRAM_COLUMNS))
def histogram_5(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem")).drop("label")


@query(
    """
    SELECT * FROM (VALUES ('dispenses', 1.0, 'count'), ('total_cost', 1.0, 'money'),
      ('order_date', 0.0, 'time'), ('plate', 0.0, 'text'), ('o_custkey', 1.0, 'count'),
      ('o_totalprice', 1.0, 'money')) AS v(column_name, numeric_share, kind)
    UNION ALL
    SELECT 'mixed_cost', count(*) FILTER (o_orderstatus <> 'O') / count(*), 'text' FROM orders
    """
)
def semantic_kinds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    shaped = orders.select(
        F.col("o_orderkey").cast("string").alias("dispenses"),
        price.alias("total_cost"),
        F.col("o_orderdate").cast("string").alias("order_date"),
        F.col("o_orderstatus").alias("plate"),
        "o_custkey",
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "O", "n/a").otherwise(price).alias("mixed_cost"),
    )
    return profile.semantic_kinds(shaped)


SNAPSHOTS_SQL = """
    SELECT event_type AS table_name, c AS column_name, day, count(v) AS values_count,
           CASE WHEN c = 'user_id' AND dayofmonth(day) % 5 = 0 THEN NULL ELSE count(*) - count(v) END AS null_count
    FROM (SELECT event_type, 'value' AS c, CAST(ts AS DATE) AS day, NULLIF(floor(value), 3) AS v FROM events
          UNION ALL SELECT event_type, 'user_id', CAST(ts AS DATE), NULLIF(user_id, 5) FROM events)
    GROUP BY event_type, c, day
"""


def snapshots(spark, sf_dir):
    """A profile history: one snapshot per event type, column and day."""
    day = F.to_date("ts").alias("day")
    both = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), v.alias("v"))
            for c, v in {
                "value": F.nullif(F.floor("value"), F.lit(3)),
                "user_id": F.nullif("user_id", F.lit(5)),
            }.items()
        ]
    )
    per_day = (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("table_name"), day, F.inline(both))
        .groupBy("table_name", "column_name", "day")
        .agg(F.count("v").alias("values_count"), F.count_if(F.col("v").isNull()).alias("null_count"))
    )
    skipped = (F.col("column_name") == "user_id") & (F.dayofmonth("day") % 5 == 0)
    return per_day.withColumn(
        "null_count", F.when(~skipped, F.col("null_count"))
    ).withColumnRenamed("day", "timestamp")


@query(
    f"""SELECT table_name, column_name, CAST(day AS VARCHAR) AS day, values_count, null_count
        FROM ({SNAPSHOTS_SQL}) QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY day DESC) = 1"""
)
def latest_profiles(spark, sf_dir):
    return profile.latest_profiles(snapshots(spark, sf_dir)).select(
        "table_name", "column_name", F.col("timestamp").cast("string").alias("day"),
        "values_count", "null_count",
    )


@query(
    f"""SELECT table_name, COALESCE(max(values_count + null_count), 0) AS row_count, CAST(max(day) AS VARCHAR) AS profiled_at
        FROM ({SNAPSHOTS_SQL}) GROUP BY table_name"""
)
def table_metrics(spark, sf_dir):
    return profile.table_metrics(snapshots(spark, sf_dir)).withColumn(
        "profiled_at", F.col("profiled_at").cast("string")
    )
