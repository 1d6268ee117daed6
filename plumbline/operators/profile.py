"""Column profiles (PROF-*): one row per column of a table.

One global aggregate measures counts, ranges, lengths and moments. Beside it another sketches
the size of each column (apart, as sketches would keep the first from compiling to one loop);
both give one row per column, which comes to the driver. Then distinct values are counted,
with one shuffle per physical type, each branch reading only its own columns. Columns the
sketch found small are counted value by value, which also gives their top values; map-side
combine shrinks them to a few rows per task. The others are only counted, long texts by their
digest, so no group and no broadcast grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import naming, numbers
from plumbline.local import local_frame, side_by_side
from plumbline.operators.skew import text_key

# Columns per global aggregate: keeps generated code within the size the JIT compiles.
COLUMNS_PER_AGGREGATE = 16
# Distinct values that a task counts, of columns with one for every few rows.
VALUES_PER_TASK = 250_000
ROWS_PER_VALUE = 8
BINS = 5


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def _countable_type(data_type: T.DataType) -> str | None:
    """The type a column's values are counted in; None for nested and binary columns."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if _is_text(data_type):
        return "string"
    if isinstance(
        data_type,
        (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType),
    ):
        return data_type.simpleString()
    return None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present(field: T.StructField, blank_is_null: bool = True) -> str:
    """SQL of the column with blank text taken as null (PROF-2)."""
    if blank_is_null and _is_text(field.dataType):
        return f"nullif({quoted(field.name)}, '')"
    return quoted(field.name)


def number_of(field: T.StructField) -> str:
    """SQL of a numeric column with NaN taken as no number."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({quoted(field.name)}, NULL)"
    return quoted(field.name)


def value_frequencies(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    blank_is_null: bool = True,
    digest: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """(column_name, value, n) for every distinct value of the columns.

    With ``digest``, long texts appear as their digest. With ``tasks``, values are dealt to so many
    tasks before they are counted: a count on the side of the scan saves little where most values
    are different, and would hold all of a file's in one task.
    """
    wanted = list(columns) if columns is not None else df.columns
    by_type: dict[str, list[T.StructField]] = {}
    for name in wanted:
        field = df.schema[name]
        kind = _countable_type(field.dataType)
        if kind is not None:
            by_type.setdefault(kind, []).append(field)
    branches = []
    for kind, fields in by_type.items():
        cols = [
            f"CAST({present(f, blank_is_null)} AS {kind}) AS {quoted(f.name)}" for f in fields
        ]
        long = (
            df.selectExpr(*cols)
            .unpivot([], [quoted(f.name) for f in fields], "column_name", "value")
            .where("value IS NOT NULL")
        )
        if kind == "string" and digest:
            long = long.withColumn("value", text_key(F.col("value")))
        if tasks:
            long = long.repartition(tasks, "column_name", "value")
        branches.append(
            long.groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .selectExpr("column_name", "CAST(value AS string) AS value", "n")
        )
    if not branches:
        return df.sparkSession.createDataFrame(
            [], "column_name string, value string, n bigint"
        )
    return _union(branches)


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    """PROF-4: (column_name, distinct_count)."""
    return frequencies.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count")
    )


def top_values(frequencies: DataFrame) -> DataFrame:
    """PROF-9: (column_name, distinct_count, ranked), highest count first, then by value.

    Only for columns known to have few distinct values: each group is gathered whole.
    """
    ranked = F.struct((-F.col("n")).alias("rank"), F.col("value"))
    return frequencies.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.sort_array(F.collect_list(ranked)).alias("ranked"),
    )


def _is_small(estimate: int) -> bool:
    """True for every column of up to MAX_SET_SIZE distinct values, and few others.

    A sketch that small still lists its values, so twice the size misses none.
    """
    return 0 < estimate <= 2 * naming.MAX_SET_SIZE


def _simple_metrics(
    df: DataFrame, fields: list[T.StructField], blank_is_null: bool
) -> DataFrame:
    """PROF-1, 2, 7, 8, 12: one global aggregate, then one row per column."""
    aggregates, rows = ["count(1) AS rows"], []
    for i, field in enumerate(fields):
        v, cls = present(field, blank_is_null), naming.type_class(field.dataType)
        aggregates.append(f"count({v}) AS non_null_{i}")
        got = dict.fromkeys(MEASURES, "NULL")
        if cls in ("INTEGER", "NUMBER"):
            moments = {"min_num": "min", "max_num": "max", "mean": "avg", "stddev": "stddev"}
            for key, fn in moments.items():
                aggregates.append(f"CAST({fn}({number_of(field)}) AS double) AS {key}_{i}")
                got[key] = f"{key}_{i}"
        elif cls in ("DATE", "DATETIME"):
            for key, fn in (("min_str", "min"), ("max_str", "max")):
                aggregates.append(f"CAST({fn}({v}) AS string) AS {key}_{i}")
                got[key] = f"{key}_{i}"
        elif cls == "STRING":
            for key, fn in (("min_length", "min"), ("max_length", "max")):
                aggregates.append(f"{fn}(length({v})) AS {key}_{i}")
                got[key] = f"{key}_{i}"
        measures = ", ".join(f"'{k}', CAST({got[k]} AS {t})" for k, t in MEASURES.items())
        name = field.name.replace("\\", "\\\\").replace("'", "\\'")
        rows.append(
            f"named_struct('column_name', '{name}', 'row_count', rows, "
            f"'non_null_count', non_null_{i}, {measures})"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


MEASURES = {
    "min_num": "double", "max_num": "double", "min_str": "string", "max_str": "string",
    "min_length": "int", "max_length": "int", "mean": "double", "stddev": "double",
}


def _sizes(
    df: DataFrame, fields: list[T.StructField], blank_is_null: bool, lg_k: int = 12
) -> tuple[int, dict[str, int]]:
    """PROF-5: the rows and the approximate distinct count of each column, from one global aggregate.

    A sketch of 2**12 registers errs by 1.6 % and is all but exact for a few dozen values.
    """
    sketches = []
    for i, f in enumerate(fields):
        v = present(f, blank_is_null)
        hashed = f"if({v} IS NULL, NULL, xxhash64({v}))"
        sketches.append(f"hll_sketch_estimate(hll_sketch_agg({hashed}, {lg_k})) AS s{i}")
    total, *found = df.selectExpr("count(1) AS rows", *sketches).first()
    return total, {f.name: size for f, size in zip(fields, found)}


RANKED_TYPE = "array<struct<rank:bigint,value:string>>"


def _in_steps(fields: list[T.StructField]) -> list[list[T.StructField]]:
    step = COLUMNS_PER_AGGREGATE
    return [fields[i : i + step] for i in range(0, len(fields), step)]


def profile(
    df: DataFrame,
    table_name: str,
    *,
    primary_keys: Iterable[str] = (),
    foreign_keys: Iterable[str] = (),
    **options,
) -> DataFrame:
    """PROF-1..9, 12, 13: the profile DataFrame of one table; options as profile_tables."""
    return profile_tables(
        {table_name: df}, {table_name: primary_keys}, {table_name: foreign_keys}, **options
    )


def profile_tables(
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Iterable[str]] | None = None,
    foreign_keys: Mapping[str, Iterable[str]] | None = None,
    *,
    blank_is_null: bool = True,
    approx: bool = False,
    lg_k: int = 12,
) -> DataFrame:
    """PROF-20: several tables in one profile DataFrame, profiled side by side.

    The result has one row per column and is local, so what follows never profiles again.

    ``approx=True`` keeps the sketched counts for large columns, so that no high-cardinality
    value is ever shuffled (PROF-5). Small columns stay exact.
    """
    if not tables:
        raise ValueError("no tables to profile")
    keys, foreign = primary_keys or {}, foreign_keys or {}

    def one(item: tuple[str, DataFrame]) -> list[dict]:
        name, df = item
        return _profile_rows(
            df, name, set(keys.get(name, ())), set(foreign.get(name, ())),
            blank_is_null, approx, lg_k,
        )

    spark = next(iter(tables.values())).sparkSession
    with_columns = [(n, df) for n, df in tables.items() if df.columns]
    rows = [r for found in side_by_side(one, with_columns) for r in found]
    return local_frame(spark, rows, schemas.PROFILE)


def _profile_rows(
    df: DataFrame,
    table_name: str,
    primary: set[str],
    foreign: set[str],
    blank_is_null: bool,
    approx: bool,
    lg_k: int,
) -> list[dict]:
    fields = list(df.schema.fields)
    countable = {f.name for f in fields if _countable_type(f.dataType)}
    sized = [f for f in fields if f.name in countable]

    def simple() -> dict[str, Row]:
        found = _union(_simple_metrics(df, part, blank_is_null) for part in _in_steps(fields))
        return {r["column_name"]: r for r in found.collect()}

    def distinct_values() -> tuple[dict[str, int], dict[str, Row]]:
        sizes: dict[str, int] = {}
        total = 0
        for total, found in side_by_side(lambda p: _sizes(df, p, blank_is_null, lg_k), _in_steps(sized)):
            sizes.update(found)
        small = sorted(c for c, size in sizes.items() if _is_small(size))
        large = [f.name for f in fields if f.name in countable and f.name not in small]
        frames = []
        if small:
            frames.append(top_values(value_frequencies(df, small, blank_is_null)))
        dense = [c for c in large if sizes[c] * ROWS_PER_VALUE >= total]
        tasks = math.ceil(sum(sizes[c] for c in dense) / VALUES_PER_TASK)
        if tasks <= 1:
            parts = [(large, None)]
        else:
            parts = [(dense, tasks), ([c for c in large if c not in dense], None)]
        for names, dealt in parts:
            if names and not approx:
                keyed = value_frequencies(df, names, blank_is_null, digest=True, tasks=dealt)
                frames.append(
                    distinct_counts(keyed).selectExpr("*", f"CAST(NULL AS {RANKED_TYPE}) AS ranked")
                )
        rows = _union(frames).collect() if frames else []
        return sizes, {r["column_name"]: r for r in rows}

    measured, (sizes, exact) = side_by_side(lambda job: job(), [simple, distinct_values])
    share = lambda part, whole: part / whole if whole else 0.0
    rows = []
    for i, f in enumerate(fields):
        m, e = measured[f.name], exact.get(f.name)
        total, non_null = m["row_count"], m["non_null_count"]
        distinct = e["distinct_count"] if e else sizes.get(f.name, 0) if approx else 0
        ranked = (e["ranked"] if e else None) or []
        if distinct > naming.MAX_SET_SIZE:
            ranked = []
        known = f.name in countable
        rows.append(
            {
                "table_name": table_name,
                "ordinal": i,
                "column_name": f.name,
                "data_type": f.dataType.simpleString(),
                "type_class": naming.type_class(f.dataType),
                "is_primary_key": f.name in primary,
                "is_foreign_key": f.name in foreign,
                "nullable": non_null < total or f.name not in primary,
                "row_count": total,
                "null_count": total - non_null,
                "null_ratio": share(total - non_null, total),
                "distinct_count": distinct if known else None,
                "distinct_ratio": share(distinct, total) if known else None,
                "distinct_ratio_nonnull": share(distinct, non_null) if known else None,
                "top_values": [
                    {"value": v["value"], "count": -v["rank"], "percentage": -v["rank"] * 100.0 / total}
                    for v in ranked
                ],
                **{k: m[k] for k in MEASURES},
            }
        )
    return rows


def histogram(
    df: DataFrame, columns: Iterable[str] | None = None, bins: int = BINS
) -> DataFrame:
    """PROF-10: equal-width bins of numeric columns with labels, counts and percents.

    Columns with a single value have no bins. Empty bins are reported with count 0. The
    bounds of each column come to the driver; the bins are then counted in one scan without
    a shuffle of rows.
    """
    names = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
    ]
    ends = df.selectExpr(
        "count(1)",
        *[
            f"CAST({fn}({number_of(df.schema[c])}) AS double)"
            for c in names
            for fn in ("min", "max")
        ],
    ).first()
    total, aggregates, rows = ends[0], [], []
    for i, c in enumerate(names):
        low, high = ends[1 + 2 * i], ends[2 + 2 * i]
        if low is None or not high > low or not math.isfinite(high - low):
            continue
        step = (high - low) / bins
        place = F.floor((F.expr(number_of(df.schema[c])) - F.lit(low)) / F.lit(step))
        place = F.when(place >= bins, bins - 1).otherwise(place)
        for b in range(bins):
            aggregates.append(F.count_if(place == b).alias(f"n_{i}_{b}"))
            rows.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(b).alias("bin"),
                    F.lit(low + b * step).alias("low"),
                    F.lit(low + (b + 1) * step).alias("high"),
                    F.col(f"n_{i}_{b}").alias("count"),
                )
            )
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bin int, low double, high double, label string, "
            "count bigint, percentage double",
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows))).select(
        "column_name",
        "bin",
        "low",
        "high",
        numbers.range_label(F.col("low"), F.col("high")).alias("label"),
        "count",
        numbers.percent(F.col("count"), F.lit(total)).alias("percentage"),
    )


def category_distribution(profiled: DataFrame) -> DataFrame:
    """PROF-11: one (label, count, percent) row per top value."""
    return profiled.select(
        "table_name", "column_name", F.inline("top_values").alias("label", "count", "percentage")
    ).withColumn("percentage", F.round("percentage", 1))


def semantic_kinds(df: DataFrame, blank_is_null: bool = True) -> DataFrame:
    """PROF-14: money, count, time or text, from values and from keywords in the name."""
    fields = df.schema.fields
    parts = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for i, field in enumerate(fields):
        v = F.expr(present(field, blank_is_null))
        parts.append(F.count(v).alias(f"non_null_{i}"))
        parts.append(F.count(numbers.parse_number(v, field.dataType)).alias(f"numeric_{i}"))
        name = field.name.lower()
        all_numeric = F.col(f"numeric_{i}") == F.col(f"non_null_{i}")
        cls = naming.type_class(field.dataType)
        if cls == "NUMBER":
            kind = F.lit("money")
        elif cls == "INTEGER":
            kind = F.lit("count")
        elif any(w in name for w in naming.RECORD_MONEY_WORDS):
            kind = F.when(all_numeric, "money").otherwise("text")
        elif name == naming.RECORD_COUNT_NAME:
            kind = F.when(all_numeric, "count").otherwise("text")
        elif cls in ("DATE", "DATETIME") or any(
            w in name for w in naming.RECORD_TIME_WORDS
        ):
            kind = F.lit("time")
        else:
            kind = F.lit("text")
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                numbers.ratio(F.col(f"numeric_{i}"), F.col(f"non_null_{i}")).alias("numeric_share"),
                kind.alias("kind"),
            )
        )
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def supplied(rows: DataFrame) -> DataFrame:
    """A profile measured elsewhere, in the shape of the profile schema.

    Needs table_name, column_name and data_type; what is not given is derived or null. Types
    are judged by their names. The row count of a table is that of its fullest column
    (PROF-16), and a column without counts has row count 0, so that no rule is drawn from it
    for want of nulls.
    """
    for f in schemas.PROFILE.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    per_table = rows.groupBy("table_name").agg(F.max("row_count").alias("_rows"))
    total = F.when(F.col("null_count").isNotNull(), F.coalesce("row_count", "_rows"))
    total = F.coalesce(total, F.lit(0)).cast("bigint")
    is_pk = F.coalesce("is_primary_key", F.lit(False))
    nulls = F.coalesce("null_count", F.lit(0)).cast("bigint")
    derived = {
        "type_class": F.coalesce("type_class", naming.type_class_of_text(F.col("data_type"))),
        "is_primary_key": is_pk,
        "is_foreign_key": F.coalesce("is_foreign_key", F.lit(False)),
        "nullable": (nulls > 0) | ~is_pk,
        "row_count": total,
        "null_count": nulls,
        "null_ratio": F.coalesce("null_ratio", numbers.ratio(nulls, total)),
        "distinct_ratio": F.coalesce("distinct_ratio", numbers.ratio(F.col("distinct_count"), total)),
        "top_values": F.coalesce("top_values", F.array().cast(schemas.TOP_VALUES)),
    }
    return rows.join(per_table, "table_name").select(
        *[
            derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in schemas.PROFILE.fields
        ]
    )


def latest_profiles(history: DataFrame) -> DataFrame:
    """PROF-15: the newest profile of every (table, column).

    Of profiles at one instant, the one that sorts last as JSON counts.
    """
    rest = [c for c in history.columns if c not in ("table_name", "column_name")]
    order = F.struct("timestamp", F.to_json(F.struct(*rest)))
    newest = history.groupBy("table_name", "column_name").agg(
        F.max_by(F.struct(*rest), order).alias("newest")
    )
    return newest.select("table_name", "column_name", "newest.*")


def table_metrics(latest: DataFrame) -> DataFrame:
    """PROF-16, 17: row count and profile time per table from its column profiles.

    A column missing either count is skipped, as null + x is null.
    """
    return latest.groupBy("table_name").agg(
        F.coalesce(F.max(F.col("values_count") + F.col("null_count")), F.lit(0)).alias("row_count"),
        F.max("timestamp").alias("profiled_at"),
    )
