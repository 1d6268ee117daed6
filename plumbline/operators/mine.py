"""Multi-column rules mined from the data (REC-9..15).

Candidate columns come from the profile, which is schema-sized; evidence comes from the rows.
All counters of a kind share one scan, in batches, so the work grows with rows times column
pairs and never with pairs of rows. Every mined rule carries its support and confidence and
needs a review.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import naming
from plumbline.local import local_frame
from plumbline.operators import checks, recommend
from plumbline.operators.predicates import column

# Executors need no copy of this module for the functions that run there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Name words that pair up, and words of status-like and dependent columns.
TIME_WORD_PAIRS = [
    ("start", "end"), ("from", "to"), ("created", "completed"), ("order", "delivery"),
    ("start", "stop"), ("admission", "discharge"), ("birth", "death"),
]
STATUS_WORDS = ["status", "type", "category", "flag"]
DEPENDENT_WORDS = ["result", "date", "value", "time", "_at"]
MAX_GROUP = 4

# Fewer rows than this behind a mined rule make it a warning.
SMALL_SUPPORT = 30
AGGREGATES_PER_SCAN = 200
# From here on, pairs of numbers are counted in numpy: Spark would scan the table for each third of it.
ARROW_PAIRS = 200
# A grouping id is a 64-bit number.
MAX_GROUPING_SETS = 32

Pair = tuple[str, str]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# REC-9 ------------------------------------------------------------------------------------


def column_groups(profile: DataFrame) -> DataFrame:
    """REC-9: column groups that may hold a multi-column rule, at most MAX_GROUP columns.

    Works on the profile alone: its rows are columns of tables, not data. More columns than
    fit in one group make more groups.
    """
    name = F.lower("column_name")
    usable = profile.where(
        ~F.col("is_primary_key")
        & ~F.col("is_foreign_key")
        & ~naming.is_id_name(F.col("column_name"))
        & ~naming.name_has(F.col("column_name"), naming.IDENTIFIER_WORDS)
        & ~naming.is_pii_name(F.col("column_name"))
    )
    cls = F.col("type_class")
    times = usable.where(naming.is_temporal_class(cls))
    words = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), F.lit(w).alias("word"))
            for i, p in enumerate(TIME_WORD_PAIRS)
            for side, w in enumerate(p)
        ]
    )
    sided = (
        times.withColumn("w", F.explode(words))
        .where(name.contains(F.col("w.word")))
        .select(
            "table_name",
            "column_name",
            F.col("w.pair").alias("pair"),
            F.col("w.side").alias("side"),
            F.replace(name, F.col("w.word"), F.lit("")).alias("stem"),
        )
    )
    first = sided.where("side = 0").withColumnRenamed("column_name", "a")
    second = sided.where("side = 1").withColumnRenamed("column_name", "b")
    time_pairs = (
        first.drop("side")
        .join(second.drop("side"), ["table_name", "pair", "stem"])
        .select("table_name", "a", "b")
        .distinct()
        .select(
            "table_name",
            F.lit("TEMPORAL").alias("rule_type"),
            F.array("a", "b").alias("target_columns"),
            F.lit(0.9).alias("confidence"),
            F.lit("time columns with paired names").alias("reason"),
        )
    )
    numbers = usable.where(naming.is_numeric_class(cls)).select(
        "table_name", "type_class", "ordinal", "column_name"
    )
    right = numbers.select(
        "table_name",
        "type_class",
        F.col("ordinal").alias("ordinal_b"),
        F.col("column_name").alias("b"),
    )
    number_pairs = (
        numbers.join(right, ["table_name", "type_class"])
        .where(F.col("ordinal") < F.col("ordinal_b"))
        .select(
            "table_name",
            F.lit("CROSS_COLUMN").alias("rule_type"),
            F.array("column_name", "b").alias("target_columns"),
            F.lit(0.7).alias("confidence"),
            F.lit("numeric columns of one type").alias("reason"),
        )
    )
    status = usable.where(
        naming.name_has(F.col("column_name"), STATUS_WORDS)
        & F.col("distinct_count").between(2, naming.MAX_SET_SIZE)
    ).select("table_name", F.col("column_name").alias("status"))
    # The columns that may be empty, best names first, in parts that fit beside the status.
    size = MAX_GROUP - 1
    late = ~naming.name_has(F.col("column_name"), DEPENDENT_WORDS)
    names = F.array_sort(F.collect_list(F.struct(late.alias("late"), "ordinal", "column_name")))
    empty = (
        usable.where((F.col("null_count") > 0) & (F.col("null_count") < F.col("row_count")))
        .groupBy("table_name")
        .agg(names["column_name"].alias("names"))
    )
    conditional = (
        status.join(empty, "table_name")
        .withColumn("names", F.array_except("names", F.array("status")))
        .where(F.size("names") > 0)
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.size("names"), F.lit(size))))
        .select(
            "table_name",
            F.lit("CONDITIONAL_DEPENDENCY").alias("rule_type"),
            F.concat(F.array("status"), F.slice("names", F.col("start"), F.lit(size))).alias(
                "target_columns"
            ),
            F.lit(0.8).alias("confidence"),
            F.lit("status-like column and columns that may be empty").alias("reason"),
        )
    )
    return _union([time_pairs, number_pairs, conditional])


def pairs_of(groups: DataFrame, table_name: str, rule_type: str) -> list[Pair]:
    """Column pairs of one table, read on the driver: schema-sized."""
    rows = groups.where(
        (F.col("table_name") == table_name) & (F.col("rule_type") == rule_type)
    ).collect()
    return sorted({p for r in rows for p in combinations(r["target_columns"], 2)})


# Evidence ---------------------------------------------------------------------------------


def _counters(df: DataFrame, items: Sequence[dict[str, Column]]) -> DataFrame:
    """One row per item: its plain Columns as they are, its aggregates counted in one scan.

    Keys that start with ``=`` are literals of the item; the others are aggregates.
    """
    width = max(1, AGGREGATES_PER_SCAN // max(len(i) for i in items))
    frames = []
    for start in range(0, len(items), width):
        batch = items[start : start + width]
        aggregates, rows = [], []
        for i, item in enumerate(batch):
            fields = []
            for key, expr in item.items():
                if key.startswith("="):
                    fields.append(expr.alias(key[1:]))
                else:
                    aggregates.append(expr.alias(f"{key}_{i}"))
                    fields.append(F.col(f"{key}_{i}").alias(key))
            rows.append(F.struct(*fields))
        frames.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    return _union(frames)


# What numpy compares exactly: integers with their range, and floating point numbers.
_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_FLOATS = (T.FloatType, T.DoubleType)


def _comparable(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (*_INTEGERS, *_FLOATS))


def _in_one_scan(df: DataFrame, columns: Sequence[str], n_items: int, n_counts: int, count) -> DataFrame:
    """(item, counts) summed over one scan of the columns, whatever the number of items.

    Each task adds up ``count(values, valid)``, an array of n_items x n_counts for a batch of
    rows, and returns one row per item; these are then summed.
    """
    def plain(name: str) -> Column:
        c = column(name)
        return c.cast("double") if isinstance(df.schema[name].dataType, T.FloatType) else c

    def add(batches):
        total = np.zeros((n_items, n_counts), dtype=np.int64)
        for batch in batches:
            valid = [~np.asarray(c.is_null()) for c in batch.columns]
            values = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns]
            total += count([v.astype(np.int64) if v.dtype.kind == "i" else v for v in values], valid)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_items)), *map(pa.array, total.T)],
            names=["item", *(f"n{k}" for k in range(n_counts))],
        )

    fields = ", ".join(f"n{k} bigint" for k in range(n_counts))
    rows = df.select(*(plain(c).alias(f"c{i}") for i, c in enumerate(columns)))
    return rows.mapInArrow(add, f"item bigint, {fields}").groupBy("item").agg(
        *(F.sum(f"n{k}").alias(f"n{k}") for k in range(n_counts))
    )


def _named(counted: DataFrame, items: Sequence[dict], names: Sequence[str]) -> DataFrame:
    """Counts beside what they are of; items are schema-sized."""
    text = {k: schemas.S for k in items[0]}
    listed = local_frame(
        counted.sparkSession, ({"item": i, **r} for i, r in enumerate(items)), schemas.struct(item=schemas.L, **text)
    )
    counts = [F.col(f"n{k}").alias(n) for k, n in enumerate(names)]
    return listed.join(counted, "item").select(*text, *counts)


def _orders(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Less, equal and greater, NaN equal to itself and above all numbers."""
    less, equal = x < y, x == y
    odd_x = np.isnan(x) if x.dtype.kind == "f" else np.zeros(len(x), bool)
    odd_y = np.isnan(y) if y.dtype.kind == "f" else np.zeros(len(y), bool)
    less, equal = less | (odd_y & ~odd_x), equal | (odd_x & odd_y)
    return less, equal, ~less & ~equal


def order_support(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """REC-10, 12: rows where a < b, a = b, a > b, for every pair.

    Spark's aggregates count them, a scan for every AGGREGATES_PER_SCAN counters, and compare
    values as Spark does: times without a zone as they are written, whatever the session's zone.
    Above ARROW_PAIRS pairs of integers or floating point numbers, one scan in numpy counts those.
    """
    plain = [p for p in pairs if all(_comparable(df, c) for c in p)]
    if len(plain) <= ARROW_PAIRS:
        plain = []
    frames = []
    if plain:
        columns = list(dict.fromkeys(c for p in plain for c in p))
        at = [(columns.index(a), columns.index(b)) for a, b in plain]

        def count(values, valid):
            out = np.zeros((len(at), 3), dtype=np.int64)
            for k, (i, j) in enumerate(at):
                both = valid[i] & valid[j]
                out[k] = [np.count_nonzero(x & both) for x in _orders(values[i], values[j])]
            return out

        counted = _in_one_scan(df, columns, len(at), 3, count)
        frames.append(_named(counted, [{"a": a, "b": b} for a, b in plain], ["less", "equal", "greater"]))
    items = []
    for a, b in (p for p in pairs if p not in plain):
        x, y = column(a), column(b)
        items.append(
            {
                "=a": F.lit(a),
                "=b": F.lit(b),
                "less": F.count_if(x < y),
                "equal": F.count_if(x == y),
                "greater": F.count_if(x > y),
            }
        )
    if items:
        frames.append(_counters(df, items))
    total = F.col("less") + F.col("equal") + F.col("greater")
    return _union(frames).withColumn("support", total)


def _combined(name: str, x: np.ndarray, y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum or product, and where it lies within the type of Spark's result."""
    with np.errstate(over="ignore", invalid="ignore"):
        value = x + y if name == "ADD" else x * y
        if value.dtype.kind == "f":
            return value, np.ones(len(value), bool)
        near = x.astype(float) + y.astype(float) if name == "ADD" else x.astype(float) * y.astype(float)
    if bits == 64:  # beyond the range, the exact value is far from the one that wrapped around
        return value, abs(near - value.astype(float)) < 2.0**62
    return value, (value >= -(1 << (bits - 1))) & (value < 1 << (bits - 1))


def arithmetic_support(
    df: DataFrame, columns: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    """REC-13: for every t, {a, b}: rows with t = a + b and with t = a * b, in one scan.

    Differences and quotients are the same equations read from another column. Rows on which
    the arithmetic overflows support nothing. Equations with columns of other types than
    integers and floating point numbers are counted by Spark's aggregates.
    """
    number = lambda c: isinstance(df.schema[c].dataType, (*_INTEGERS, *_FLOATS))
    numbers = [c for c in columns if number(c)]
    equations = [
        (t, a, b, name)
        for t in columns
        for a, b in combinations([c for c in columns if c != t], 2)
        for name in ("ADD", "MULTIPLY")
    ]
    plain = [e for e in equations if all(c in numbers for c in e[:3])]
    frames = []
    if plain:
        at = {c: i for i, c in enumerate(numbers)}
        bits = {c: _INTEGERS.get(type(df.schema[c].dataType), 64) for c in numbers}
        terms: dict[tuple, list[tuple[int, int]]] = {}
        for k, (t, a, b, name) in enumerate(plain):
            terms.setdefault((at[a], at[b], name, max(bits[a], bits[b])), []).append((k, at[t]))

        def count(values, valid):
            out = np.zeros((len(plain), 2), dtype=np.int64)
            for (i, j, name, width), targets in terms.items():
                value, fits = _combined(name, values[i], values[j], width)
                known = valid[i] & valid[j] & fits
                for k, t in targets:
                    both = known & valid[t]
                    with np.errstate(invalid="ignore"):
                        if tolerance or values[t].dtype.kind == "f" or value.dtype.kind == "f":
                            holds = abs(values[t].astype(float) - value.astype(float)) <= tolerance
                        else:
                            holds = values[t] == value
                    out[k] = np.count_nonzero(holds & both), np.count_nonzero(both)
            return out

        items = [dict(zip(("target", "a", "b", "operator"), e)) for e in plain]
        counted = _in_one_scan(df, numbers, len(plain), 2, count)
        frames.append(_named(counted, items, ["holds", "support"]))
    items = []
    combine = {"ADD": F.try_add, "MULTIPLY": F.try_multiply}
    for t, a, b, name in (e for e in equations if not all(c in numbers for c in e[:3])):
        gap = F.try_subtract(column(t), combine[name](column(a), column(b)))
        near = (gap <= F.lit(float(tolerance))) & (gap >= F.lit(-float(tolerance)))
        items.append(
            {
                "=target": F.lit(t),
                "=a": F.lit(a),
                "=b": F.lit(b),
                "=operator": F.lit(name),
                "holds": F.count_if(near),
                "support": F.count(gap),
            }
        )
    if items:
        frames.append(_counters(df, items))
    return _union(frames)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def duration_support(
    df: DataFrame, pairs: Sequence[Pair], quantile: float = 0.99, accuracy: int = 10000
) -> DataFrame:
    """REC-11: shortest, longest and quantiles of end - start in seconds, in one scan.

    ``usual`` is what most gaps do not exceed, ``least`` what most reach. Gaps below 0 are of the
    wrong order and are counted apart, in ``reversed``.
    """
    items = []
    for a, b in pairs:
        whole = seconds_between(column(a), column(b))
        gap = F.when(whole >= 0, whole)
        items.append(
            {
                "=a": F.lit(a),
                "=b": F.lit(b),
                "shortest": F.min(gap),
                "longest": F.max(gap),
                "least": F.percentile_approx(gap, round(1 - quantile, 9), accuracy),
                "usual": F.percentile_approx(gap, quantile, accuracy),
                "support": F.count(gap),
                "reversed": F.count_if(whole < 0),
            }
        )
    return _counters(df, items)


# The largest unit of which a bound has at least so many is used.
UNITS = (("DAY", 86400, 2), ("HOUR", 3600, 2), ("MINUTE", 60, 1))


def _in_units(seconds: int, up: bool) -> tuple[int, str, int]:
    """A number of seconds in a unit of rules: value, unit, seconds of the value."""
    unit, size, _ = next(
        ((u, s, n) for u, s, n in UNITS if seconds >= n * s), UNITS[-1]
    )
    value = -(-seconds // size) if up else seconds // size
    return value, unit, value * size


def duration_bounds(
    df: DataFrame, pairs: Sequence[Pair], quantile: float = 0.99, accuracy: int = 10000
) -> DataFrame:
    """REC-11: upper and lower bounds of end - start, with the rows that hold them counted.

    The quantiles of a first scan, a row per pair, give the bounds, rounded to whole days, hours
    or minutes; a second scan counts the rows within each. Lower bounds of 0 are left out.
    """
    items = []
    for r in duration_support(df, pairs, quantile, accuracy).collect():
        whole = seconds_between(column(r["a"]), column(r["b"]))
        gap = F.when(whole >= 0, whole)
        for name, seconds, up in (("LTE", r["usual"], True), ("GTE", r["least"], False)):
            if not seconds:
                continue
            value, unit, bound = _in_units(seconds, up)
            if value:
                items.append(
                    {
                        "=a": F.lit(r["a"]),
                        "=b": F.lit(r["b"]),
                        "=operator": F.lit(name),
                        "=value": F.lit(float(value)),
                        "=unit": F.lit(unit),
                        "holds": F.count_if(gap <= bound if up else gap >= bound),
                        "support": F.count(gap),
                    }
                )
    if not items:
        return df.sparkSession.createDataFrame(
            [], "a string, b string, operator string, value double, unit string, holds bigint, support bigint"
        )
    return _counters(df, items)


# Rules ------------------------------------------------------------------------------------


def condition(**given: Column | str) -> Column:
    """A condition struct of the rules schema."""
    fields = []
    for f in schemas.CONDITION.fields:
        value = given.get(f.name)
        c = F.lit(value) if isinstance(value, (str, type(None))) else value
        fields.append(c.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def _mined(
    df: DataFrame,
    table_name: str,
    rule_type: Column | str,
    columns: Column,
    conditions: Column,
    holds: Column,
    reason: Column,
) -> DataFrame:
    support = F.col("support")
    small = support < SMALL_SUPPORT
    return recommend.as_rules(
        df.withColumn("table_name", F.lit(table_name)),
        rule_type,
        columns,
        holds / support,
        reason,
        engine="ADVANCED",
        conditions=conditions,
        evidence_=recommend.evidence(support=support, holds=holds),
        validation_status=F.when(small, "WARNING").otherwise("VALID"),
        validation_message=F.when(small, F.format_string("Only %d rows support it.", support)),
    )


def _strongest(support: DataFrame, min_confidence: float) -> DataFrame:
    """The comparison that holds on enough rows, as ``operator`` and ``holds``.

    Equality where it is frequent enough, else the direction; strict when no row is equal.
    """
    less, equal, greater = F.col("less"), F.col("equal"), F.col("greater")
    need = F.col("support") * F.lit(min_confidence)
    never = equal == 0
    options = [
        ("EQ", equal, F.lit(True)),
        ("LT", less, never),
        ("GT", greater, never),
        ("LTE", less + equal, ~never),
        ("GTE", greater + equal, ~never),
    ]
    best = F.coalesce(
        *[
            F.when(fits & (n >= need), F.struct(F.lit(o).alias("operator"), n.alias("holds")))
            for o, n, fits in options
        ]
    )
    return (
        support.where(F.col("support") > 0)
        .withColumn("best", best)
        .where(F.col("best").isNotNull())
        .select("*", "best.*")
        .drop("best")
    )


def comparison_rules(
    df: DataFrame, table_name: str, pairs: Sequence[Pair], min_confidence: float = 0.95
) -> DataFrame:
    """REC-12: CROSS_COLUMN rules between numeric columns."""
    best = _strongest(order_support(df, pairs), min_confidence)
    cond = condition(
        type="COMPARISON",
        left=F.col("a"),
        operator=F.col("operator"),
        right_type="column",
        right_value=F.col("b"),
    )
    return _mined(
        best, table_name, "CROSS_COLUMN", F.array("a", "b"), F.array(cond), F.col("holds"),
        F.format_string("%s %s %s", "a", "operator", "b"),
    )


def time_order_rules(
    df: DataFrame, table_name: str, pairs: Sequence[Pair], min_confidence: float = 0.95
) -> DataFrame:
    """REC-10: TEMPORAL rules from the order found in the data."""
    names = {"LT": "BEFORE", "LTE": "BEFORE_EQUAL", "GT": "AFTER", "GTE": "AFTER_EQUAL"}
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    best = _strongest(order_support(df, pairs), min_confidence).withColumn(
        "operator", F.coalesce(mapping[F.col("operator")], F.lit("BEFORE_EQUAL"))
    )
    cond = condition(
        type="TEMPORAL_ORDER",
        left=F.col("a"),
        operator=F.col("operator"),
        right_type="column",
        right_value=F.col("b"),
    )
    return _mined(
        best, table_name, "TEMPORAL", F.array("a", "b"), F.array(cond), F.col("holds"),
        F.format_string("%s %s %s", "a", "operator", "b"),
    )


def duration_rules(
    df: DataFrame, table_name: str, pairs: Sequence[Pair], quantile: float = 0.99,
    accuracy: int = 10000,
) -> DataFrame:
    """REC-11: end at most, and at least, so many days, hours or minutes after start."""
    cond = condition(
        type="DURATION",
        start_column=F.col("a"),
        end_column=F.col("b"),
        operator=F.col("operator"),
        value=F.col("value"),
        unit=F.col("unit"),
    )
    how = F.when(F.col("operator") == "LTE", "at most").otherwise("at least")
    return _mined(
        duration_bounds(df, pairs, quantile, accuracy), table_name, "TEMPORAL",
        F.array("a", "b"), F.array(cond), F.col("holds"),
        F.format_string(
            "%s comes %s %s %s after %s.", F.col("b"), how, F.col("value").cast("bigint"),
            F.lower("unit"), F.col("a"),
        ),
    )


def arithmetic_rules(
    df: DataFrame, table_name: str, columns: Sequence[str], tolerance: float = 0.0,
    min_confidence: float = 0.95,
) -> DataFrame:
    """REC-13: CROSS_COLUMN rules t = a op b."""
    found = arithmetic_support(df, columns, tolerance).where(
        (F.col("support") > 0)
        & (F.col("holds") >= F.col("support") * F.lit(min_confidence))
    )
    cond = condition(
        type="ARITHMETIC",
        target=F.col("target"),
        comparison_operator="EQ",
        arith_operator=F.col("operator"),
        operands=F.array("a", "b"),
        value=F.lit(float(tolerance)) if tolerance else None,
    )
    return _mined(
        found, table_name, "CROSS_COLUMN", F.array("target", "a", "b"), F.array(cond),
        F.col("holds"), F.format_string("%s = %s %s %s", "target", "a", "operator", "b"),
    )


# REC-14 -----------------------------------------------------------------------------------


def conditional_support(
    df: DataFrame, categories: Sequence[str], dependents: Sequence[str] = ()
) -> DataFrame:
    """REC-14: what follows when a category column has a value.

    One row per (if_column, if_value, then_column, then_value) with ``n`` rows, for category
    against category; then_value is null where the column is. For other dependent columns
    then_value is '' where a value is present: only presence is counted.

    Each row is spread to its pairs of columns first; Spark adds up equal ones in every task
    before it shuffles them, so what is shuffled is pairs of values, never the table.
    """
    categories, dependents = list(categories), list(dependents)
    text = {c: column(c).cast("string") for c in categories}
    entries = [(c, other, text[other]) for c in categories for other in categories if other != c]
    entries += [
        (c, other, F.when(column(other).isNotNull(), F.lit(""))) for c in categories for other in dependents
    ]
    spread = F.array(
        *[
            F.struct(
                F.lit(c).alias("if_column"),
                text[c].alias("if_value"),
                F.lit(other).alias("then_column"),
                value.alias("then_value"),
            )
            for c, other, value in entries
        ]
    )
    return (
        df.select(F.inline(spread))
        .where(F.col("if_value").isNotNull())
        .groupBy("if_column", "if_value", "then_column", "then_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def conditional_rules(
    df: DataFrame,
    table_name: str,
    categories: Sequence[str],
    dependents: Sequence[str] = (),
    min_confidence: float = 0.95,
    min_support: int = 1,
    max_values: int = naming.MAX_SET_SIZE,
) -> DataFrame:
    """REC-14: IF category = value THEN other is null, is not null, equals or is in a set.

    Rules on few rows are warnings; ``min_support`` drops those on fewer. Sets are listed for
    columns of up to ``max_values`` values. A consequence that holds for the whole column is no dependency and is left out.
    """
    counted = conditional_support(df, categories, dependents)
    present = F.col("then_value").isNotNull()
    whole = counted.groupBy("if_column", "then_column").agg(
        F.count_distinct("then_value").alias("all_values"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("all_nulls"),
        F.sum("n").alias("all_rows"),
    )
    # Values are listed for columns of few values only; those beyond give no value set.
    few = F.col("all_values") <= max_values
    joined = (
        counted.join(F.broadcast(whole), ["if_column", "then_column"])
        .groupBy("if_column", "if_value", "then_column")
        .agg(
            F.sum("n").alias("support"),
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("present"),
            F.array_sort(F.collect_list(F.when(present & few, F.col("then_value")))).alias("values"),
            F.max(F.when(present, F.struct("n", "then_value"))).alias("top"),
            *[F.first(c).alias(c) for c in ("all_values", "all_nulls", "all_rows")],
        )
        .where(F.col("support") >= min_support)
    )
    need = F.col("support") * F.lit(min_confidence)
    is_category = F.col("then_column").isin(*categories)
    nulls = F.col("support") - F.col("present")
    mixed = (F.col("all_nulls") > 0) & (F.col("all_nulls") < F.col("all_rows"))
    outcome = F.coalesce(
        F.when(mixed & (nulls >= need), F.struct(F.lit("IS_NULL").alias("kind"), nulls.alias("holds"))),
        F.when(
            is_category & (F.col("all_values") > 1) & (F.col("top.n") >= need),
            F.struct(F.lit("EQ").alias("kind"), F.col("top.n").alias("holds")),
        ),
        F.when(
            is_category
            & few
            & (F.size("values") < F.col("all_values"))
            & (F.col("present") >= need),
            F.struct(F.lit("IN").alias("kind"), F.col("present").alias("holds")),
        ),
        F.when(
            mixed & (F.col("present") >= need),
            F.struct(F.lit("IS_NOT_NULL").alias("kind"), F.col("present").alias("holds")),
        ),
    )
    found = joined.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())
    kind = F.col("outcome.kind")
    if_part = condition(
        role="IF", type="COMPARISON", left=F.col("if_column"), operator="EQ",
        right_type="literal", right_value=_quoted(F.col("if_value")),
    )
    then_part = (
        F.when(
            kind == "EQ",
            condition(
                role="THEN", type="COMPARISON", left=F.col("then_column"), operator="EQ",
                right_type="literal", right_value=_quoted(F.col("top.then_value")),
            ),
        )
        .when(
            kind == "IN",
            condition(
                role="THEN", type="SET", left=F.col("then_column"), operator="IN",
                values=F.transform("values", _quoted),
            ),
        )
        .otherwise(
            condition(role="THEN", type="NULL_CHECK", column=F.col("then_column"), operator=kind)
        )
    )
    return _mined(
        found, table_name, "CONDITIONAL_DEPENDENCY", F.array("if_column", "then_column"),
        F.array(if_part, then_part), F.col("outcome.holds"),
        F.format_string("IF %s = %s THEN %s %s", "if_column", "if_value", "then_column", kind),
    )


# REC-15 -----------------------------------------------------------------------------------


def _codes(df: DataFrame, name: str) -> list[Column]:
    """Numbers that are equal for equal values only: the value itself where it is fixed in
    width, else two unrelated hashes. Null stays null."""
    c, data_type = column(name), df.schema[name].dataType
    if isinstance(data_type, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [c]
    return [F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.hash(c))]


def dependency_support(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """REC-15: for every ordered pair of columns: values of a, and how many have several b.

    One pass of grouping sets, one set per column: within a group the smallest and largest
    code of b differ exactly when b is not determined. Each task shrinks its rows to the
    distinct values of the columns before anything is shuffled, and numbers as codes keep
    that a hash aggregate. Many columns take several passes.
    """
    columns = list(columns)
    keys = {c: f"k{i}" for i, c in enumerate(columns)}
    codes = {
        c: {f"{keys[c]}_{j}": code for j, code in enumerate(_codes(df, c))} for c in columns
    }
    shaped = df.select(
        *[column(c).alias(k) for c, k in keys.items()],
        *[code.alias(name) for found in codes.values() for name, code in found.items()],
    )
    several = [
        reduce(lambda a, b: a | b, [F.min(n) != F.max(n) for n in codes[c]]).alias(
            f"several_{keys[c]}"
        )
        for c in columns
    ]
    step = max(1, min(MAX_GROUPING_SETS, AGGREGATES_PER_SCAN // len(columns)))
    return _union(
        _determined(shaped, columns[i : i + step], keys, several)
        for i in range(0, len(columns), step)
    )


def _determined(
    shaped: DataFrame, determinants: Sequence[str], keys: dict[str, str], several: list[Column]
) -> DataFrame:
    """The rows of ``dependency_support`` for some of the columns."""
    own = [keys[a] for a in determinants]
    grouped = shaped.groupingSets(
        [[F.col(k)] for k in own], *[F.col(k) for k in own]
    ).agg(F.grouping_id(*own).alias("gid"), *several)
    # The grouping id has a bit set for each column that is not the one grouped by.
    every = (1 << len(own)) - 1
    aggregates, rows = [], []
    for i, a in enumerate(determinants):
        gid = every - (1 << (len(own) - 1 - i))
        here = (F.col("gid") == gid) & F.col(keys[a]).isNotNull()
        aggregates.append(F.count_if(here).alias(f"n_{i}"))
        for b, k in keys.items():
            if a == b:
                continue
            aggregates.append(F.count_if(here & F.col(f"several_{k}")).alias(f"b_{i}_{k}"))
            rows.append(
                F.struct(
                    F.lit(a).alias("determinant"),
                    F.lit(b).alias("dependent"),
                    F.col(f"n_{i}").alias("n_values"),
                    F.col(f"b_{i}_{k}").alias("n_broken"),
                )
            )
    return grouped.agg(*aggregates).select(F.inline(F.array(*rows)))


def dependencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """REC-15: dependencies a -> b that hold in every row; a has more than one value."""
    return dependency_support(df, columns).where(
        (F.col("n_values") > 1) & (F.col("n_broken") == 0)
    )


def dependency_rules(
    df: DataFrame, table_name: str, columns: Sequence[str], min_confidence: float = 0.95
) -> DataFrame:
    """REC-15: FUNCTIONAL_DEPENDENCY rules; confidence is the share of values that hold."""
    found = (
        dependency_support(df, columns)
        .where(F.col("n_values") > 1)
        .withColumn("support", F.col("n_values"))
        .withColumn("holds", F.col("n_values") - F.col("n_broken"))
        .where(F.col("holds") >= F.col("support") * F.lit(min_confidence))
    )
    return _mined(
        found, table_name, checks.DEPENDENCY, F.array("determinant", "dependent"),
        F.array().cast(schemas.RULES["conditions"].dataType), F.col("holds"),
        F.format_string("%s determines %s", "determinant", "dependent"),
    )
