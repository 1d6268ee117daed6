"""Column, key and table checks (CHK-*).

Row checks are boolean Columns: true where the row passes, never null. Key checks aggregate
by key first, so a key that holds most rows shrinks before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import numbers
from plumbline.operators.predicates import RuleError, all_of, any_of, column
from plumbline.operators.profile import value_frequencies
from plumbline.operators.skew import rows_of_keys, short_key, with_short_keys

NOT_NULL = "columnValuesToBeNotNull"
UNIQUE = "columnValuesToBeUnique"
BETWEEN = "columnValuesToBeBetween"
IN_SET = "columnValuesToBeInSet"
LENGTH = "columnValuesLengthToBeBetween"
ROW_COUNT = "tableRowCountToBeBetween"
REGEX = "columnValuesToMatchRegex"
CUSTOM_SQL = "tableCustomSQLQuery"
DEPENDENCY = "FUNCTIONAL_DEPENDENCY"

# Some character that is no white space in any script.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
# Up to here every integer is a double, and bounds can be compared as integers.
EXACT_DOUBLE = 2**53


def passes(broken: Column) -> Column:
    """The check that a violation breaks: true unless it is known to be broken."""
    return ~F.coalesce(broken, F.lit(False))


def outside(value: Column, low, high) -> Column:
    """Beyond a bound; bounds are inclusive and either may be left out."""
    tests = []
    if low is not None:
        tests.append(value < (low if isinstance(low, Column) else F.lit(low)))
    if high is not None:
        tests.append(value > (high if isinstance(high, Column) else F.lit(high)))
    return any_of(tests)


# Violations: true on broken rows, and false or null on the others, so that filters on them
# reach the file scan and can skip row groups by their minimum and maximum.


def null_violation(name: str, data_type: T.DataType) -> Column:
    """CHK-1: missing, or blank once trimmed."""
    c = column(name)
    if isinstance(data_type, T.StringType):
        return c.isNull() | ~c.rlike(NOT_BLANK)
    return c.isNull()


def between_violation(name: str, data_type: T.DataType, low=None, high=None) -> Column:
    """CHK-3: a number beyond the bounds; null, NaN and text that is no number pass.

    Dates and times take bounds that are dates, times or their text.
    """
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        bounds = []
        for bound in (low, high):
            if isinstance(bound, (int, float)):
                raise RuleError(f"Bounds of {name} must be dates or times, not numbers")
            bounds.append(None if bound is None else F.lit(bound).cast(data_type))
        return outside(column(name), *bounds)
    low = None if low is None else float(low)
    high = None if high is None else float(high)
    bounds = [b for b in (low, high) if b is not None]
    if isinstance(data_type, T.IntegralType) and all(abs(b) <= EXACT_DOUBLE for b in bounds):
        return outside(
            column(name),
            None if low is None else math.ceil(low),
            None if high is None else math.floor(high),
        )
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = column(name)
        beyond = outside(value, low, high)
        return beyond if high is None else beyond & ~F.isnan(value)
    value = F.nanvl(numbers.parse_number(column(name), data_type), F.lit(None).cast("double"))
    return outside(value, low, high)


def set_violation(name: str, allowed: Iterable) -> Column:
    """CHK-4: a value outside the set, whatever its case; null passes."""
    lowered = [str(v).lower() for v in allowed]
    if not lowered:
        return column(name).isNotNull()
    return ~F.lower(column(name).cast("string")).isin(lowered)


def length_violation(name: str, low=None, high=None) -> Column:
    """CHK-5: null passes."""
    return outside(F.length(column(name).cast("string")), low, high)


def pattern_violation(name: str, pattern: str) -> Column:
    """CHK-7: null passes."""
    return ~column(name).cast("string").rlike(pattern)


def expression_violation(expression: str) -> Column:
    """CHK-8: a SQL expression that must hold; unknown counts as held."""
    return ~F.expr(expression)


def not_null(name: str, data_type: T.DataType) -> Column:
    return passes(null_violation(name, data_type))


def between(name: str, data_type: T.DataType, low=None, high=None) -> Column:
    return passes(between_violation(name, data_type, low, high))


def in_set(name: str, allowed: Iterable) -> Column:
    return passes(set_violation(name, allowed))


def length_between(name: str, low=None, high=None) -> Column:
    return passes(length_violation(name, low, high))


def matches(name: str, pattern: str) -> Column:
    return passes(pattern_violation(name, pattern))


def holds(expression: str) -> Column:
    return passes(expression_violation(expression))


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per key, keys with a null left out."""
    present = df.where(all_of(column(c).isNotNull() for c in columns))
    return present.groupBy(*map(column, columns)).agg(F.count(F.lit(1)).alias("n"))


def repeated_values(df: DataFrame, name: str) -> DataFrame:
    """CHK-2: values that occur more than once, with their number of rows."""
    return key_counts(df, [name]).where(F.col("n") > 1)


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CHK-2: the rows behind repeated keys, with ``n``, the number of rows per key."""
    rows, short = with_short_keys(df, list(columns))
    repeated = key_counts(rows, short).where(F.col("n") > 1)
    return rows_of_keys(rows, repeated, short, "n").drop(*short)


def unique_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-null rows, repeated values, and rows with a repeated value.

    All columns of one type share a shuffle; long texts are counted by digest. A column with
    no value at all has no row here.
    """
    n = F.col("n")
    shaped = df.select(
        *[short_key(column(c), df.schema[c].dataType).alias(c) for c in columns]
    )
    return (
        value_frequencies(shaped, blank_is_null=False)
        .groupBy("column_name")
        .agg(
            F.sum(n).alias("applicable"),
            F.count_if(n > 1).alias("repeated_values"),
            F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("violations"),
        )
    )


def row_count_between(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """CHK-6: one row with the row count and whether it lies within the bounds."""
    rows = F.col("rows")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "passed", passes(outside(rows, low, high))
    )


def primary_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CHK-11: keys that break a primary key: repeated, or with a null part.

    One shuffle: a null is a group value like any other.
    """
    columns = list(columns)
    has_null = F.lit(False)
    for c in columns:
        has_null = has_null | column(c).isNull()
    return (
        df.groupBy(*map(column, columns))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("problem", F.when(has_null, "NULL").when(F.col("n") > 1, "DUPLICATE"))
        .where(F.col("problem").isNotNull())
    )


def unique_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CHK-12: keys that break a unique constraint; keys with a null part are free."""
    return key_counts(df, columns).where(F.col("n") > 1)


def orphan_keys(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """CHK-13: child keys without a parent, with their number of rows.

    The child is reduced to its distinct keys before the join, so neither side is skewed;
    Spark broadcasts the parent by itself when its size is known to be small.
    """
    columns = list(columns)
    parents = parent.select(
        *[column(p).alias(c) for p, c in zip(parent_columns, columns, strict=True)]
    )
    return key_counts(child, columns).join(parents, columns, "left_anti")


def orphan_rows(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """CHK-13: the child rows behind orphan keys."""
    keys = orphan_keys(child, columns, parent, parent_columns)
    return rows_of_keys(child, keys, list(columns), "n").drop("n")


def dependency_breaks(
    df: DataFrame, determinant: Sequence[str], dependent: str
) -> DataFrame:
    """CHK-14: values of ``determinant`` with more than one value of ``dependent``.

    Grouping by both first means a hot determinant is already reduced to its distinct pairs
    when the second aggregate combines them. Nulls of the dependent are no value.
    """
    determinant = list(determinant)
    known = df.where(all_of(column(c).isNotNull() for c in determinant))
    keys = [column(c) for c in determinant]
    pairs = known.groupBy(*keys, column(dependent)).agg(F.count(F.lit(1)).alias("pair_rows"))
    return (
        pairs.groupBy(*keys)
        .agg(F.count(column(dependent)).alias("n_values"), F.sum("pair_rows").alias("n"))
        .where(F.col("n_values") > 1)
    )


def dependency_break_rows(
    df: DataFrame, determinant: Sequence[str], dependent: str
) -> DataFrame:
    """CHK-14: the rows behind broken determinant values."""
    keys = dependency_breaks(df, determinant, dependent)
    return rows_of_keys(df, keys, list(determinant), "n").drop("n")
