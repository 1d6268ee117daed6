"""FN-6..8: labels, percents and safe parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is empty."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """FN-7: 100 * part / whole, rounded only when digits are asked for."""
    value = F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def number_label(x: Column) -> Column:
    """A number as text, whole numbers without a trailing .0."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(
        F.format_string("%.1f", x)
    )


def range_label(low: Column, high: Column) -> Column:
    """FN-6: 'a - b' with one decimal at most."""
    return F.concat(
        number_label(F.round(low, 1)), F.lit(" - "), number_label(F.round(high, 1))
    )


def parse_number(c: Column, data_type: T.DataType) -> Column:
    """FN-8: a double, null where the value is no number.

    Numbers are widened without going through text. Text such as ``1.5d`` is a Java
    literal and no number here.
    """
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if not isinstance(data_type, T.StringType):
        return F.lit(None).cast("double")
    s = F.trim(c)
    return F.when(~s.rlike("[0-9.][dDfF]$"), s).try_cast("double")
