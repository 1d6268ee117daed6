"""Joining rows back to their group without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.predicates import column

# The heaviest keys are broadcast. Of the keys left, none can hold more than 1/HOT_KEYS of
# all rows, so the shuffled part has no hot partition.
HOT_KEYS = 1000

# Parts a group is split into where its members are told apart by another key.
SALTS = 16

# Longer texts are compared by their SHA-256, so that documents are not shuffled whole.
DIGEST_OVER = 64
DIGEST_MARK = "#"


def text_key(text: Column) -> Column:
    """The text, or '#' and its digest; as a digest is longer than any text kept, the two
    cannot meet."""
    return F.when(
        F.length(text) > DIGEST_OVER, F.concat(F.lit(DIGEST_MARK), F.sha2(text, 256))
    ).otherwise(text)


def short_key(c: Column, data_type: T.DataType) -> Column:
    """The value in a form of bounded size that is equal for equal values only."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return text_key(c)
    if isinstance(data_type, (T.ArrayType, T.StructType, T.BinaryType)):
        as_text = F.base64(c) if isinstance(data_type, T.BinaryType) else F.to_json(c)
        return text_key(as_text)
    return c


def with_short_keys(df: DataFrame, on: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame with a bounded form of each key column, and the names of these."""
    names = [f"_key_{i}" for i in range(len(on))]
    added = {
        k: short_key(column(c), df.schema[c].dataType) for k, c in zip(names, on)
    }
    return df.withColumns(added), names


def rows_of_keys(
    df: DataFrame, keys: DataFrame, on: list[str], weight: str
) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, with the other columns of ``keys`` added.

    ``keys`` has one row per key and ``weight``, the number of rows with that key. The
    HOT_KEYS heaviest go by broadcast, cut by ``limit`` and with keys of bounded size, and
    their rows are never shuffled; the others meet in a shuffled join. Both parts are exact.
    """
    extra = [c for c in keys.columns if c not in on]
    rows, short = with_short_keys(df, on)
    short_keys, _ = with_short_keys(keys, on)
    short_keys = short_keys.select(*short, *map(column, extra))
    hot = short_keys.orderBy(F.desc(weight), *short).limit(HOT_KEYS)
    hot_keys = hot.select(*short)
    cold = short_keys.join(F.broadcast(hot_keys), short, "left_anti")
    columns = [column(c) for c in df.columns + extra]
    hot_rows = rows.join(F.broadcast(hot), short)
    cold_rows = rows.join(F.broadcast(hot_keys), short, "left_anti").join(cold, short)
    return hot_rows.select(*columns).unionByName(cold_rows.select(*columns))


def look_up(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with the columns of ``lookup`` (one row per key), null where it has no row.

    A left join that holds no hot group in one task: the keys of ``df`` are counted, looked
    up once each, and joined back by weight. Keys must not be null.
    """
    counted = df.groupBy(*map(column, on)).agg(F.count(F.lit(1)).alias("_rows"))
    found = counted.join(lookup, on, "left")
    return rows_of_keys(df, found, on, "_rows").drop("_rows")
