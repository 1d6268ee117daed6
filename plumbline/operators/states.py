"""PROF-15, PROF-20, OBS-9: profiles that can be added up, so that a new day is read once and no old one again.

A state has a row per column of one part of a table: counters, extremes, and sketches of distinct values
(HyperLogLog) and of the distribution (KLL). States of parts are stored as an ordinary table and merged by
Spark's aggregates; a merged state is a state again. Counters and extremes of a merged state are those of
the whole table. Distinct counts are off by DISTINCT_ERROR and ranks by RANK_ERROR, one standard error,
however often states were merged.

Numbers and times (in seconds) have extremes and a distribution, text its length; NaN is no number there.
Columns of other types are counted only. Parts must not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.predicates import column

REGISTERS_LOG = 12
DISTINCT_ERROR = 1.04 / (1 << REGISTERS_LOG) ** 0.5
KLL_SIZE = 400
RANK_ERROR = 0.0133  # of a KLL sketch of 200 entries at 99%; this one has twice as many

COUNTERS = ["rows", "nulls", "blanks"]
KEYS = ["table_name", "column_name"]


def _measure(name: str, data_type: T.DataType) -> Column:
    """What extremes and distribution are of."""
    c = column(name)
    if isinstance(data_type, T.NumericType):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(data_type, T.StringType):
        return F.length(c).cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(c).cast("double") * 86400
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c) / 1e6
    if isinstance(data_type, T.TimestampNTZType):
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', x)".replace("x", "`" + name.replace("`", "``") + "`")) / 1e6
    return F.lit(None).cast("double")


def state(df: DataFrame, table_name: str, part: str) -> DataFrame:
    """The state of one part of a table, from one scan that shuffles a row per task."""
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c, x = column(f.name), _measure(f.name, f.dataType)
        hashable = not isinstance(f.dataType, (T.MapType, T.VariantType))
        value = F.when(c.isNotNull(), F.xxhash64(c)) if hashable else F.lit(None).cast("bigint")
        blank = F.count_if(F.trim(c) == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("bigint")
        own = {
            "nulls": F.count_if(c.isNull()), "blanks": blank, "low": F.min(x), "high": F.max(x),
            "distinct_sketch": F.hll_sketch_agg(value, REGISTERS_LOG), "rank_sketch": F.kll_sketch_agg_double(x, KLL_SIZE),
        }
        aggregates += [a.alias(f"{n}_{i}") for n, a in own.items()]
        rows.append(
            F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.col("rows"), *(F.col(f"{n}_{i}").alias(n) for n in own))
        )
    return df.agg(*aggregates).select(F.lit(table_name).alias("table_name"), F.lit(part).alias("part"), F.inline(F.array(*rows)))


def merged(states: DataFrame) -> DataFrame:
    """One state of each table from those of its parts; ``part`` counts them."""
    return states.groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("string").alias("part"),
        F.min("ordinal").alias("ordinal"),
        *(F.sum(c).alias(c) for c in COUNTERS),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"),
    )


def read(states: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a state says: counters, extremes, estimated distinct values and quantiles."""
    some = F.col("low").isNotNull()
    at = [F.when(some, F.kll_sketch_get_quantile_double("rank_sketch", F.lit(q))) for q in quantiles]
    return states.select(
        *KEYS, "part", *COUNTERS, "low", "high",
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        F.array(*at).alias("quantiles"),
    )
