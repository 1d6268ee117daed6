"""OBS-9: how far the values of a new snapshot are from those of an old one.

Numbers are counted in bins of equal width between the smallest and largest old value, with a bin each
for what lies below and above; categories by value. Each snapshot is read once for the counts, and the old
one once more for its bounds. Bins are added up in every task before they are shuffled.

* ``distance``: for numbers the Kolmogorov-Smirnov distance at the edges of the bins, which is at most the
  true one; for categories half the sum of the differences of shares.
* ``psi``: the population stability index, with half a row added to each bin or value.
* ``critical``: what a distance of numbers stays below in all but one in a hundred pairs of samples of one
  distribution. Null for categories, whose limit depends on how many there are.

Nulls and NaN are no values; ``rows_old`` and ``rows_new`` count values. A column without values in a
snapshot has no distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.predicates import column
from plumbline.operators.skew import short_key

BINS = 20
# sqrt(-ln(0.01 / 2) / 2), the factor of the two-sample limit at one in a hundred
FACTOR = 1.6276236307187293


def _number(name: str) -> Column:
    return F.nanvl(column(name).cast("double"), F.lit(None).cast("double"))


def _counted(df: DataFrame, keys: dict[str, Column], side: str) -> DataFrame:
    values = [F.when(k.isNotNull(), F.struct(F.lit(c).alias("column_name"), k.alias("key"))) for c, k in keys.items()]
    rows = df.select(F.explode(F.array_compact(F.array(*values))).alias("v"))
    return rows.groupBy("v.column_name", "v.key").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))


def _compared(counts: DataFrame) -> DataFrame:
    """(column_name, key, old, new): counts side by side, 0 where a side lacks the key."""
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    return counts.groupBy("column_name", "key").agg(n("old").alias("old"), n("new").alias("new"))


def _psi(cells: Column) -> Column:
    """The index, from counts and totals beside them."""
    p = (F.col("old") + 0.5) / (F.col("all_old") + 0.5 * cells)
    q = (F.col("new") + 0.5) / (F.col("all_new") + 0.5 * cells)
    return F.sum((q - p) * F.log(q / p))


def numeric_drift(old: DataFrame, new: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(column_name, kind, rows_old, rows_new, distance, psi, critical, drifted) of number columns."""
    bounds = old.agg(*(f(_number(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max)))).first()
    keys = {}
    for i, c in enumerate(columns):
        low, high, x = bounds[f"low{i}"], bounds[f"high{i}"], _number(c)
        if low is None:
            keys[c] = F.when(x.isNotNull(), F.lit(0))
            continue
        inside = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)) if high > low else F.lit(0)
        keys[c] = F.when(x < low, -1).when(x > high, bins).when(x.isNotNull(), inside.cast("int"))
    counts = _compared(_counted(old, keys, "old").unionByName(_counted(new, keys, "new")))
    # all bins of a column are one small group: bins + 2 rows
    own = Window.partitionBy("column_name")
    so_far = own.orderBy("key")
    total = counts.withColumns({f"all_{s}": F.sum(s).over(own) for s in ("old", "new")})
    share = lambda s: F.try_divide(F.sum(s).over(so_far), F.col(f"all_{s}"))
    total = total.withColumn("gap", F.abs(share("old") - share("new")))
    found = total.groupBy("column_name").agg(
        F.first("all_old").alias("rows_old"), F.first("all_new").alias("rows_new"), F.max("gap").alias("distance"), _psi(F.lit(bins + 2)).alias("psi")
    )
    n, m = F.col("rows_old"), F.col("rows_new")
    both = (n > 0) & (m > 0)
    critical = F.when(both, F.lit(FACTOR) * F.sqrt((n + m) / (n.cast("double") * m)))
    return found.select(
        "column_name", F.lit("NUMBER").alias("kind"), "rows_old", "rows_new", F.when(both, F.col("distance")).alias("distance"),
        F.when(both, F.col("psi")).alias("psi"), critical.alias("critical"), F.when(both, F.col("distance") > critical).alias("drifted"),
    )


def category_drift(old: DataFrame, new: DataFrame, columns: Sequence[str], limit: float = 0.1) -> DataFrame:
    """The same for categories; ``drifted`` where the index is above ``limit``."""
    keys = {c: short_key(column(c), old.schema[c].dataType).cast("string") for c in columns}
    counts = _compared(_counted(old, keys, "old").unionByName(_counted(new, keys, "new")))
    totals = counts.groupBy("column_name").agg(F.sum("old").alias("all_old"), F.sum("new").alias("all_new"), F.count(F.lit(1)).alias("cells"))
    joined = counts.join(F.broadcast(totals), "column_name")  # a row per column
    gap = F.abs(F.try_divide(F.col("old"), F.col("all_old")) - F.try_divide(F.col("new"), F.col("all_new")))
    found = joined.groupBy("column_name").agg(
        F.first("all_old").alias("rows_old"), F.first("all_new").alias("rows_new"), (F.sum(gap) / 2).alias("distance"), _psi(F.col("cells")).alias("psi")
    )
    both = (F.col("rows_old") > 0) & (F.col("rows_new") > 0)
    psi = F.when(both, F.col("psi"))
    return found.select(
        "column_name", F.lit("CATEGORY").alias("kind"), "rows_old", "rows_new", "distance", psi.alias("psi"),
        F.lit(None).cast("double").alias("critical"), (psi > limit).alias("drifted"),
    )


def drift(old: DataFrame, new: DataFrame, numbers: Sequence[str] = (), categories: Sequence[str] = (), bins: int = BINS, limit: float = 0.1) -> DataFrame:
    """Both in one table."""
    frames = []
    if numbers:
        frames.append(numeric_drift(old, new, numbers, bins))
    if categories:
        frames.append(category_drift(old, new, categories, limit))
    return reduce(DataFrame.unionByName, frames)
