"""PROF-9, PROF-11 for large columns: the most frequent values, exact, without shuffling the others.

1. Every task keeps COUNTERS counters of hashes (Misra-Gries): when there are more, the count of the
   first one too many is taken off all, and added to what the task may have missed of any value.
2. Summed over tasks, each value has a lower bound of its count, and an upper one that exceeds it by
   what all tasks may have missed. Values whose upper bound reaches the k-th largest lower bound are
   candidates; a value in no task's counters cannot be among the first k if what may have been missed
   is below that bound.
3. A second scan counts the candidates exactly. They are broadcast as hashes, CANDIDATES at most.

Where the bounds cannot tell, as in columns of nearly distinct values, all values are grouped. Both ways
give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need no copy of this module for the functions that run there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 1 << 16
CANDIDATES = 100_000


class Counters:
    """Counts of hashes that are at most ``missed`` too low."""

    def __init__(self) -> None:
        self.hashes, self.counts, self.missed = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        new, counts = np.unique(hashes, return_counts=True)
        both, where = np.unique(np.concatenate((self.hashes, new)), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, where, np.concatenate((self.counts, counts)))
        if len(both) > COUNTERS:
            off = int(np.partition(total, len(total) - COUNTERS - 1)[len(total) - COUNTERS - 1])
            self.missed += off
            total -= off
            both, total = both[total > 0], total[total > 0]
        self.hashes, self.counts = both, total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Counters()
    for batch in batches:
        found.add(batch.column(0).to_numpy())
    # the row without a hash holds what the task may have missed
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *found.hashes.tolist()], pa.int64()), pa.array([found.missed, *found.counts.tolist()], pa.int64())],
        names=["hash", "n"],
    )


def heavy_hitters(df: DataFrame, value: Column | str, k: int = 20) -> DataFrame:
    """(value, count): the k most frequent values that are not null; ties by value, ascending.

    Values of any type that can be grouped and sorted. Fewer rows if there are fewer values.
    """
    rows = df.select((F.col(value) if isinstance(value, str) else value).alias("value")).where("value is not null")
    hashed = rows.select(F.xxhash64("value").alias("hash"))
    bounds = hashed.mapInArrow(_counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    # of the lower bounds only the greatest come here: k of them, and what may have been missed
    missed = bounds.where("hash is null").first()
    missed = missed["n"] if missed else 0
    known = bounds.where("hash is not null")
    top = [r["n"] for r in known.orderBy(F.desc("n")).limit(k).collect()]
    if len(top) == k and top[-1] > missed or not missed:
        least = top[-1] - missed if len(top) == k else 0
        candidates = known.where(F.col("n") >= least).select("hash").limit(CANDIDATES + 1).collect()
        if len(candidates) <= CANDIDATES:
            few = df.sparkSession.createDataFrame(pa.table({"hash": pa.array([r["hash"] for r in candidates], pa.int64())}))
            rows = rows.withColumn("hash", F.xxhash64("value")).join(F.broadcast(few), "hash", "left_semi")
    counted = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(k)
