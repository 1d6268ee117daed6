"""The most frequent values, where counters suffice and where they do not."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import heavy as H


def brute(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda i: (-i[1], i[0]))[:k]


def skewed(n):
    rng = random.Random(4)
    return [None if rng.random() < 0.05 else int(rng.paretovariate(0.6)) for _ in range(n)]


@pytest.mark.parametrize("counters", [1 << 16, 200, 5])
@pytest.mark.parametrize("k", [7, 10_000])
def test_values(spark, counters, k, monkeypatch):
    monkeypatch.setattr(H, "COUNTERS", counters)
    values = skewed(5000)
    df = spark.createDataFrame([(v,) for v in values], "`a b` long").repartition(5)
    assert [tuple(r) for r in H.heavy_hitters(df, F.col("`a b`"), k).collect()] == brute(values, k)


def test_too_many_candidates(spark, monkeypatch):
    monkeypatch.setattr(H, "CANDIDATES", 3)
    values = [str(i % 50) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    assert [tuple(r) for r in H.heavy_hitters(df, "v", 5).collect()] == brute(values, 5)


@pytest.mark.parametrize("rows", [[], [(None,)] * 3])
def test_no_values(spark, rows):
    assert H.heavy_hitters(spark.createDataFrame(rows, "v string"), "v").collect() == []


def test_counters_miss_no_more_than_they_say(monkeypatch):
    monkeypatch.setattr(H, "COUNTERS", 20)
    rng = np.random.default_rng(1)
    found, seen = H.Counters(), Counter()
    for _ in range(30):
        batch = rng.zipf(1.3, 100).astype(np.int64)
        seen.update(batch.tolist())
        found.add(batch)
    kept = dict(zip(found.hashes.tolist(), found.counts.tolist()))
    assert len(kept) <= 20 and 0 < found.missed < sum(seen.values()) / 20
    for v, n in seen.items():
        assert kept.get(v, 0) <= n <= kept.get(v, 0) + found.missed
