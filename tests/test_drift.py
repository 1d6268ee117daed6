"""Distances of snapshots against plain Python."""

import math
import random
from collections import Counter

import pytest

from plumbline.operators import drift as D


def psi(old, new, keys, cells):
    n, m = sum(old.values()), sum(new.values())
    total = 0
    for k in keys:
        p, q = (old[k] + 0.5) / (n + 0.5 * cells), (new[k] + 0.5) / (m + 0.5 * cells)
        total += (q - p) * math.log(q / p)
    return total


def snapshots(spark, shift):
    rng = random.Random(6)
    maybe = lambda v: None if rng.random() < 0.1 else v
    row = lambda s: (maybe(rng.gauss(s, 1)), maybe(rng.choice("ab") if s == 0 else rng.choice("abbbc")), "x" * 100 if rng.random() < 0.5 else "y")
    old, new = [row(0) for _ in range(900)], [row(shift) for _ in range(500)]
    old += [(float("nan"), None, None)] * 5
    schema = "`x y` double, c string, long string"
    return old, new, spark.createDataFrame(old, schema).repartition(3), spark.createDataFrame(new, schema)


@pytest.mark.parametrize("shift", [0, 0.7])
def test_numbers(spark, shift):
    old, new, a, b = snapshots(spark, shift)
    r = D.numeric_drift(a, b, ["x y"]).first()
    values = lambda rows: [v[0] for v in rows if v[0] is not None and v[0] == v[0]]
    x, y = values(old), values(new)
    low, high = min(x), max(x)
    of = lambda v: -1 if v < low else D.BINS if v > high else min(int((v - low) / (high - low) * D.BINS), D.BINS - 1)
    p, q = Counter(map(of, x)), Counter(map(of, y))
    gap = max(abs(sum(p[j] for j in range(-1, k + 1)) / len(x) - sum(q[j] for j in range(-1, k + 1)) / len(y)) for k in range(-1, D.BINS + 1))
    true = max(abs(sum(v <= t for v in x) / len(x) - sum(v <= t for v in y) / len(y)) for t in x + y)
    assert (r.rows_old, r.rows_new) == (len(x), len(y))
    assert r.distance == pytest.approx(gap) and r.distance <= true + 1e-12
    assert r.psi == pytest.approx(psi(p, q, set(p) | set(q), D.BINS + 2))
    assert r.drifted == (shift > 0)


@pytest.mark.parametrize("shift", [0, 0.7])
def test_categories(spark, shift):
    old, new, a, b = snapshots(spark, shift)
    got = {r.column_name: r for r in D.category_drift(a, b, ["c", "long"]).collect()}
    p, q = (Counter(r[1] for r in rows if r[1] is not None) for rows in (old, new))
    keys = set(p) | set(q)
    n, m = sum(p.values()), sum(q.values())
    assert got["c"].distance == pytest.approx(sum(abs(p[k] / n - q[k] / m) for k in keys) / 2)
    assert got["c"].psi == pytest.approx(psi(p, q, keys, len(keys))) and got["c"].drifted == (shift > 0)
    assert not got["long"].drifted


def test_empty_and_constant_columns(spark):
    schema = "x double, c string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1.0, "a")] * 4, schema)
    assert D.drift(none, none, ["x"], ["c"]).collect() == []
    for a, b in ((none, one), (one, none)):
        for r in D.drift(a, b, ["x"], ["c"]).collect():
            assert (r.distance, r.psi, r.drifted) == (None, None, None)
    for r in D.drift(one, one, ["x"], ["c"]).collect():
        assert (r.distance, r.psi, r.drifted) == (0.0, 0.0, False)
