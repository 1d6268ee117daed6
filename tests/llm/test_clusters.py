import hashlib
import math
import random

import pytest

from plumbline.llm import clusters as C


def brute(rows, k, rounds, size, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            ints = []
            for x in v:
                top, bottom = x.as_integer_ratio()
                ints.append(64 * top // bottom)
            kept.append((i, ints))
    name = lambda i: "" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name(r[0])}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    total = sum(d for d, _ in near)
    out = []
    for (i, _), (d, n) in zip(kept, near):
        own = sum(e for e, m in near if m == n)
        fit = lambda x, bad: None if bad or x >= 1 << 63 else x
        own_bad = any(e >= 1 << 63 for e, m in near if m == n)
        any_bad = any(e >= 1 << 63 for e, _ in near)
        sha = hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
        out.append((i, n, fit(d, False), fit(own, own_bad), fit(total, any_bad), sha))
    return sorted(out, key=repr)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster int, ID_ string").repartition(3)


def got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(n, size, seed=1, scale=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, scale) * 64) / 64 for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(1, 3), (5, 3), (16, 1), (4, 0)])
def test_brute_force(spark, k, rounds):
    rows = some(150, 8) + [(5, [0.5] * 8)] * 40 + [(5, [-0.5] * 8), (None, [0.25] * 8), (None, [0.25] * 8)]
    assert got(C.cluster(vectors(spark, rows), k, rounds, 8)) == brute(rows, k, rounds, 8)


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, []), (92, [1.0] * 7), (93, [1.0] * 9), (94, [nan] + [1.0] * 7), (95, [inf] * 8), (96, [-inf] * 8), (97, [None] + [1.0] * 7)]
    rows = some(20, 8) + bad
    assert got(C.cluster(vectors(spark, rows), 3, 3, 8)) == brute(rows, 3, 3, 8)
    assert got(C.cluster(vectors(spark, bad), 3, 3, 8)) == []
    assert got(C.cluster(vectors(spark, []), 3, 3, 8)) == []


def test_fewer_vectors_than_centroids(spark):
    rows = some(3, 8)
    assert got(C.cluster(vectors(spark, rows), 16, 3, 8)) == brute(rows, 16, 3, 8)


@pytest.mark.parametrize("wide", [1e7, 1e30, 1.7e308])
def test_wide_numbers_stay_exact(spark, wide):
    rows = some(40, 4) + [(100 + i, [wide * (1 + i / 8), -wide, 0.5, float(i)]) for i in range(6)] + some(20, 4, 2, 1e5)
    assert got(C.cluster(vectors(spark, rows, "double"), 6, 3, 4)) == brute(rows, 6, 3, 4)


def test_only_changes_are_applied():
    before = C.Centroids([[1, 2, 3], [4, 5, 6], [7, 8, 1 << 40]])
    after = C.Centroids([[1, 9, 3], [4, 5, 6], [7, 8, 9]], before)
    assert [c[0].tolist() if c else None for c in after.changes] == [[1], [], None]


@pytest.mark.parametrize("value", [0, -1, 1 << 31, -(1 << 31), (1 << 200) + 5, -(1 << 200) - 5, -(1 << 63)])
def test_limbs(value):
    assert sum(v << (C.LIMB * i) for i, v in C.limbs(value)) == value
