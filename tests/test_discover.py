"""Keys, dependencies and references against brute force, with nulls, ties and few groups sampled."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from plumbline.operators import checks, discover as D


def present(rows, s):
    return [tuple(r[i] for i in s) for r in rows if all(r[i] is not None for i in s)]


def brute_keys(rows, n, most, share):
    allowed = int((1 - share) * len(rows) + 1e-9)
    usable = [i for i in range(n) if len(present(rows, [i])) > 1]
    repeats = {}
    for size in range(1, most + 1):
        for s in combinations(usable, size):
            values = present(rows, s)
            repeats[frozenset(s)] = (len(values) - len(set(values)), len(values))
    good = [s for s, (k, _) in repeats.items() if k <= allowed]
    out = set()
    for s in good:
        below = [t for t in good if t < s]
        if any(repeats[t][0] == 0 for t in below):
            continue
        if repeats[s][0] == 0 or not below:
            out.add((tuple(sorted(s)), repeats[s][1], repeats[s][0], "KEY" if repeats[s][0] == 0 else "NEAR_KEY"))
    return out


def brute_dependencies(rows, n, most, share):
    allowed = int((1 - share) * len(rows) + 1e-9)
    repeats = lambda s: len(v := present(rows, sorted(s))) - len(set(v))
    usable = [i for i in range(n) if len(set(present(rows, [i]))) > 1]
    sets = [frozenset(s) for size in range(1, most + 1) for s in combinations(usable, size)]
    unique = [s for s in sets if repeats(s) <= allowed]
    held = {}
    for s in sets:
        if any(u <= s for u in unique):
            continue
        for c in usable:
            if c not in s:
                groups = defaultdict(Counter)
                for *x, v in present(rows, [*sorted(s), c]):
                    groups[tuple(x)][v] += 1
                support = sum(sum(g.values()) for g in groups.values())
                removals = support - sum(max(g.values()) for g in groups.values())
                if removals <= allowed:
                    held[s, c] = (len(groups), support, removals)
    return {
        (tuple(sorted(s)), c, *v)
        for (s, c), v in held.items()
        if v[0] < v[1] and not any(t < s and d == c for t, d in held)
    }


NAMES = ["a", "b", "c", "D e", "f`g"]
KINDS = "a int, b string, c double, `D e` date, `f``g` array<int>"


def frame(spark, n, seed=1):
    import datetime

    rng = random.Random(seed)
    maybe = lambda v, p=0.1: None if rng.random() < p else v
    rows = []
    for i in range(n):
        a, b = rng.randint(0, 9), rng.choice("xyz")
        c = float(a * 10 + ord(b)) if rng.random() > 0.02 else -1.0
        rows.append((maybe(a), maybe(b), maybe(c), datetime.date(2024, 1, 1 + rng.randint(0, 27)), [i // 2, rng.randint(0, 1)]))
    return rows, spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(params=[32])
def sample(request, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE", request.param)
    monkeypatch.setattr(D, "SETS_PER_PASS", 8)
    monkeypatch.setattr(D, "MERGED_AT_ONCE", 2)


def plain(rows):
    return [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows]


@pytest.mark.parametrize("share", [1.0, 0.9])
def test_keys(spark, sample, share):
    rows, df = frame(spark, 300)
    got = {(tuple(NAMES.index(c) for c in r.columns), r.rows, r.repeats, r.kind) for r in D.keys(df, min_confidence=share).collect()}
    assert got == brute_keys(plain(rows), 5, 3, share)


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_dependencies(spark, sample, share):
    rows, df = frame(spark, 300, 2)
    found = D.composite_dependencies(df, min_confidence=share).collect()
    got = {(tuple(NAMES.index(c) for c in r.determinant), NAMES.index(r.dependent), r.n_values, r.support, r.removals) for r in found}
    want = brute_dependencies(plain(rows), 5, 2, share)
    assert got == want and (share == 1.0 or want)


@pytest.mark.parametrize("rows", [[], [(1, "x")], [(None, None)] * 3])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string")
    assert D.keys(df).collect() == []
    assert D.composite_dependencies(df).collect() == []


def test_types_without_equality_are_left_out(spark):
    df = spark.sql("select id as a, map(id, 1) as m, null as z from range(5)")
    assert [r.columns for r in D.keys(df).collect()] == [["a"]]


def test_merged_samples_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    hashes = rng.choice(rng.integers(0, 1 << 62, 3000, dtype=np.uint64), 20_000)
    values = rng.integers(-5, 5, (20_000, 2))
    one = np.ones(20_000, np.int64)
    parts = []
    for at in np.array_split(np.arange(20_000), 7):
        s = D._Sample.empty(2)
        for b in np.array_split(at, 3):
            s = s.with_(len(b), hashes[b], one[b], values[b], values[b])
        parts.append(D._Sample.of(s.row(0), 2))
    merged = D._Sample.empty(2)
    for p in parts:
        merged = merged.with_(p.rows, p.hashes, p.n, p.low, p.high)
    smallest = np.unique(hashes)[: D.SAMPLE]
    assert merged.rows == 20_000 and (merged.hashes == smallest).all()
    for h, n, low, high in list(zip(merged.hashes, merged.n, merged.low, merged.high))[::50]:
        own = values[hashes == h]
        assert n == len(own) and (low == own.min(axis=0)).all() and (high == own.max(axis=0)).all()


def test_rules(spark):
    rows = [(i // 4, i % 4, (i // 4) * 10 + i % 4 // 2, i) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c int, k int")
    key = {tuple(r.target_columns): r for r in D.key_rules(df, "t").collect()}
    assert key["k",].rule_type == checks.UNIQUE and key["a", "b"].confidence == 1.0
    found = {tuple(r.target_columns): r for r in D.composite_dependency_rules(df, "t", columns=["a", "b", "c"], min_confidence=0.9).collect()}
    assert found["c", "a"].rule_type == checks.DEPENDENCY


def test_references(spark, monkeypatch):
    people = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(200)], "id long, name string, x int")
    visits = spark.createDataFrame(
        [(i, i % 150, f"n{i % 7}") for i in range(500)] + [(999, None, None)], "v_id int, people_id int, who string"
    )
    stray = spark.createDataFrame([(1000, "n1"), (5, "zz"), (6, "n2")], "people_id bigint, who string")
    empty = spark.createDataFrame([], "id int, name string")
    tables = {"people": people, "visits": visits, "stray": stray, "empty": empty}
    got = {(r.child_table, r.child_column, r.parent_table, r.parent_column, r.n_values, r.missing) for r in D.references(tables).collect()}
    want = set()
    near = set()
    at = {(t, c): {r[0] for r in df.select(f"`{c}`").collect() if r[0] is not None} for t, df in tables.items() for c in df.columns}
    rows = {(t, c): tables[t].where(f"`{c}` is not null").count() for t, c in at}
    for (t, c), v in at.items():
        for (u, p), w in at.items():
            if (t, c) != (u, p) and v and w and rows[u, p] == len(w) and type(next(iter(v))) is type(next(iter(w))):
                if v <= w:
                    want.add((t, c, u, p, len(v), 0))
                if len(v - w) <= 0.4 * len(v):
                    near.add((t, c, u, p, len(v), len(v - w)))
    assert got == want and want
    found = D.references(tables, 0.6)
    assert {(r.child_table, r.child_column, r.parent_table, r.parent_column, r.n_values, r.missing) for r in found.collect()} == near
    best = {(r.table_name, r.columns[0]): (r.ref_table, r.ref_columns[0]) for r in D.reference_constraints(D.references(tables)).collect()}
    assert best["visits", "people_id"] == ("people", "id") and best["visits", "who"] == ("people", "name")
    assert D.references({"a": empty}).collect() == []
    assert D.references({"a": spark.createDataFrame([(1.5,)], "x double")}).collect() == []


@pytest.fixture
def small_steps(monkeypatch, sample):
    """So small chunks, buckets and arrays that every way is taken."""
    for name, value in {"SAMPLED_ROWS": 16, "CHUNK_ROWS": 16, "CELLS": 40, "CODES": 8, "BUCKET_ROWS": 32}.items():
        monkeypatch.setattr(D, name, value)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("share", [1.0, 0.9])
def test_keys_in_small_steps(spark, small_steps, small_batches, share):
    rows, df = frame(spark, 300, 5)
    got = {(tuple(NAMES.index(c) for c in r.columns), r.rows, r.repeats, r.kind) for r in D.keys(df, min_confidence=share).collect()}
    assert got == brute_keys(plain(rows), 5, 3, share)


@pytest.mark.parametrize("share", [1.0, 0.8, 0.5])
def test_dependencies_in_small_steps(spark, small_steps, small_batches, share):
    rows, df = frame(spark, 300, 6)
    found = D.composite_dependencies(df, max_determinants=3, min_confidence=share).collect()
    got = {(tuple(NAMES.index(c) for c in r.determinant), NAMES.index(r.dependent), r.n_values, r.support, r.removals) for r in found}
    assert got == brute_dependencies(plain(rows), 5, 3, share)


def test_hot_value_with_many_dependents(spark, small_steps, small_batches):
    rows = [(0 if i % 5 < 2 else i // 10, i if i % 5 < 2 else i // 10) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(3)
    found = {(*r.determinant, r.dependent): r[2:] for r in D.composite_dependencies(df, min_confidence=0.6).collect()}
    assert found["a", "b"] == next((n, s, r) for x, c, n, s, r in brute_dependencies(rows, 2, 1, 0.6) if (x, c) == ((0,), 1))


def test_rows_of_known_groups_are_not_sorted(monkeypatch):
    """the rows of a set with few values were all sorted into its sample, batch by batch."""
    import pyarrow as pa
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    names = ["c0", "c1", "c2"]
    values = rng.choice(rng.integers(-(1 << 62), 1 << 62, 6), (50_000, 3))
    values[:, 2] = values[:, 0] ^ 5
    values[7, 2] += 1
    none = rng.random((50_000, 3)) < 0.1
    batches = [
        pa.RecordBatch.from_arrays([pa.array(values[at, c], mask=none[at, c]) for c in range(3)], names=names)
        for at in np.array_split(np.arange(50_000), 10)
    ]
    monkeypatch.setattr(D, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    sorted_rows, with_ = [], D._Sample.with_
    monkeypatch.setattr(D._Sample, "with_", lambda self, rows, hashes, *a: sorted_rows.append(len(hashes)) or with_(self, rows, hashes, *a))
    monkeypatch.setattr(D, "SAMPLED_ROWS", 1000)
    sets = [[0], [0, 1], [2]]
    out = pa.Table.from_batches(D._sampled(sets, 3)(iter(batches))).to_pylist()
    assert sum(sorted_rows) <= 3 * 10_000
    for s, row in zip(sets, out):
        own = D._Sample.of(row, 3)
        groups = defaultdict(list)
        for i in np.flatnonzero(~none[:, s].any(axis=1)):
            groups[tuple(values[i, s])].append(i)
        assert row["rows"] == own.n.sum() == sum(map(len, groups.values()))
        assert sorted(own.n) == sorted(map(len, groups.values()))
        broken = [sum(len({values[i, c] for i in g if not none[i, c]}) > 1 for g in groups.values()) for c in range(3)]
        assert (own.low < own.high).sum(axis=0).tolist() == broken


def test_only_near_keys_are_counted(spark, monkeypatch):
    """sets with a near key were counted although a repeat in the sample shows that they are no keys."""
    counted, count = [], D._Lattice.count

    def noted(self, sets):
        sets = list(sets)
        counted.extend(sets)
        count(self, sets)

    monkeypatch.setattr(D, "SAMPLE", 64)
    monkeypatch.setattr(D._Lattice, "count", noted)
    df = spark.range(2000).selectExpr("if(id % 20 = 0, id + 1, id) as a", "id div 4 as b", "id div 500 as c")
    found = [(r.columns, r.kind) for r in D.keys(df, max_columns=2, min_confidence=0.9).collect()]
    assert found == [(["a"], "NEAR_KEY")]
    assert {"a"} in counted and {"a", "b"} not in counted and {"a", "c"} not in counted


def test_pairs_refuted_by_chunks_are_not_grouped(spark, monkeypatch):
    """few groups that differ refute nothing by their number, but by the rows to remove."""
    grouped, dealt = [], D._pairs_dealt
    monkeypatch.setattr(D, "_pairs_dealt", lambda pairs, *a: grouped.extend(pairs) or dealt(pairs, *a))
    df = spark.range(3000).selectExpr("id % 3 as a", "id % 7 as b", "if(id % 100 = 0, 9, id % 7 div 2) as c").repartition(3)
    found = {(*r.determinant, r.dependent): r.removals for r in D.composite_dependencies(df, min_confidence=0.95).collect()}
    assert found == {("b", "c"): 30}
    assert grouped[0] == ([1], 2) and len(grouped) < 3


def test_hashes_that_agree_in_one_half_are_told_apart():
    x, y = np.array([5, 1, 5, 5, 1], np.uint64), np.array([2, 3, 1, 2, 3], np.uint64)
    order, start = D._in_order(x, y)
    assert len(start) == 3 and [(x[i], y[i]) for i in order[start]] == [(1, 3), (5, 1), (5, 2)]
    (codes, n), = D._coded([(h.view(np.int64), None) for h in (x, y)], 1)
    assert n == 3 and codes[0] == codes[3] and codes[1] == codes[4] and len(set(codes)) == 3
