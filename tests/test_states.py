"""Merged states against the state of the whole table, and sketches against exact figures."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import states as S

SCHEMA = "n long, x double, `t x` string, d date, ts timestamp, z timestamp_ntz, m map<string,int>, day int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    maybe = lambda v: None if rng.random() < 0.1 else v
    out = []
    for i in range(4000):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 10_000))
        x = float("nan") if i % 50 == 0 else rng.gauss(0, 1)
        out.append((maybe(i % 3000), maybe(x), maybe(rng.choice(["", " ", "a", "bb", "ccc"])), maybe(at.date()), maybe(at), maybe(at), {"a": i}, i % 5))
    return spark.createDataFrame(out, SCHEMA).repartition(4).cache()


def plain(df):
    return {r.column_name: r for r in S.read(df).collect()}


def test_merged_is_whole(spark, rows):
    parts = [S.state(rows.where(F.col("day") == i), "t", str(i)) for i in range(5)]
    empty = S.state(rows.where("day > 9"), "t", "none")
    early = parts[0].unionByName(parts[1]).unionByName(empty)
    late = parts[2].unionByName(parts[3]).unionByName(parts[4])
    twice = S.merged(S.merged(early).unionByName(S.merged(late)))
    whole, got = plain(S.state(rows, "t", "all")), plain(twice)
    assert set(got) == set(rows.columns)
    for c, r in whole.items():
        g = got[c]
        assert [g[k] for k in (*S.COUNTERS, "low", "high")] == [r[k] for k in (*S.COUNTERS, "low", "high")], c
        assert g.distinct_estimate == pytest.approx(r.distinct_estimate, rel=6 * S.DISTINCT_ERROR)


def test_sketches_are_near_exact_figures(rows):
    got = plain(S.state(rows, "t", "all"))
    for c in ("n", "x", "t x", "d", "ts", "z"):
        exact = rows.select(F.countDistinct(f"`{c}`")).first()[0]
        assert got[c].distinct_estimate == pytest.approx(exact, rel=6 * S.DISTINCT_ERROR)
    values = sorted(r[0] for r in rows.where("x is not null and not isnan(x)").select("x").collect())
    for q, v in zip((0.25, 0.5, 0.75), got["x"].quantiles):
        rank = sum(x <= v for x in values) / len(values)
        assert abs(rank - q) < 3 * S.RANK_ERROR
    assert got["m"].low is None and got["m"].quantiles == [None] * 3


def test_no_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = plain(S.merged(S.state(df, "t", "1").unionByName(S.state(df, "t", "2"))))
    assert {c: (r.rows, r.nulls, r.low, r.distinct_estimate, r.part) for c, r in got.items()} == {c: (0, 0, None, 0, "2") for c in "ab"}
