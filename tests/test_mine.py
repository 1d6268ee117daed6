"""Evidence for mined rules: one scan whatever the columns, and Spark's own meaning of values."""

import datetime
import decimal
import itertools
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import mine, profile
from plumbline.plans import flows

ROWS = [
    (1, 2, 3.0, 1.5, datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 5), decimal.Decimal("1.50")),
    (2, 2, 4.0, math.nan, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2), decimal.Decimal("2.00")),
    (None, 5, math.nan, math.nan, None, datetime.datetime(2024, 1, 1), None),
    (100_000, 100_000, 2e5, 1e10, datetime.date(1960, 1, 1), datetime.datetime(1959, 1, 1), decimal.Decimal("-3.25")),
    (2_000_000_000, 2_000_000_000, math.inf, -math.inf, datetime.date(2024, 1, 1), None, decimal.Decimal("0.00")),
    (-7, 0, -7.0, -0.0, datetime.date(2024, 3, 1), datetime.datetime(2024, 3, 1), decimal.Decimal("7.00")),
]


@pytest.fixture(scope="module")
def odd(spark):
    kinds = "a int, b int, c double, d double, e date, f timestamp, g decimal(9,2)"
    return spark.createDataFrame(ROWS, kinds).repartition(3)


@pytest.mark.parametrize("arrow_pairs", [200, 0])
def test_orders_are_those_of_spark(odd, arrow_pairs, monkeypatch):
    monkeypatch.setattr(mine, "ARROW_PAIRS", arrow_pairs)
    pairs = [*itertools.combinations("abcdg", 2), ("e", "f")]
    got = {(r.a, r.b): (r.less, r.equal, r.greater, r.support) for r in mine.order_support(odd, pairs).collect()}
    for x, y in pairs:
        p, q = F.col(x), F.col(y)
        want = odd.agg(F.count_if(p < q), F.count_if(p == q), F.count_if(p > q), F.count_if(p.isNotNull() & q.isNotNull())).first()
        assert got[x, y] == tuple(want), (x, y)


def test_equations_are_those_of_spark(odd):
    found = mine.arithmetic_support(odd, list("abcg")).collect()
    assert len(found) == 4 * 3 * 2
    for r in found:
        combine = {"ADD": F.try_add, "MULTIPLY": F.try_multiply}[r.operator]
        value = combine(F.col(r.a), F.col(r.b))
        known = value.isNotNull() & F.col(r.target).isNotNull()
        gap = F.try_subtract(F.col(r.target), value)
        want = odd.agg(F.count_if((gap <= 0) & (gap >= 0)), F.count_if(known)).first()
        assert (r.holds, r.support) == tuple(want), r


def test_wide_tables_take_one_scan(spark, tmp_path):
    columns = [F.lit(i).cast("double").alias(f"c{i}") for i in range(60)] + [F.lit(str(i)).alias(f"s{i}") for i in range(30)]
    spark.range(100).select(*columns).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    numbers = [f"c{i}" for i in range(60)]
    assert plan(mine.order_support(df, list(itertools.combinations(numbers, 2)))).count("FileScan") == 1
    assert plan(mine.arithmetic_support(df, numbers[:20])).count("FileScan") == 1
    assert plan(mine.conditional_support(df, [f"s{i}" for i in range(30)])).count("FileScan") == 1


def test_durations_are_counted(spark):
    start = datetime.datetime(2024, 1, 1)
    minutes = [30] * 250 + [10_000, -5]
    df = spark.createDataFrame([(start, start + datetime.timedelta(minutes=m)) for m in minutes], "a timestamp, b timestamp")
    found = {r.conditions[0].operator: r for r in mine.duration_rules(df, "t", [("a", "b")]).collect()}
    assert (found["LTE"].conditions[0].value, found["LTE"].conditions[0].unit) == (30.0, "MINUTE")
    assert found["LTE"].confidence == 250 / 251
    assert (found["GTE"].conditions[0].value, found["GTE"].confidence) == (30.0, 1.0)


def test_mined_flow_has_no_caps(spark):
    """1500 codes decide 40 towns, a flag decides a level, and 20 rows decide a label."""
    rows = [(k, k % 1500, (k % 1500) % 40, bool(k % 3), int(k % 3 > 0), "x" if k < 20 else f"v{k % 7}", "p" if k < 20 else f"q{k % 5}", 70_000 + k % 900)
            for k in range(6000)]
    df = spark.createDataFrame(rows, "id int, postal int, town int, flag boolean, level int, s string, v string, width int")
    df = df.withColumns({"depth": F.col("width") + 1, "items": F.col("width") + 7})
    profiled = profile.profile(df, "t", primary_keys=["id"])
    mined = flows.mine_rules(df, "t", profiled).collect()
    dependencies = {tuple(r.target_columns) for r in mined if r.rule_type == "FUNCTIONAL_DEPENDENCY"}
    assert ("postal", "town") in dependencies
    conditional = [r for r in mined if r.rule_type == "CONDITIONAL_DEPENDENCY"]
    small = [r for r in conditional if r.target_columns == ["s", "v"] and r.evidence["support"] == "20"]
    assert small and small[0].validation_status == "WARNING"
    assert any(r.target_columns == ["flag", "level"] for r in conditional)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_a_zone_across_a_change_of_clocks(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            """select * from values
               (timestamp_ntz'2024-03-10 02:30:00', timestamp_ntz'2024-03-10 03:15:00'),
               (timestamp_ntz'2024-11-03 01:30:00', timestamp_ntz'2024-11-03 01:30:00'),
               (timestamp_ntz'2024-03-10 03:15:00', timestamp_ntz'2024-03-10 02:45:00'),
               (null, timestamp_ntz'2024-03-10 02:45:00') as t(a, b)"""
        )
        r = mine.order_support(df, [("a", "b")]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (r.less, r.equal, r.greater, r.support) == (1, 1, 1, 3)
