"""Column and key checks against plain Python, on awkward values and on skewed keys."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import checks, skew
from plumbline.operators import rules as rule_ops

TEXTS = [None, "", " ", "\t\n", "　", "a", "A", " b ", "12", "-3.5", "1e3", "1.5d", "2f", "nan", "inf", "abc", "x" * 300]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def passed(df, check):
    return [r[0] for r in df.orderBy("i").select(check).collect()]


def python_between(v, low, high):
    if v is None:
        return True
    try:
        x = float(v)
    except (ValueError, TypeError):
        return True
    return not ((low is not None and x < low) or (high is not None and x > high))


def test_not_null(texts):
    want = [v is not None and v.strip() != "" for v in TEXTS]
    assert passed(texts, checks.not_null("t", T.StringType())) == want


@pytest.mark.parametrize(("low", "high"), [(0, 100), (None, 5), (13, None), (None, None), (-3.5, 12)])
def test_between_on_text(texts, low, high):
    want = [python_between(v, low, high) for v in TEXTS]
    assert passed(texts, checks.between("t", T.StringType(), low, high)) == want


@pytest.mark.parametrize(("low", "high"), [(0, 100), (None, 5.5), (1.5, None), (None, None), (2.2, 2.8)])
@pytest.mark.parametrize("kind", ["int", "bigint", "double", "float", "decimal(10,2)"])
def test_between_on_numbers(spark, kind, low, high):
    values = [None, -1, 0, 1, 2, 3, 5, 6, 100, 101]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").selectExpr("i", f"CAST(v AS {kind}) AS v")
    want = [python_between(v, low, high) for v in values]
    assert passed(df, checks.between("v", df.schema["v"].dataType, low, high)) == want


def test_between_passes_nan_and_checks_infinity(spark):
    values = [math.nan, math.inf, -math.inf, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert passed(df, checks.between("v", T.DoubleType(), 0, 5)) == [True, False, False, True]
    assert passed(df, checks.between("v", T.DoubleType(), 0)) == [True, True, False, True]


def test_between_beyond_exact_doubles(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(0, big), (1, big - 2)], "i int, v bigint")
    assert passed(df, checks.between("v", T.LongType(), float(big), None)) == [True, False]


def test_in_set_and_length(texts):
    allowed = ["A", "Abc", 12]
    low = [str(a).lower() for a in allowed]
    want = [v is None or v.lower() in low for v in TEXTS]
    assert passed(texts, checks.in_set("t", allowed)) == want
    assert passed(texts, checks.in_set("t", [])) == [v is None for v in TEXTS]
    want = [v is None or 1 <= len(v) <= 3 for v in TEXTS]
    assert passed(texts, checks.length_between("t", 1, 3)) == want


def test_pattern_and_expression(texts):
    assert passed(texts, checks.matches("t", "^[0-9]+$")) == [v is None or (v or "").isdigit() and v != "" for v in TEXTS]
    assert passed(texts, checks.holds("t = 'a'")) == [v in (None, "a") for v in TEXTS]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; others repeat a little or not at all; long keys too."""
    rows = [("hot", i % 3, i) for i in range(300)]
    rows += [(f"k{i % 250}", i % 2, i) for i in range(400)]
    rows += [(f"single{i}", 0, i) for i in range(190)]
    rows += [("long " * 50 + str(i % 3), 1, i) for i in range(6)]
    rows += [(None, None, i) for i in range(10)] + [("hot", None, 7)]
    return rows, spark.createDataFrame(rows, "k string, v int, w int").repartition(7)


def test_repeated_rows_of_skewed_keys(skewed, few_hot_keys):
    rows, df = skewed
    counts = Counter(k for k, _, _ in rows)
    want = sorted((k, v if v is not None else -1, w, counts[k]) for k, v, w in rows if k is not None and counts[k] > 1)
    got = checks.repeated_rows(df, ["k"]).collect()
    assert sorted((r.k, r.v if r.v is not None else -1, r.w, r.n) for r in got) == want


def test_dependency_breaks_of_skewed_keys(skewed, few_hot_keys):
    rows, df = skewed
    values = defaultdict(set)
    for k, v, _ in rows:
        if k is not None and v is not None:
            values[k].add(v)
    broken = {k for k, vs in values.items() if len(vs) > 1}
    assert {r.k for r in checks.dependency_breaks(df, ["k"], "v").collect()} == broken
    want = sorted(w for k, _, w in rows if k in broken)
    assert sorted(r.w for r in checks.dependency_break_rows(df, ["k"], "v").collect()) == want


def test_orphans_of_skewed_keys(spark, skewed, few_hot_keys):
    rows, df = skewed
    parents = spark.createDataFrame([(f"k{i}",) for i in range(100)] + [(None,)], "id string")
    known = {f"k{i}" for i in range(100)}
    counts = Counter(k for k, _, _ in rows if k is not None and k not in known)
    assert {r.k: r.n for r in checks.orphan_keys(df, ["k"], parents, ["id"]).collect()} == dict(counts)
    got = checks.orphan_rows(df, ["k"], parents, ["id"]).collect()
    assert Counter(r.k for r in got) == counts
    assert got[0].__fields__ == ["k", "v", "w"]


def test_primary_and_unique_key(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (None, "b"), (None, None), (None, None), (2, "a")]
    df = spark.createDataFrame(rows, "a int, b string")
    got = {(r.a, r.b): (r.n, r.problem) for r in checks.primary_key(df, ["a", "b"]).collect()}
    assert got == {(1, "a"): (2, "DUPLICATE"), (1, None): (1, "NULL"), (None, "b"): (1, "NULL"), (None, None): (2, "NULL")}
    assert [(r.a, r.b, r.n) for r in checks.unique_key(df, ["a", "b"]).collect()] == [(1, "a", 2)]


def test_look_up_keeps_every_row(spark, skewed, few_hot_keys):
    rows, df = skewed
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, found int")
    got = skew.look_up(df.where("k IS NOT NULL"), lookup, ["k"]).collect()
    want = Counter((k, {"hot": 1, "k3": 2}.get(k)) for k, _, _ in rows if k is not None)
    assert Counter((r.k, r.found) for r in got) == want


def test_run_rules_on_all_kinds(spark, skewed):
    rows, df = skewed
    rules = [
        {"rule_id": "u1", "rule_type": checks.UNIQUE, "target_columns": ["k"]},
        {"rule_id": "u2", "rule_type": checks.UNIQUE, "target_columns": ["w"]},
        {"rule_id": "n", "rule_type": checks.NOT_NULL, "target_columns": ["k", "v"]},
        {"rule_id": "c", "rule_type": checks.ROW_COUNT, "target_columns": [], "params": {"min_value": 10}},
        {"rule_id": "e", "rule_type": checks.BETWEEN, "target_columns": ["v"], "params": {"max_value": 5}, "edited_params": {"max_value": 0}},
    ]
    got = {r.rule_id: (r.rows, r.applicable, r.violations, r.status) for r in rule_ops.run_rules(df, rules).collect()}
    n = len(rows)
    ks, ws = Counter(r[0] for r in rows if r[0] is not None), Counter(r[2] for r in rows)
    assert got == {
        "u1": (n, sum(ks.values()), sum(c for c in ks.values() if c > 1), "FAILED"),
        "u2": (n, n, sum(c for c in ws.values() if c > 1), "FAILED"),
        "n": (n, n, sum(1 for r in rows if r[0] is None or r[1] is None), "FAILED"),
        "c": (n, 1, 0, "PASSED"),
        "e": (n, sum(r[1] is not None for r in rows), sum((r[1] or 0) > 0 for r in rows), "FAILED"),
    }
    assert rule_ops.run_rules(df, []).collect() == []


def test_unique_on_nested_values(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([2, 1],), (None,)], "a array<int>")
    rule = {"rule_id": "u", "rule_type": checks.UNIQUE, "target_columns": ["a"]}
    row = rule_ops.run_rules(df, [rule]).first()
    assert (row.rows, row.applicable, row.violations) == (4, 3, 2)
    assert rule_ops.violating_rows(df, rule).count() == 2


def test_rules_beyond_one_scan(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    rules = [
        {"rule_id": f"r{i}", "rule_type": checks.BETWEEN, "target_columns": ["id"], "params": {"max_value": i}}
        for i in range(250)
    ]
    got = {r.rule_id: r.violations for r in rule_ops.run_rules(df, rules).collect()}
    assert got == {f"r{i}": max(0, 99 - i) for i in range(250)}
    failed = rule_ops.failing_rules(df, rules).select(F.sum(F.size("failed"))).first()[0]
    assert failed == sum(got.values())


def test_unknown_columns_are_refused(spark):
    rule = {"rule_id": "x", "rule_type": checks.NOT_NULL, "target_columns": ["nope"]}
    with pytest.raises(rule_ops.RuleError):
        rule_ops.violating_rows(spark.range(3), rule)


def test_a_rule_that_cannot_be_checked_stops_no_other(spark):
    df = spark.createDataFrame([(1, 100_000, "abc"), (2, 7, "12")], "id int, n int, t string")
    rules = [
        {"rule_id": "gone", "rule_type": checks.NOT_NULL, "target_columns": ["nope"]},
        {"rule_id": "time", "rule_type": "CROSS_COLUMN", "conditions": [
            {"type": "ARITHMETIC", "target": "n", "comparison_operator": "EQ", "expression": {"operator": "MULTIPLY", "operands": ["n", "n"]}}]},
        {"rule_id": "text", "rule_type": "CROSS_COLUMN", "conditions": [
            {"type": "COMPARISON", "left": "t", "operator": "LTE", "right": {"type": "literal", "value": 5}}]},
        {"rule_id": "fine", "rule_type": checks.NOT_NULL, "target_columns": ["n"]},
        {"rule_id": "two", "rule_type": checks.UNIQUE, "target_columns": ["id", "n"]},
    ]
    got = {r.rule_id: r for r in rule_ops.run_rules(df, rules).collect()}
    assert got["gone"].status == "ERROR" and "nope" in got["gone"].message and got["gone"].pass_rate is None
    assert (got["time"].applicable, got["time"].violations) == (1, 1)
    assert (got["text"].applicable, got["text"].violations) == (1, 1)
    assert got["fine"].status == got["two"].status == "PASSED"
    named = [{**r, "table_name": n} for r, n in zip(rules[3:], ("a", "b"))]
    assert [r.rule_id for r in rule_ops.run_rules(df, named, "a").collect()] == ["fine"]


def test_range_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = df.schema["l_quantity"].dataType
    plan = df.where(checks.between_violation("l_quantity", kind, 2, 49))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(l_quantity,2.0),GreaterThan(l_quantity,49.0))]" in plan


def test_violation_filters_reach_the_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rule = {"rule_id": "x", "rule_type": checks.BETWEEN, "target_columns": ["l_linenumber"], "params": {"min_value": 1, "max_value": 6.5}}
    plan = rule_ops.violating_rows(lines, rule, ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(l_linenumber,1),GreaterThan(l_linenumber,6))]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_names_with_dots_and_ticks(spark):
    rows = [(1, "a", 1), (1, "a", 2), (2, "b", 1), (3, None, None)]
    df = spark.createDataFrame(rows, "`k.1` int, `v``2` string, `w x` int")
    assert [r.n for r in checks.key_counts(df, ["k.1"]).where("n > 1").collect()] == [2]
    assert checks.repeated_rows(df, ["k.1", "v`2"]).count() == 2
    assert checks.primary_key(df, ["v`2"]).count() == 2
    assert checks.dependency_break_rows(df, ["k.1"], "w x").count() == 2
    parents = spark.createDataFrame([(1,)], "`id.x` int")
    assert sorted(r["k.1"] for r in checks.orphan_rows(df, ["k.1"], parents, ["id.x"]).collect()) == [2, 3]
    rules = [
        {"rule_id": "u", "rule_type": checks.UNIQUE, "target_columns": ["k.1"]},
        {"rule_id": "n", "rule_type": checks.NOT_NULL, "target_columns": ["v`2"]},
    ]
    assert {r.rule_id: r.violations for r in rule_ops.run_rules(df, rules).collect()} == {"u": 2, "n": 1}
    assert rule_ops.violating_rows(df, rules[0], ["k.1"]).count() == 2
