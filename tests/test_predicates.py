"""Conditions on rows: nulls on each side, equal values, bounds, and bad rules."""

import datetime as dt
import itertools
import operator as op

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import predicates
from plumbline.operators.predicates import RuleError

VALUES = [None, 0, 1, 2]
SIGNS = {"EQ": op.eq, "NEQ": op.ne, "GT": op.gt, "GTE": op.ge, "LT": op.lt, "LTE": op.le}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(itertools.product(VALUES, repeat=3))]
    return spark.createDataFrame(rows, "i int, a int, b int, c int")


def held(df, *columns):
    """The columns per row, in row order."""
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def both_forms(df, cond):
    return held(df, predicates.condition(cond), predicates.condition(cond, negate=True))


def unknown_or(f, *args):
    return None if None in args else f(*args)


@pytest.mark.parametrize("name", SIGNS)
def test_comparison(grid, name):
    cond = {"type": "COMPARISON", "left": "a", "operator": name, "right": {"type": "column", "value": "b"}}
    want = [unknown_or(SIGNS[name], a, b) for a, b, _ in itertools.product(VALUES, repeat=3)]
    assert both_forms(grid, cond) == [(w, None if w is None else not w) for w in want]


@pytest.mark.parametrize("name", SIGNS)
def test_comparison_with_literal(grid, name):
    cond = {"type": "COMPARISON", "left": "a", "operator": name, "right": {"type": "literal", "value": 1}}
    want = [unknown_or(SIGNS[name], a, 1) for a, _, _ in itertools.product(VALUES, repeat=3)]
    assert both_forms(grid, cond) == [(w, None if w is None else not w) for w in want]


def test_null_check_and_set(grid):
    null = {"type": "NULL_CHECK", "column": "a", "operator": "IS_NULL"}
    inside = {"type": "SET", "left": "a", "operator": "IN", "values": [1, 2]}
    got = held(
        grid,
        predicates.condition(null),
        predicates.condition(null, negate=True),
        predicates.condition(inside),
        predicates.condition(inside, negate=True),
    )
    for (a, _, _), row in zip(itertools.product(VALUES, repeat=3), got):
        is_in = None if a is None else a in (1, 2)
        assert row == (a is None, a is not None, is_in, None if is_in is None else not is_in)


@pytest.mark.parametrize("name", ["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"])
@pytest.mark.parametrize("sign", SIGNS)
def test_arithmetic(grid, name, sign):
    ops = {"ADD": op.add, "SUBTRACT": op.sub, "MULTIPLY": op.mul, "DIVIDE": op.truediv}
    cond = {
        "type": "ARITHMETIC", "target": "a", "comparison_operator": sign,
        "expression": {"operator": name, "operands": ["b", "c"]},
    }
    want = []
    for a, b, c in itertools.product(VALUES, repeat=3):
        if None in (a, b, c) or (name == "DIVIDE" and c == 0):
            want.append((None, None))
        else:
            w = SIGNS[sign](a, ops[name](b, c))
            want.append((w, not w))
    assert both_forms(grid, cond) == want


def test_arithmetic_goes_left_to_right_and_takes_a_tolerance(spark):
    df = spark.createDataFrame([(1, 2.0, 20.0, 5.0, 2.0), (2, 0.3, 0.1, 0.2, 1.0)], "i int, t double, a double, b double, c double")
    divide = {"type": "ARITHMETIC", "target": "t", "comparison_operator": "EQ", "expression": {"operator": "DIVIDE", "operands": ["a", "b", "c"]}}
    add = {"type": "ARITHMETIC", "target": "t", "comparison_operator": "EQ", "expression": {"operator": "ADD", "operands": ["a", "b"]}}
    got = held(df, predicates.condition(divide), predicates.condition(add), predicates.condition(add | {"tolerance": 1e-9}))
    assert got == [(True, False, False), (False, False, True)]


T0 = dt.datetime(2024, 3, 1, 12)


@pytest.mark.parametrize(
    ("unit", "value", "step"),
    [
        ("DAY", 2, dt.timedelta(days=2)),
        ("HOUR", 36, dt.timedelta(hours=36)),
        ("MINUTE", 90, dt.timedelta(minutes=90)),
        ("DAY", 0.5, dt.timedelta(hours=12)),
    ],
)
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_duration_on_and_around_the_bound(spark, unit, value, step, kind):
    tick = dt.timedelta(seconds=1)
    rows = [(0, T0, T0 + step - tick), (1, T0, T0 + step), (2, T0, T0 + step + tick), (3, None, T0), (4, T0, None)]
    df = spark.createDataFrame(rows, f"i int, s {kind}, e {kind}")
    want = {"LT": (True, False, False), "LTE": (True, True, False), "GT": (False, False, True), "GTE": (False, True, True)}
    for name, row in want.items():
        cond = {"type": "DURATION", "start_column": "s", "end_column": "e", "operator": name, "value": value, "unit": unit}
        assert both_forms(df, cond) == [(w, not w) for w in row] + [(None, None)] * 2


def test_temporal_order_on_dates(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(0, d, d), (1, d, d + dt.timedelta(1)), (2, d, None)], "i int, a date, b date")
    for name, sign in {"BEFORE": op.lt, "BEFORE_EQUAL": op.le, "AFTER": op.gt, "AFTER_EQUAL": op.ge}.items():
        cond = {"type": "TEMPORAL_ORDER", "left": "a", "operator": name, "right": "b"}
        good = [sign(d, d), sign(d, d + dt.timedelta(1))]
        assert both_forms(df, cond) == [(g, not g) for g in good] + [(None, None)]


def test_empty_and_or(grid):
    assert set(held(grid, predicates.all_of([]), predicates.any_of([]))) == {(True, False)}


IF_THEN = [
    {"role": "IF", "type": "COMPARISON", "left": "a", "operator": "EQ", "right": {"type": "literal", "value": 1}},
    {"role": "THEN", "type": "NULL_CHECK", "column": "b", "operator": "IS_NOT_NULL"},
    {"role": "THEN", "type": "COMPARISON", "left": "c", "operator": "GT", "right": {"type": "literal", "value": 0}},
]


def test_dependency_is_broken_by_any_consequence(grid):
    bad = held(grid, F.coalesce(predicates.violation("CONDITIONAL_DEPENDENCY", IF_THEN), F.lit(False)))
    for (a, b, c), (got,) in zip(itertools.product(VALUES, repeat=3), bad):
        assert got == (a == 1 and (b is None or (c is not None and c <= 0)))


def test_valid_and_violation_never_both_hold(grid):
    got = held(
        grid,
        predicates.valid("CONDITIONAL_DEPENDENCY", IF_THEN),
        predicates.violation("CONDITIONAL_DEPENDENCY", IF_THEN),
    )
    assert all(g is None and b is None or g is (not b) for g, b in got)


COMPARE = {"type": "COMPARISON", "left": "a", "operator": "EQ", "right": {"type": "column", "value": "b"}}


@pytest.mark.parametrize(
    ("rule_type", "conditions"),
    [
        ("CROSS_COLUMN", []),
        ("UNKNOWN", [COMPARE]),
        ("TEMPORAL", [COMPARE]),
        ("CROSS_COLUMN", [COMPARE | {"operator": "LIKE"}]),
        ("CROSS_COLUMN", [COMPARE | {"right": "b"}]),
        ("CROSS_COLUMN", [COMPARE | {"right": {"type": "table", "value": "b"}}]),
        ("CROSS_COLUMN", [{"type": "COMPARISON", "operator": "EQ"}]),
        ("CONDITIONAL_DEPENDENCY", [COMPARE]),
        ("CONDITIONAL_DEPENDENCY", [COMPARE | {"role": "IF"}]),
        ("CONDITIONAL_DEPENDENCY", [COMPARE | {"role": "THEN"}]),
        ("CONDITIONAL_DEPENDENCY", [COMPARE | {"role": "IF"}, {"role": "THEN", "type": "SET", "left": "a", "operator": "IN", "values": []}]),
        ("TEMPORAL", [{"type": "DURATION", "start_column": "a", "end_column": "b", "operator": "LT", "value": 0, "unit": "DAY"}]),
        ("TEMPORAL", [{"type": "DURATION", "start_column": "a", "end_column": "b", "operator": "EQ", "value": 1, "unit": "DAY"}]),
        ("TEMPORAL", [{"type": "DURATION", "start_column": "a", "end_column": "b", "operator": "LT", "value": 1, "unit": "WEEK"}]),
        ("CROSS_COLUMN", [{"type": "ARITHMETIC", "target": "a", "comparison_operator": "EQ", "expression": {"operator": "ADD", "operands": ["b"]}}]),
        ("CROSS_COLUMN", [{"type": "ARITHMETIC", "target": "a", "comparison_operator": "EQ", "expression": {"operator": "POWER", "operands": ["b", "c"]}}]),
    ],
)
def test_bad_rules_are_refused(spark, rule_type, conditions):
    with pytest.raises(RuleError):
        predicates.violation(rule_type, conditions)


def test_conditions_survive_the_rules_table(spark):
    conditions = [
        *IF_THEN,
        COMPARE,
        {"type": "SET", "left": "a", "operator": "NOT_IN", "values": ["x", 1, 2.5]},
        {"type": "ARITHMETIC", "target": "a", "comparison_operator": "LTE", "tolerance": 0.1, "expression": {"operator": "ADD", "operands": ["b", "c"]}},
        {"type": "TEMPORAL_ORDER", "left": "a", "operator": "BEFORE", "right": "b"},
        {"type": "DURATION", "start_column": "a", "end_column": "b", "operator": "LT", "value": 3.0, "unit": "DAY"},
    ]
    df = spark.createDataFrame([predicates.to_struct(c) for c in conditions], schemas.CONDITION)
    assert [predicates.from_struct(r.asDict()) for r in df.collect()] == conditions
    assert predicates.columns_of(conditions) == ["a", "b", "c"]
