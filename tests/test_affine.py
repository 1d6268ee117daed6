"""Equations with coefficients."""

import random

from plumbline.operators import affine, rules

NAMES = "a double, b int, c decimal(10,2), d double, e double, one double, f double"


def rows(n: int = 400, wrong: float = 0.0):
    draw = random.Random(2)
    for i in range(n):
        a, b, c = draw.randint(-50, 50) / 4, draw.randint(0, 9), draw.randint(0, 10_000) / 100
        d = 0.1 * a - 2 * b + 3.5 if draw.random() >= wrong else 777.0
        yield [a, b, c, None if i % 5 == 0 else d, float("nan") if i % 7 == 0 else -3 * c + 1, 4.0, draw.random()]


def found(df, **options):
    columns = df.columns
    return {
        (r.target, tuple(r.operands)): (tuple(r.coefficients), r.support, r.holds)
        for r in affine.affine_support(df, columns, **options).collect()
    }


def frame(spark, made):
    from decimal import Decimal

    return spark.createDataFrame([[x[0], x[1], Decimal(str(x[2])), *x[3:]] for x in made], NAMES)


def test_planted_equations_and_no_others(spark):
    made = list(rows())
    got = found(frame(spark, made))
    assert got == {
        ("d", ("a", "b")): ((0.1, -2.0, 3.5), 320, 320),
        ("e", ("c",)): ((-3.0, 1.0), 342, 342),
    }


def test_counts_of_rows_that_break_one(spark):
    made = list(rows(wrong=0.04))
    broken = sum(x[3] == 777.0 for x in made)
    got = found(frame(spark, made), min_confidence=0.9)
    assert broken > 3 and got[("d", ("a", "b"))] == ((0.1, -2.0, 3.5), 320, 320 - broken)
    assert ("d", ("a", "b")) not in found(frame(spark, made), min_confidence=0.999)


def test_repeated_rows_and_empty_tables(spark):
    df = frame(spark, list(rows(60)))
    same = df.limit(1)
    for _ in range(10):
        same = same.unionByName(same)
    assert ("e", ("c",)) in found(df.unionByName(df))
    assert found(same) == {} and found(df.limit(0)) == {}


def test_rules_run(spark):
    df = frame(spark, list(rows(wrong=0.04)))
    mined = affine.affine_rules(df, "t", df.columns, 0.9)
    ran = {r.rule_id: r for r in rules.run_rules(df, mined).collect()}
    for r in mined.collect():
        run = ran[r.rule_id]
        broken = float(r.evidence["support"]) - float(r.evidence["holds"])
        assert run.status != "ERROR" and run.violations == broken
