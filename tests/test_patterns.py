"""Patterns of text columns, and the regular expressions made of them."""

import re

import pytest

from plumbline.operators import checks, patterns as P, rules


def found(df, **options):
    return {r.column_name: (r.step, r.pattern, r.matches, r.support) for r in P.value_patterns(df, **options).collect()}


def test_the_first_step_that_covers_enough(spark):
    rows = [(f"AB-{i:04}", f"{i}-x", f"{'Ab' * (i % 3 + 1)}", f"{'aB3'[i % 3:]}{i}", "?" if i % 2 else "!", i) for i in range(40)]
    rows += [(None, None, None, None, None, 1)] * 5
    df = spark.createDataFrame(rows, "a string, b string, c string, `D.d` string, e string, n int").repartition(3)
    assert found(df) == {
        "a": (0, "AA-9999", 40, 40), "b": (1, "9-a", 40, 40), "c": (2, "L", 40, 40), "D.d": (3, "X", 40, 40),
    }
    assert found(df, columns=["e"], min_confidence=0.5) == {"e": (0, "!", 20, 40)}


@pytest.mark.parametrize("rows", [[], [(None,)] * 3, [("",)] * 3, [("x" * 100,)] * 3])
def test_columns_without_a_pattern(spark, rows):
    df = spark.createDataFrame(rows, "v string")
    assert found(df) == {} and P.pattern_rules(df, "t").collect() == []
    assert found(spark.range(3)) == {}


@pytest.mark.parametrize("value", ["Ab1", "a.b*c", "(+49) 170 12", "é\n1", "\\d$^", "AAAbbb", "--", "x]y["])
def test_regex_matches_what_it_was_made_of(spark, value):
    df = spark.createDataFrame([(value,)] * 3 + [(None,)], "v string")
    rule = P.pattern_rules(df, "t").first()
    assert rule.rule_type == checks.REGEX and rule.confidence == 1.0
    regex = rule.params.regex
    assert re.search(regex.replace(r"\z", r"\Z"), value)
    both = spark.createDataFrame([(value,), (value + "\n",), ("#" + value,), (value + "é",)], "v string")
    assert [r[0] for r in both.select(checks.matches("v", regex)).collect()] == [True, False, False, False]


def test_rules_run(spark):
    df = spark.createDataFrame([(f"K{i}",) for i in range(99)] + [("bad",)], "code string")
    rule = P.pattern_rules(df, "t", min_confidence=0.9)
    assert rule.first().params.regex == r"^[A-Z]+[0-9]+\z"
    assert rules.run_rules(df, rule).first().violations == 1
