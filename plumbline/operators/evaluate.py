"""Scoring of proposed rules and of their effect on labelled rows (EV-*)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import naming, numbers
from plumbline.operators import checks, rules as rule_ops
from plumbline.operators.skew import rows_of_keys

# Overlap of value sets, the duplicate key fault and the grades.
SET_OVERLAP = 0.7
DUPLICATE_KEY_FAULT = "DUPLICATE_PRIMARY_KEY"
GOOD_DETECTION, GOOD_F1 = 90.0, 80.0


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _share(part: Column, whole: Column, digits: int | None, empty: float = 0.0) -> Column:
    return _rounded(
        F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(empty)), digits
    )


# Rules against expected rules -------------------------------------------------------------


def _variants(rules: DataFrame) -> DataFrame:
    """Rules with all that matters for a match, and ``variant``, one digest of it."""
    kind, given = F.col("rule_type"), F.col("params")
    allowed = F.array_sort(F.array_distinct(F.transform(given["allowed_values"], F.lower)))
    is_length = kind == checks.LENGTH
    shaped = rules.select(
        "*",
        F.array_sort(F.transform("target_columns", F.lower)).alias("key"),
        F.when(kind == checks.IN_SET, allowed).alias("allowed"),
        F.when(is_length, given["min_length"]).alias("min_length"),
        F.when(is_length, given["max_length"]).alias("max_length"),
    )
    return shaped.withColumn("variant", F.sha2(F.to_json(F.struct(*VARIANT)), 256))


VARIANT = ["table_name", "rule_type", "key", "allowed", "min_length", "max_length"]


def matches(proposed: DataFrame, expected: DataFrame) -> DataFrame:
    """EV-1, 2: (table_name, rule_id, expected_index): the first expected rule each one meets.

    Same type and same columns, whatever their case and order. Value sets must share 70 % of
    the smaller one. Lengths must be equal where the expected rule gives them.

    Both sides are reduced to their distinct variants before they meet, so repeated proposals
    cost nothing; what is left to compare is what was written down for one column.
    """
    shared = ["table_name", "rule_type", "target_columns", "params"]
    mine = _variants(proposed.select("rule_id", *shared))
    theirs = _variants(expected.select("expected_index", *shared))
    left = mine.groupBy("variant", *VARIANT).agg(F.count(F.lit(1)).alias("n")).alias("p")
    right = theirs.groupBy(*VARIANT).agg(F.min("expected_index").alias("expected_index")).alias("e")
    allowed, wanted = F.col("p.allowed"), F.col("e.allowed")
    smaller = F.least(F.size(allowed), F.size(wanted))
    common = F.size(F.array_intersect(allowed, wanted))
    sets_meet = F.coalesce((smaller > 0) & (common >= smaller * SET_OVERLAP), F.lit(False))

    def same(field: str) -> Column:
        e, p = F.col(f"e.{field}"), F.col(f"p.{field}")
        return e.isNull() | e.eqNullSafe(p)

    kind = F.col("rule_type")
    fits = (
        F.when(kind == checks.IN_SET, sets_meet)
        .when(kind == checks.LENGTH, same("min_length") & same("max_length"))
        .otherwise(F.lit(True))
    )
    met = (
        left.join(right, ["table_name", "rule_type", "key"])
        .where(fits)
        .groupBy("variant")
        .agg(F.min("e.expected_index").alias("expected_index"), F.first("p.n").alias("n"))
    )
    return rows_of_keys(mine.select("table_name", "rule_id", "variant"), met, ["variant"], "n").select(
        "table_name", "rule_id", "expected_index"
    )


def rule_scores(
    proposed: DataFrame, expected: DataFrame, digits: int | None = None
) -> DataFrame:
    """EV-3: precision, recall and F1 per table in percent.

    Several proposals may meet one expected rule; precision counts them all. With ``digits``
    the three are rounded and F1 is taken from the rounded two.
    """
    met = matches(proposed, expected)
    hit = met.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("true_positives"),
        F.count_distinct("expected_index").alias("found_expected"),
    )
    made = proposed.groupBy("table_name").agg(F.count(F.lit(1)).alias("generated"))
    want = expected.groupBy("table_name").agg(F.count(F.lit(1)).alias("expected"))
    zero = F.lit(0)
    joined = (
        made.join(want, "table_name", "full")
        .join(hit, "table_name", "left")
        .select(
            "table_name",
            *[
                F.coalesce(c, zero).alias(c)
                for c in ("generated", "expected", "true_positives", "found_expected")
            ],
        )
        .withColumn("precision", _share(F.col("true_positives"), F.col("generated"), digits))
        .withColumn("recall", _share(F.col("found_expected"), F.col("expected"), digits))
    )
    precision, recall = F.col("precision"), F.col("recall")
    total = precision + recall
    f1 = F.when(total > 0, F.lit(2) * (precision * recall) / total).otherwise(F.lit(0.0))
    return joined.withColumn("f1", _rounded(f1, digits))


def missing_expected(proposed: DataFrame, expected: DataFrame) -> DataFrame:
    """EV-4: expected rules that no proposal met."""
    met = matches(proposed, expected).select("table_name", "expected_index").distinct()
    return expected.join(met, ["table_name", "expected_index"], "left_anti")


# Rules against labelled rows --------------------------------------------------------------


def tested_rows(
    records: DataFrame, rules: DataFrame | Iterable[Mapping[str, Any]], key: str = "id"
) -> DataFrame:
    """EV-5..7: every labelled row with the rules it breaks, as 'type:columns'.

    A row whose fault names a duplicate key is also caught when a unique rule exists and the
    key column repeats anywhere in the table.
    """
    rows = rule_ops.rule_rows(rules)
    failed = rule_ops.failing_rules(records, rows, labels=True)
    unique = any(r["rule_type"] == checks.UNIQUE for r in rows)
    if unique and key in records.columns:
        keys = records.where(F.col(key).cast("string") != "")
        repeats = checks.key_counts(keys, [key]).agg(
            F.coalesce(F.max("n") > 1, F.lit(False))
        )
        mark = F.array(F.lit(f"{checks.UNIQUE}:{key}"))
        caught = F.col("_injected_fault").contains(DUPLICATE_KEY_FAULT) & repeats.scalar()
        failed = failed.withColumn(
            "failed",
            F.when(caught & ~valid_label(), F.concat(mark, "failed")).otherwise(F.col("failed")),
        )
    return failed


def valid_label() -> Column:
    """SRC-4: a row without a label counts as clean."""
    return F.coalesce("_is_valid", F.lit(True))


def detection_scores(
    tested: DataFrame, table_name: str, digits: int | None = None
) -> DataFrame:
    """EV-5, 6: clean pass rate and defect detection of one table (100 where there are none)."""
    clean, caught = valid_label(), F.size("failed") > 0
    counted = tested.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(clean).alias("clean_records"),
        F.count_if(clean & ~caught).alias("clean_passed"),
        F.count_if(~clean).alias("defect_records"),
        F.count_if(~clean & caught).alias("caught_defects"),
    )
    return counted.select(
        F.lit(table_name).alias("table_name"),
        "*",
        _share(F.col("clean_passed"), F.col("clean_records"), digits, 100.0).alias("clean_pass_rate"),
        _share(F.col("caught_defects"), F.col("defect_records"), digits, 100.0).alias("detection_rate"),
    )


def scenarios(tested: DataFrame) -> DataFrame:
    """EV-7: per defect row: its fault, whether it was caught, and the first two rules."""
    return tested.where(~valid_label()).select(
        F.coalesce("_injected_fault", F.lit("Unknown defect")).alias("fault"),
        (F.size("failed") > 0).alias("is_detected"),
        F.slice("failed", 1, 2).alias("detected_by"),
    )


def expected_violations(tested: DataFrame) -> DataFrame:
    """EV-15: per defect row: expected but not detected, and detected beyond expectation."""
    want = F.coalesce("_expected_violations", F.array().cast("array<string>"))
    got = F.array_distinct("failed")
    missed, extra = F.array_except(want, got), F.array_except(got, want)
    return tested.where(~valid_label()).select(
        "*",
        F.array_sort(missed).alias("not_detected"),
        F.array_sort(extra).alias("not_expected"),
        (F.size(missed) == 0).alias("found_all"),
        ((F.size(missed) == 0) & (F.size(extra) == 0)).alias("exact"),
    )


def overall(scores: DataFrame, detection: DataFrame, digits: int | None = None) -> DataFrame:
    """EV-8: totals, plain means of the tables' percents, and a grade."""
    both = scores.join(detection, "table_name")
    mean = lambda c: _rounded(F.avg(c), digits)
    summed = both.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("generated").alias("rules_generated"),
        F.sum("expected").alias("rules_expected"),
        F.sum("true_positives").alias("true_positives"),
        mean("precision").alias("average_precision"),
        mean("recall").alias("average_recall"),
        mean("f1").alias("average_f1"),
        _share(F.sum("caught_defects"), F.sum("defect_records"), digits, 100.0).alias("detection_rate"),
        mean("clean_pass_rate").alias("clean_pass_rate"),
    )
    good = (F.col("detection_rate") >= GOOD_DETECTION) & (F.col("average_f1") >= GOOD_F1)
    return summed.withColumn("status", F.when(good, "EXCELLENT").otherwise("GOOD"))


# Rules against profiles -------------------------------------------------------------------


def safety(rules: DataFrame, profile: DataFrame, digits: int | None = None) -> DataFrame:
    """EV-9, 10: per table: unknown columns, repeats, type failures, coverage, pass flag."""
    kind, cls = F.col("rule_type"), F.col("type_class")
    keyed = rules.groupBy("table_name", "rule_type", F.array_sort("target_columns").alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = keyed.groupBy("table_name").agg(
        F.sum("n").alias("total_rules"), F.sum(F.col("n") - 1).alias("duplicates")
    )
    used = rules.select("table_name", "rule_type", F.explode("target_columns").alias("column_name"))
    per_column = used.groupBy("table_name", "rule_type", "column_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    columns = profile.select("table_name", "column_name", "type_class")
    joined = per_column.join(columns, ["table_name", "column_name"], "left")
    known = cls.isNotNull()
    numeric, temporal = naming.is_numeric_class(cls), naming.is_temporal_class(cls)
    unfit = ((kind == checks.BETWEEN) & ~(numeric | temporal)) | (
        (kind == checks.LENGTH) & (cls != "STRING")
    )
    n = F.col("n")
    found = joined.groupBy("table_name").agg(
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("invalid_columns"),
        F.coalesce(F.sum(F.when(known & unfit, n)), F.lit(0)).alias("type_failures"),
        F.count_distinct(F.when(known, F.col("column_name"))).alias("covered_columns"),
    )
    sizes = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    filled = (
        sizes.join(counts, "table_name", "full")
        .join(found, "table_name", "left")
        .select(
            "table_name",
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in (
                    "column_count", "total_rules", "covered_columns", "invalid_columns",
                    "duplicates", "type_failures",
                )
            ],
        )
    )
    total = F.col("total_rules")
    rate = lambda c: _rounded(numbers.ratio(F.col(c), total), digits)
    covered, columns_ = F.col("covered_columns"), F.col("column_count")
    return filled.select(
        "*",
        _share(covered, columns_, 1 if digits else None).alias("coverage_pct"),
        rate("invalid_columns").alias("invalid_column_rate"),
        rate("duplicates").alias("duplicate_rate"),
        rate("type_failures").alias("type_failure_rate"),
        (
            F.col("invalid_columns") + F.col("duplicates") + F.col("type_failures") == 0
        ).alias("is_safe"),
    )


def rules_by_type(rules: DataFrame) -> DataFrame:
    """EV-11: rules per table and type, per table, and in all (null = all)."""
    return rules.rollup("table_name", "rule_type").agg(F.count(F.lit(1)).alias("n"))


def full_evaluation(safety_: DataFrame, digits: int | None = None) -> DataFrame:
    """EV-12: one row over all tables, from ``safety``."""
    total = F.sum("total_rules")
    rate = lambda c: _rounded(
        F.when(total > 0, F.sum(c) / total).otherwise(F.lit(0.0)), digits
    )
    covered, columns = F.sum("covered_columns"), F.sum("column_count")
    tables = F.greatest(F.lit(1), F.count(F.lit(1)))
    return safety_.agg(
        F.count(F.lit(1)).alias("tables"),
        columns.alias("columns"),
        total.alias("rules"),
        _share(covered, columns, 2 if digits else None).alias("coverage_pct"),
        _rounded(total / tables, 1 if digits else None).alias("rules_per_table"),
        rate("invalid_columns").alias("invalid_column_rate"),
        rate("duplicates").alias("duplicate_rate"),
        rate("type_failures").alias("type_failure_rate"),
        F.bool_and("is_safe").alias("all_safe"),
    )


# Reviews and runs -------------------------------------------------------------------------


def review_rates(rules: DataFrame) -> DataFrame:
    """EV-13: accept, edit and reject rates over reviewed rules, by engine and in all."""
    reviewed = F.count_if(F.col("status") != "DRAFT")

    def rate(status: str) -> Column:
        n = F.count_if(F.col("status") == status)
        return F.when(reviewed > 0, n / reviewed).otherwise(F.lit(0.0))

    return rules.cube("engine").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        reviewed.alias("total_reviewed"),
        rate("ACCEPTED").alias("accept_rate"),
        rate("EDITED").alias("edit_rate"),
        rate("REJECTED").alias("reject_rate"),
    )


def suggestion_rates(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """EV-14: executability, acceptance and utilization of all suggestions.

    ``runs`` has a row per rule that was handed to execution and its status; ERROR means it
    did not run.
    """
    made = rules.agg(
        F.count(F.lit(1)).alias("suggestions"),
        F.count_if(F.col("status") == "ACCEPTED").alias("accepted"),
        F.count_if(F.col("status").isin("ACCEPTED", "EDITED")).alias("used"),
    )
    done = runs.agg(
        F.count(F.lit(1)).alias("mapped"),
        F.count_if(F.col("status") != "ERROR").alias("executed"),
    )
    mapped, executed = (done.select(c).scalar() for c in ("mapped", "executed"))
    wide = made.withColumn("mapped", mapped).withColumn("executed", executed)
    return wide.select(
        "*",
        numbers.ratio(F.col("executed"), F.col("mapped")).alias("executability"),
        numbers.ratio(F.col("accepted"), F.col("suggestions")).alias("acceptance_rate"),
        numbers.ratio(F.col("used"), F.col("suggestions")).alias("utilization_rate"),
    )


def router_scores(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """EV-14: per table: recall and precision of the rule types selected for it."""
    on = ["table_name", "rule_type"]
    both = (
        selected.select(*on).distinct().withColumn("s", F.lit(1))
        .join(truth.select(*on).distinct().withColumn("t", F.lit(1)), on, "full")
    )
    s, t = F.col("s").isNotNull(), F.col("t").isNotNull()
    return (
        both.groupBy("table_name")
        .agg(
            F.count_if(s).alias("selected"),
            F.count_if(t).alias("truth"),
            F.count_if(s & t).alias("correct"),
        )
        .withColumn("recall", numbers.ratio(F.col("correct"), F.col("truth")))
        .withColumn("precision", numbers.ratio(F.col("correct"), F.col("selected")))
    )
