"""Operators on rules DataFrames (RT-*): union, dedupe, validate, review, publish.

Rule tables may be large (rules of many tables, over many runs), so nothing here gathers or
pairs up the rules of a group; conflicts come from group extremes instead of a self-join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import naming
from plumbline.operators import checks
from plumbline.operators.skew import SALTS, rows_of_keys

# Thresholds of the confidence gate.
SERVICE_THRESHOLD = 0.75
SHOW_FROM, LOW_FROM = 0.80, 0.60

PUBLISHABLE = ("ACCEPTED", "EDITED")


def union_rules(*rules: DataFrame) -> DataFrame:
    """RT-1: rules of several recommenders."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rules)


def confident(rules: DataFrame, threshold: float = SERVICE_THRESHOLD) -> DataFrame:
    """RT-2."""
    return rules.where(F.col("confidence") >= threshold)


def confidence_band(confidence: Column) -> Column:
    """RT-3: SHOW, LOW or HIDE."""
    return (
        F.when(confidence >= SHOW_FROM, "SHOW")
        .when(confidence >= LOW_FROM, "LOW")
        .otherwise("HIDE")
    )


def by_confidence(rules: DataFrame, *ties: str) -> DataFrame:
    """RT-4: highest confidence first."""
    return rules.orderBy(F.desc("confidence"), *ties)


def _first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key; Spark keeps one row per key and task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def dedupe_groups(groups: DataFrame, *order: Column) -> DataFrame:
    """RT-8: one of each (table, type, set of columns), the first in ``order``."""
    keys = [F.col("table_name"), F.col("rule_type"), F.array_sort("target_columns")]
    return _first_of(groups, keys, list(order))


def condition_key(conditions: Column, text: Column | None = None) -> Column:
    """Conditions as JSON, else the condition's text trimmed and in lower case."""
    as_text = F.coalesce(F.lower(F.trim(text)), F.lit("")) if text is not None else F.lit("")
    return F.when(F.size(conditions) > 0, F.to_json(conditions)).otherwise(as_text)


def dedupe_rules(rules: DataFrame, *order: Column, text: Column | None = None) -> DataFrame:
    """RT-9: one of each (table, type, set of columns, conditions)."""
    keys = [
        F.col("table_name"),
        F.col("rule_type"),
        F.array_sort("target_columns"),
        condition_key(F.col("conditions"), text),
    ]
    return _first_of(rules, keys, list(order))


def canonical_key(
    rule_type: Column, columns: Column, params: Column, expression: Column | None = None
) -> Column:
    """RT-10: one hash of type, sorted columns, parameters and trimmed expression."""
    text = F.trim(F.coalesce(expression, F.lit(""))) if expression is not None else F.lit("")
    return F.sha2(
        F.to_json(
            F.struct(
                rule_type.alias("type"),
                F.array_sort(columns).alias("columns"),
                params.alias("params"),
                text.alias("expression"),
            )
        ),
        256,
    )


def _used_columns(rules: DataFrame) -> DataFrame:
    return rules.select(
        "rule_id",
        "table_name",
        "rule_type",
        F.explode(F.array_distinct("target_columns")).alias("column_name"),
    )


def _messages(used: DataFrame, wrong: DataFrame, on: list[str]) -> DataFrame:
    """(rule_id, messages) of the rules that use a wrong key; a rule has few columns."""
    return (
        rows_of_keys(used, wrong, on, "n")
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_set("message")).alias("messages"))
    )


def schema_messages(rules: DataFrame, profile: DataFrame) -> DataFrame:
    """RT-11: (rule_id, messages) of rules that name unknown columns.

    Columns are looked up once each, however many rules use them.
    """
    on = ["table_name", "column_name"]
    used = _used_columns(rules)
    unknown = (
        used.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(profile.select(*on), on, "left_anti")
        .withColumn("message", F.concat(F.lit("Unknown target column: "), F.col("column_name")))
    )
    return _messages(used, unknown, on)


def type_messages(rules: DataFrame, profile: DataFrame) -> DataFrame:
    """RT-12: (rule_id, messages) of rules on columns of an unfit type."""
    on = ["table_name", "rule_type", "column_name"]
    used = _used_columns(rules)
    cls, kind = F.col("type_class"), F.col("rule_type")
    numeric, temporal = naming.is_numeric_class(cls), naming.is_temporal_class(cls)
    needed = (
        F.when((kind == checks.BETWEEN) & ~(numeric | temporal), "a number or a time")
        .when((kind == checks.LENGTH) & (cls != "STRING"), "text")
        .when((kind == "TEMPORAL") & ~temporal, "a time")
    )
    unfit = (
        used.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(
            profile.select("table_name", "column_name", "type_class"),
            ["table_name", "column_name"],
        )
        .where(needed.isNotNull())
        .withColumn("message", F.format_string("Column %s must be %s", "column_name", needed))
        .drop("type_class")
    )
    return _messages(used, unfit, on)


def conflicts(rules: DataFrame) -> DataFrame:
    """RT-13: (rule_id, conflicts_with) of range rules that exclude another rule's range.

    Two ranges exclude each other when one ends before the other starts. Some such partner
    exists exactly when the rule ends before the highest start in its group, or starts after
    the lowest end, so the extremes of each group replace the pairs.
    """
    p, is_length = F.coalesce("edited_params", "params"), F.col("rule_type") == checks.LENGTH
    low = F.when(is_length, p["min_length"].cast("double")).otherwise(p["min_value"])
    high = F.when(is_length, p["max_length"].cast("double")).otherwise(p["max_value"])
    ranged = rules.where(
        F.col("rule_type").isin(checks.BETWEEN, checks.LENGTH, checks.ROW_COUNT)
    ).select(
        "rule_id",
        "table_name",
        "rule_type",
        # rules on the table itself have no columns, given as null or as an empty list
        F.array_sort(F.coalesce("target_columns", F.array().cast("array<string>"))).alias("columns"),
        F.coalesce(low, F.lit(float("-inf"))).alias("low"),
        F.coalesce(high, F.lit(float("inf"))).alias("high"),
    )
    group = ["table_name", "rule_type", "columns"]
    extremes = ranged.groupBy(*group).agg(
        F.max(F.struct("low", "rule_id")).alias("top"),
        F.min(F.struct("high", "rule_id")).alias("bottom"),
        F.count(F.lit(1)).alias("n"),
    )
    clashing = extremes.where(F.col("top.low") > F.col("bottom.high"))
    joined = rows_of_keys(ranged, clashing, group, "n")
    below, above = F.col("high") < F.col("top.low"), F.col("low") > F.col("bottom.high")
    return joined.where(below | above).select(
        "rule_id",
        F.when(below, F.col("top.rule_id")).otherwise(F.col("bottom.rule_id")).alias("conflicts_with"),
    )


def validate(rules: DataFrame, profile: DataFrame) -> DataFrame:
    """RT-11..13 in one: unknown columns and unfit types are INVALID, conflicts WARNING."""
    bad = (
        schema_messages(rules, profile)
        .unionByName(type_messages(rules, profile))
        .groupBy("rule_id")
        .agg(F.array_sort(F.flatten(F.collect_list("messages"))).alias("_bad"))
    )
    clash = conflicts(rules).groupBy("rule_id").agg(F.min("conflicts_with").alias("_clash"))
    return (
        rules.join(bad, "rule_id", "left")
        .join(clash, "rule_id", "left")
        .withColumn(
            "validation_status",
            F.when(F.col("_bad").isNotNull(), "INVALID")
            .when(F.col("_clash").isNotNull(), "WARNING")
            .otherwise(F.col("validation_status")),
        )
        .withColumn(
            "validation_message",
            F.coalesce(
                F.array_join("_bad", "; "),
                F.concat(F.lit("Conflicts with "), F.col("_clash")),
                F.col("validation_message"),
            ),
        )
        .drop("_bad", "_clash")
    )


def classify(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """RT-14: NEW, DUPLICATE or POSSIBLE_CONFLICT against rules that exist already.

    Both sides are reduced to one row per key before the joins, so no candidate is
    multiplied and no hot key is gathered.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "_canonical",
            canonical_key(
                F.concat_ws("|", "table_name", "rule_type"),
                F.col("target_columns"),
                F.struct("params", "conditions"),
                F.col("params.sql_expression"),
            ),
        ).withColumn("_columns", F.array_sort("target_columns"))

    old = keyed(existing)
    group = ["table_name", "rule_type", "_columns"]
    same = old.select("_canonical").distinct().withColumn("_same", F.lit(True))
    near = old.select(*group).distinct().withColumn("_near", F.lit(True))
    new = keyed(candidates)
    # Keys first: one row per canonical key of the candidates. A group may hold many of them,
    # so it is split by a salt taken from the key, and the few columns of ``near`` repeated.
    keys = new.groupBy("_canonical", *group).agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("_canonical"), F.lit(SALTS)).cast("int")
    salted = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kind = (
        F.when(F.col("_same"), "DUPLICATE")
        .when(F.col("_near"), "POSSIBLE_CONFLICT")
        .otherwise("NEW")
    )
    known = (
        keys.withColumn("_salt", salt)
        .join(same, "_canonical", "left")
        .join(salted, [*group, "_salt"], "left")
        .select("_canonical", kind.alias("classification"), "n")
    )
    return rows_of_keys(new, known, ["_canonical"], "n").drop("_canonical", "_columns", "n")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Last action per rule, and the parameters of its last edit that had any.

    Of reviews at one instant, the action and then the parameters that sort last count.
    """
    edited = (F.col("action") == "EDITED") & F.col("edited_params").isNotNull()
    params = F.to_json("edited_params")
    return reviews.groupBy("rule_id").agg(
        F.max_by("action", F.struct("reviewed_at", "action")).alias("action"),
        F.max_by("edited_params", F.when(edited, F.struct("reviewed_at", params))).alias("edit"),
    )


def apply_reviews(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """RT-16: status and edited parameters from the reviews; unknown rules are ignored.

    Parameters of an edit stay when a later review only accepts or rejects.
    """
    return (
        rules.join(latest_reviews(reviews), "rule_id", "left")
        .withColumn("status", F.coalesce("action", "status"))
        .withColumn("edited_params", F.coalesce("edit", "edited_params"))
        .drop("action", "edit")
    )


def effective_params(edited: Column, original: Column) -> Column:
    """RT-17: edited, else original parameters."""
    return F.coalesce(edited, original)


def publishable(rules: DataFrame, rule_ids: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """RT-18: accepted or edited rules, of an id list if one is given."""
    found = rules.where(F.col("status").isin(*PUBLISHABLE))
    if rule_ids is None:
        return found
    if isinstance(rule_ids, DataFrame):
        return found.join(rule_ids.select("rule_id"), "rule_id", "left_semi")
    return found.where(F.col("rule_id").isin(*rule_ids))


def board_counts(rules: DataFrame) -> DataFrame:
    """RT-24: one row of totals over the rules."""
    reviewed = F.count_if(F.col("status") != "DRAFT")
    total = F.count(F.lit(1))
    return rules.agg(
        total.alias("all_rules"),
        F.count_if(F.col("engine") == "BASIC").alias("basic"),
        F.count_if(F.col("engine") == "ADVANCED").alias("advanced"),
        F.count_if(F.col("validation_status") == "WARNING").alias("warning"),
        F.count_if(F.col("status").isin(*PUBLISHABLE)).alias("accepted"),
        reviewed.alias("reviewed"),
        F.when(total > 0, reviewed * F.lit(100.0) / total)
        .otherwise(F.lit(0.0))
        .alias("percent_reviewed"),
    )


# Fixed value: the column name of rules on the table itself.
TABLE_LEVEL = "__TABLE_LEVEL__"


def column_board(rules: DataFrame, profile: DataFrame) -> DataFrame:
    """RT-27: totals per column, columns without rules included, and per table-level group."""
    columns = F.when(F.size("target_columns") > 0, F.array_distinct("target_columns"))
    spread = rules.withColumn("column_name", F.explode_outer(columns)).withColumn(
        "column_name", F.coalesce("column_name", F.lit(TABLE_LEVEL))
    )
    totals = spread.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("status") != "DRAFT").alias("reviewed"),
        F.count_if(F.col("status").isin(*PUBLISHABLE)).alias("accepted"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.bool_or(F.col("validation_status") == "WARNING").alias("has_warning"),
        F.bool_or(F.col("engine") == "ADVANCED").alias("has_advanced"),
        F.array_sort(F.collect_set("rule_type")).alias("rule_types"),
    )
    known = profile.select("table_name", "column_name", "is_primary_key")
    zero = F.lit(0)
    return known.join(totals, ["table_name", "column_name"], "full").select(
        "table_name",
        "column_name",
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("total_rules", "reviewed", "accepted", "rejected")
        ],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_warning", "has_advanced")],
        F.coalesce("rule_types", F.array().cast("array<string>")).alias("rule_types"),
    )
