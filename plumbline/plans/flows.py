"""The flows a user runs: profile to verdict, labelled benchmark, review to publication."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import naming
from plumbline.local import on_driver, side_by_side
from plumbline.operators import checks, evaluate, mine, profile, recommend, ruletable
from plumbline.operators import rules as rule_ops
from plumbline.sources import labelled


def check_own_rules(df: DataFrame, table_name: str, **options) -> DataFrame:
    """How many rows break each rule that the table itself suggests."""
    profiled = profile.profile(df, table_name, **options)
    rules = on_driver(recommend.recommend(profiled))
    names = rules.select(
        "rule_id", "table_name", F.array_join("target_columns", ",").alias("columns")
    )
    return rule_ops.run_rules(df, rules).join(F.broadcast(names), "rule_id")


def rule_runs(
    tables: Mapping[str, DataFrame], rules: DataFrame, run_id: str
) -> DataFrame:
    """Every rule run on its table, as rows of the rule-run table."""
    by_table: dict[str, list[dict[str, Any]]] = {}
    for r in rule_ops.rule_rows(rules):
        by_table.setdefault(r["table_name"], []).append(r)
    frames = [
        rule_ops.run_rules(df, by_table[name]).select(
            F.lit(run_id).alias("run_id"),
            F.current_timestamp().alias("run_at"),
            F.lit(name).alias("table_name"),
            "rule_id", "rule_type", "rows", "applicable", "violations", "pass_rate", "status",
        )
        for name, df in tables.items()
        if name in by_table
    ]
    return reduce(DataFrame.unionByName, frames)


def check_constraints(
    tables: Mapping[str, DataFrame], constraints: DataFrame
) -> DataFrame:
    """CHK-11..13 for a table of constraints: breaking keys and rows of each one.

    ``constraint_type`` is PRIMARY_KEY, UNIQUE or FOREIGN_KEY. Constraints are metadata and
    are read on the driver; every one is an aggregate by key over its own columns.
    """
    frames = []
    for c in constraints.collect():
        df, columns = tables[c["table_name"]], c["columns"]
        if c["constraint_type"] == "PRIMARY_KEY":
            broken = checks.primary_key(df, columns)
        elif c["constraint_type"] == "UNIQUE":
            broken = checks.unique_key(df, columns)
        elif c["constraint_type"] == "FOREIGN_KEY":
            broken = checks.orphan_keys(df, columns, tables[c["ref_table"]], c["ref_columns"])
        else:
            raise rule_ops.RuleError(f"Unsupported constraint type: {c['constraint_type']}")
        frames.append(
            broken.agg(
                F.count(F.lit(1)).alias("broken_keys"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("broken_rows"),
            ).select(
                F.lit(c["constraint_name"]).alias("constraint_name"),
                F.lit(c["constraint_type"]).alias("constraint_type"),
                F.lit(c["table_name"]).alias("table_name"),
                F.lit(",".join(columns)).alias("columns"),
                "broken_keys",
                "broken_rows",
                (F.col("broken_keys") == 0).alias("passed"),
            )
        )
    if not frames:
        raise ValueError("no constraints to check")
    return reduce(DataFrame.unionByName, frames)


def profile_with_constraints(
    tables: Mapping[str, DataFrame], constraints: DataFrame, **options
) -> DataFrame:
    """Profiles whose key columns are those declared: keys of one column, and all references."""
    primary: dict[str, list[str]] = {}
    foreign: dict[str, list[str]] = {}
    for c in constraints.collect():
        if c["constraint_type"] == "PRIMARY_KEY" and len(c["columns"]) == 1:
            primary.setdefault(c["table_name"], []).extend(c["columns"])
        elif c["constraint_type"] == "FOREIGN_KEY":
            foreign.setdefault(c["table_name"], []).extend(c["columns"])
    return profile.profile_tables(tables, primary, foreign, **options)


def record_profile(clean: DataFrame, table_name: str) -> DataFrame:
    """The profile of labelled records, whose types come from values and names.

    ``id`` is the key. Text columns named like amounts or counts are numbers, those named
    like times are times, and columns named like persons, places or links keep no top values.
    """
    record = labelled.without_labels(clean)
    kinds = {r["column_name"]: r["kind"] for r in profile.semantic_kinds(record).collect()}
    typed = record
    for field in record.schema.fields:
        text = naming.type_class(field.dataType) == "STRING"
        if text and kinds[field.name] == "money":
            typed = typed.withColumn(field.name, F.col(field.name).try_cast("double"))
        elif text and kinds[field.name] == "count":
            typed = typed.withColumn(field.name, F.col(field.name).try_cast("bigint"))
    profiled = profile.profile(typed, table_name, primary_keys=["id"])
    time = F.col("column_name").isin([c for c, k in kinds.items() if k == "time"])
    low = F.lower("column_name")
    skip = naming.has_any(low, naming.RECORD_SET_SKIP_WORDS) | F.col("is_primary_key")
    none = F.lit(None).cast("int")
    return (
        profiled.withColumn("type_class", F.when(time, "DATETIME").otherwise(F.col("type_class")))
        .withColumn("min_length", F.when(time, none).otherwise(F.col("min_length")))
        .withColumn("max_length", F.when(time, none).otherwise(F.col("max_length")))
        .withColumn(
            "top_values",
            F.when(~skip & ~time, F.col("top_values")).otherwise(F.slice("top_values", 1, 0)),
        )
    )


def record_rules(records: DataFrame, table_name: str) -> DataFrame:
    """Basic rules proposed from the clean rows, in column order, as a local table."""
    profiled = record_profile(labelled.clean_rows(records), table_name)
    return on_driver(recommend.in_column_order(recommend.recommend(profiled), profiled))


def labelled_benchmark(
    records: Mapping[str, DataFrame], expected: DataFrame, digits: int | None = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EV-1..8 end to end: (scores per table, detection per table, overall).

    Rules are proposed from the clean rows of every table, matched to the expected ones, and
    tried on clean and broken rows, several tables at once. The scores, a row per table, are local
    tables.
    """

    def tried(name: str) -> tuple[DataFrame, DataFrame]:
        rules = record_rules(records[name], name)
        tested = evaluate.tested_rows(records[name], rules)
        return rules, on_driver(evaluate.detection_scores(tested, name, digits))

    proposed, detections = zip(*side_by_side(tried, records))
    wanted = expected.where(F.col("table_name").isin(list(records)))
    scores = on_driver(evaluate.rule_scores(ruletable.union_rules(*proposed), wanted, digits))
    detection = reduce(DataFrame.unionByName, detections)
    return scores, detection, evaluate.overall(scores, detection, digits)


def mine_rules(
    df: DataFrame,
    table_name: str,
    profiled: DataFrame,
    min_confidence: float = 0.95,
    confident_from: float = ruletable.SERVICE_THRESHOLD,
    max_values: int = naming.MAX_SET_SIZE,
    max_distinct_ratio: float = 0.5,
) -> DataFrame:
    """REC-9..15 on one table, deduplicated and from the confidence ``confident_from`` on.

    Categories are columns of any countable type with up to ``max_values`` values. Dependencies
    are searched among all columns whose values repeat: at most ``max_distinct_ratio`` of the
    rows hold a value of their own. Values beyond these bounds are no categories, as nearly
    every one would stand for a single row.
    """
    local = profiled.where(F.col("table_name") == table_name)
    groups = mine.column_groups(local)
    times = mine.pairs_of(groups, table_name, "TEMPORAL")
    numbers = mine.pairs_of(groups, table_name, "CROSS_COLUMN")
    columns = sorted({c for p in numbers for c in p})
    rows = local.where(~F.col("is_primary_key") & (F.col("type_class") != "OTHER")).collect()
    categories = [r["column_name"] for r in rows if 2 <= r["distinct_count"] <= max_values]
    dependents = [
        r["column_name"]
        for r in rows
        if 0 < r["null_count"] < r["row_count"] and r["column_name"] not in categories
    ]
    codes = [
        r["column_name"]
        for r in rows
        if r["distinct_count"] > 1 and r["distinct_ratio"] <= max_distinct_ratio
    ]
    found = []
    if times:
        found.append(mine.time_order_rules(df, table_name, times, min_confidence))
        found.append(mine.duration_rules(df, table_name, times))
    if numbers:
        found.append(mine.comparison_rules(df, table_name, numbers, min_confidence))
    if len(columns) > 2:
        found.append(mine.arithmetic_rules(df, table_name, columns, min_confidence=min_confidence))
    if categories and len(categories) + len(dependents) > 1:
        found.append(
            mine.conditional_rules(
                df, table_name, categories, dependents, min_confidence, max_values=max_values
            )
        )
    if len(codes) > 1:
        found.append(mine.dependency_rules(df, table_name, codes, min_confidence))
    if not found:
        return recommend.recommend(local.limit(0))
    united = ruletable.confident(ruletable.union_rules(*found), confident_from)
    return ruletable.dedupe_rules(united, F.desc("confidence"), F.asc("rule_id"))


def publish(
    rules: DataFrame, reviews: DataFrame, rule_ids: Iterable[str] | None = None
) -> DataFrame:
    """RT-16..18: the rules to publish, with the parameters in force."""
    reviewed = ruletable.apply_reviews(rules, reviews)
    return ruletable.publishable(reviewed, rule_ids).withColumn(
        "params", ruletable.effective_params(F.col("edited_params"), F.col("params"))
    )
