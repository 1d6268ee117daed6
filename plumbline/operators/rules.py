"""Running rules against a table (RULE-*, CHK-9, CHK-10).

Rules are few, so their rows are read on the driver and turned into Columns; the data stays
distributed. All row rules of a table are counted in one scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import numbers
from plumbline.local import local_frame
from plumbline.operators import checks, predicates
from plumbline.operators.predicates import RuleError, column
from plumbline.operators.skew import with_short_keys

# Rules per global aggregate: keeps generated code within the size the JIT compiles.
RULES_PER_SCAN = 100

MULTI_COLUMN = tuple(predicates.ALLOWED_CONDITIONS)


@dataclass(frozen=True)
class Predicate:
    """A row rule as Columns: broken, and known to be kept or broken. Null is no."""

    rule_id: str
    rule_type: str
    label: str
    violation: Column
    applicable: Column


def rule_rows(
    rules: DataFrame | Iterable[Mapping[str, Any]], table_name: str | None = None
) -> list[dict[str, Any]]:
    """Rules as dicts, of one table if it is named; those of a DataFrame are collected.

    Name the table where the rules are of many tables: the filter runs before they come here.
    """
    if isinstance(rules, DataFrame):
        if table_name is not None:
            rules = rules.where(F.col("table_name") == table_name)
        return [r.asDict(recursive=True) for r in rules.collect()]
    return [dict(r) for r in rules if table_name is None or r.get("table_name") == table_name]


def effective_params(rule: Mapping[str, Any]) -> dict[str, Any]:
    """RT-17 on one rule: edited, else original, else empty parameters."""
    return rule.get("edited_params") or rule.get("params") or {}


def _label(rule: Mapping[str, Any]) -> str:
    return f"{rule['rule_type']}:{','.join(rule.get('target_columns') or [])}"


def is_row_rule(rule: Mapping[str, Any]) -> bool:
    """Whether one row alone can break the rule."""
    return rule["rule_type"] not in (checks.UNIQUE, checks.ROW_COUNT, checks.DEPENDENCY)


def predicate(rule: Mapping[str, Any], df: DataFrame) -> Predicate:
    """The row predicate of one rule on the table ``df``."""
    kind, params = rule["rule_type"], effective_params(rule)
    names = rule.get("target_columns") or []
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise RuleError(f"Unknown target column: {', '.join(sorted(unknown))}")
    made = lambda bad, known: Predicate(rule["rule_id"], kind, _label(rule), bad, known)
    if kind in MULTI_COLUMN:
        conditions = [
            c if "right_type" not in c else predicates.from_struct(c)
            for c in rule.get("conditions") or []
        ]
        bad = predicates.violation(kind, conditions, df.schema)
        return made(bad, bad | predicates.valid(kind, conditions, df.schema))
    if kind == checks.CUSTOM_SQL:
        expression = params["sql_expression"]
        return made(checks.expression_violation(expression), F.expr(expression).isNotNull())
    broken, known = [], []
    for n in names:
        data_type, present = df.schema[n].dataType, column(n).isNotNull()
        if kind == checks.NOT_NULL:
            broken.append(checks.null_violation(n, data_type))
            continue
        if kind == checks.BETWEEN:
            bounds = params.get("min_value"), params.get("max_value")
            broken.append(checks.between_violation(n, data_type, *bounds))
            if not isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                present = numbers.parse_number(column(n), data_type).isNotNull()
        elif kind == checks.IN_SET:
            broken.append(checks.set_violation(n, params.get("allowed_values") or []))
        elif kind == checks.LENGTH:
            bounds = params.get("min_length"), params.get("max_length")
            broken.append(checks.length_violation(n, *bounds))
        elif kind == checks.REGEX:
            broken.append(checks.pattern_violation(n, params["regex"]))
        else:
            raise RuleError(f"Unsupported rule type: {kind}")
        known.append(present)
    return made(predicates.any_of(broken), predicates.all_of(known))


def violating_rows(
    df: DataFrame,
    rule: Mapping[str, Any],
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """RULE-4, 5: rows that break a rule; chosen columns and the first N on request."""
    if rule["rule_type"] == checks.UNIQUE:
        found = checks.repeated_rows(df, rule["target_columns"]).drop("n")
    elif rule["rule_type"] == checks.DEPENDENCY:
        *determinant, dependent = rule["target_columns"]
        found = checks.dependency_break_rows(df, determinant, dependent).select(df.columns)
    else:
        found = df.where(predicate(rule, df).violation)
    if order:
        found = found.orderBy(*order)
    if columns is not None:
        found = found.select(*[column(c) for c in columns])
    return found if limit is None else found.limit(limit)


def violation_count(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """RULE-6: one row: number of violations of a rule of any type, passed when 0."""
    return run_rules(df, [rule]).select("violations", (F.col("violations") == 0).alias("passed"))


def bound_sql(spark: SparkSession, sql: str, params: Mapping[str, Any], **views: DataFrame):
    """RULE-7: violation SQL with named markers, e.g. ``:rule_param_1``.

    Tables are named by the keyword arguments and used as ``{name}`` in the text.
    """
    return spark.sql(sql, args=dict(params), **views)


RUN = schemas.struct(
    rule_id=schemas.S, rule_type=schemas.S, rows=schemas.L, applicable=schemas.L,
    violations=schemas.L, message=schemas.S,
)


def _built(rule: Mapping[str, Any], df: DataFrame) -> Predicate | None:
    """The predicate of a row rule, or None for other rules; raises if it cannot be checked."""
    if is_row_rule(rule):
        made = predicate(rule, df)
        df.select(made.violation, made.applicable)  # Spark resolves it now, without a job
        return made
    unknown = [c for c in rule.get("target_columns") or [] if c not in df.columns]
    if unknown:
        raise RuleError(f"Unknown target column: {', '.join(sorted(unknown))}")
    return None


def run_rules(
    df: DataFrame,
    rules: DataFrame | Iterable[Mapping[str, Any]],
    table_name: str | None = None,
) -> DataFrame:
    """RULE-8: every rule of a table: rows, applicable rows, violations, pass rate, status.

    Row rules and the row count share one scan per RULES_PER_SCAN rules; the uniqueness
    rules of single columns add one shuffle of values per physical type, each composite one and
    each dependency one of its own. A rule that cannot be checked has the status ERROR and a
    message, and stops no other rule. Rules of other tables are left out if the table is named.
    """
    found, row_rules, failed = [], [], []
    for r in rule_rows(rules, table_name):
        try:
            made = _built(r, df)
        except (RuleError, PySparkException, KeyError, TypeError, ValueError) as e:
            text = str(e).splitlines()[0] if str(e) else type(e).__name__
            failed.append({"rule_id": r["rule_id"], "rule_type": r["rule_type"], "message": text})
            continue
        found.append(r)
        if made is not None:
            row_rules.append(made)
    counts = [r for r in found if r["rule_type"] == checks.ROW_COUNT]
    frames = [
        _count(df, row_rules[i : i + RULES_PER_SCAN])
        for i in range(0, len(row_rules), RULES_PER_SCAN)
    ]
    if counts:
        frames.append(_count_table_rules(df, counts))
    unique = [r for r in found if r["rule_type"] == checks.UNIQUE]
    if single := [r for r in unique if len(set(r["target_columns"])) == 1]:
        frames.append(_count_unique(df, single))
    frames += [_count_unique_key(df, r) for r in unique if len(set(r["target_columns"])) > 1]
    frames += [_count_dependency(df, r) for r in found if r["rule_type"] == checks.DEPENDENCY]
    frames = [f.withColumn("message", F.lit(None).cast("string")) for f in frames]
    if failed or not frames:
        frames.append(local_frame(df.sparkSession, failed, RUN))
    kept = F.col("applicable") - F.col("violations")
    rate = F.when(F.col("applicable") > 0, kept / F.col("applicable")).when(
        F.col("message").isNull(), F.lit(1.0)
    )
    return reduce(DataFrame.unionByName, frames).select(
        "rule_id",
        "rule_type",
        "rows",
        "applicable",
        "violations",
        rate.alias("pass_rate"),
        F.when(F.col("message").isNotNull(), "ERROR")
        .when(F.col("violations") == 0, "PASSED")
        .otherwise("FAILED")
        .alias("status"),
        "message",
    )


def _count(df: DataFrame, batch: list[Predicate]) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, p in enumerate(batch):
        aggregates.append(F.count_if(p.violation).alias(f"v{i}"))
        aggregates.append(F.count_if(p.applicable).alias(f"a{i}"))
    rows = [
        F.struct(
            F.lit(p.rule_id).alias("rule_id"),
            F.lit(p.rule_type).alias("rule_type"),
            F.col("rows"),
            F.col(f"a{i}").alias("applicable"),
            F.col(f"v{i}").alias("violations"),
        )
        for i, p in enumerate(batch)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _count_table_rules(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    rows = []
    for r in rules:
        params = effective_params(r)
        wrong = checks.outside(F.col("rows"), params.get("min_value"), params.get("max_value"))
        rows.append(
            F.struct(
                F.lit(r["rule_id"]).alias("rule_id"),
                F.lit(r["rule_type"]).alias("rule_type"),
                F.col("rows"),
                F.lit(1).cast("bigint").alias("applicable"),
                F.when(wrong, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("violations"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*rows)))


def _count_unique(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    named = [
        {"rule_id": r["rule_id"], "rule_type": r["rule_type"], "column_name": c}
        for r in rules
        for c in r["target_columns"]
    ]
    text = schemas.S
    shape = schemas.struct(rule_id=text, rule_type=text, column_name=text)
    asked = local_frame(df.sparkSession, named, shape)
    columns = sorted({r["column_name"] for r in named})
    summary = checks.unique_summary(df, columns)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return asked.join(summary, "column_name", "left").select(
        "rule_id",
        "rule_type",
        rows.alias("rows"),
        F.coalesce("applicable", F.lit(0)).alias("applicable"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
    )


def _count_unique_key(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """A key of several columns: rows whose key is whole, and those that share it."""
    columns = list(dict.fromkeys(rule["target_columns"]))
    rows, short = with_short_keys(df.select(*map(column, columns)), columns)
    n = F.col("n")
    keys = checks.key_counts(rows, short).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("applicable"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("violations"),
    )
    return keys.select(
        F.lit(rule["rule_id"]).alias("rule_id"),
        F.lit(rule["rule_type"]).alias("rule_type"),
        df.agg(F.count(F.lit(1))).scalar().alias("rows"),
        "applicable",
        "violations",
    )


def _count_dependency(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    *determinant, dependent = rule["target_columns"]
    known = predicates.all_of(column(c).isNotNull() for c in determinant)
    broken = checks.dependency_breaks(df, determinant, dependent)
    bad = broken.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("applicable")
    ).select(
        F.lit(rule["rule_id"]).alias("rule_id"),
        F.lit(rule["rule_type"]).alias("rule_type"),
        "rows",
        "applicable",
        bad.alias("violations"),
    )


def failing_rules(
    df: DataFrame,
    rules: DataFrame | Iterable[Mapping[str, Any]],
    labels: bool = False,
    into: str = "failed",
) -> DataFrame:
    """CHK-9: each row with the list of row rules it breaks, by id or 'type:columns' label.

    Works on a streaming DataFrame as well. Uniqueness is no row predicate; see
    ``checks.repeated_rows``.
    """
    tests = [predicate(r, df) for r in rule_rows(rules) if is_row_rule(r)]
    marks = [
        F.when(p.violation, F.lit(p.label if labels else p.rule_id)) for p in tests
    ]
    failed = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return df.withColumn(into, failed)


def is_clean(failed: str = "failed") -> Column:
    """CHK-10: no rule failed."""
    return F.size(failed) == 0
