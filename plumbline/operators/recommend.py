"""Rules proposed from a profile (REC-1..7): filters over the profile DataFrame.

Profile in, rules out, so a recommender is applied with ``profile.transform(recommend)``; any
function of that shape can be added (EXT-1).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import naming
from plumbline.operators import checks

Recommender = Callable[[DataFrame], DataFrame]

# Confidence of each kind of rule and the slack of row counts.
DECLARED, OBSERVED, RANGE, LENGTH, ROWS = 1.0, 0.95, 0.90, 0.90, 0.85
ROWS_LOW, ROWS_HIGH = 0.8, 1.5


def params(**given: Column) -> Column:
    """A params struct, fields not given are null."""
    return F.struct(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.PARAMS.fields
        ]
    )


def evidence(**given: Column) -> Column:
    """Evidence as text by name."""
    return F.create_map(
        *[x for k, v in given.items() for x in (F.lit(k), v.cast("string"))]
    )


def rule_id(table: Column, rule_type: Column, columns: Column, payload: Column) -> Column:
    """The same rule gets the same id in every run."""
    text = F.concat_ws("|", table, rule_type, F.array_join(columns, ","), payload)
    return F.concat(F.lit("rule_"), F.left(F.sha2(text, 256), F.lit(12)))


def as_rules(
    df: DataFrame,
    rule_type: Column | str,
    target_columns: Column,
    confidence: Column | float,
    reason: Column,
    *,
    engine: str = "BASIC",
    params_: Column | None = None,
    conditions: Column | None = None,
    evidence_: Column | None = None,
    validation_status: Column | None = None,
    validation_message: Column | None = None,
) -> DataFrame:
    """Rows of the rules DataFrame from any frame that has ``table_name``."""

    def field(name: str):
        return schemas.RULES[name].dataType

    kind = F.lit(rule_type) if isinstance(rule_type, str) else rule_type
    given = params_ if params_ is not None else params()
    conds = (
        conditions if conditions is not None else F.array()
    ).cast(field("conditions"))
    payload = F.concat_ws("|", F.to_json(given), F.to_json(conds))
    level = F.lit(confidence) if isinstance(confidence, float) else confidence
    return df.select(
        rule_id(F.col("table_name"), kind, target_columns, payload).alias("rule_id"),
        "table_name",
        kind.alias("rule_type"),
        F.lit(engine).alias("engine"),
        target_columns.cast(field("target_columns")).alias("target_columns"),
        given.alias("params"),
        conds.alias("conditions"),
        level.cast("double").alias("confidence"),
        reason.alias("reason"),
        (evidence_ if evidence_ is not None else F.create_map())
        .cast(field("evidence"))
        .alias("evidence"),
        (validation_status if validation_status is not None else F.lit("VALID")).alias(
            "validation_status"
        ),
        (validation_message if validation_message is not None else F.lit(None))
        .cast("string")
        .alias("validation_message"),
        F.lit("DRAFT").alias("status"),
        F.lit(None).cast(field("edited_params")).alias("edited_params"),
        F.current_timestamp().alias("created_at"),
    )


def _temporal() -> Column:
    """REC-7: time by type or by name."""
    named = naming.name_has(F.col("column_name"), naming.TEMPORAL_NAME_WORDS)
    return naming.is_temporal_class(F.col("type_class")) | named


def _numeric() -> Column:
    return naming.is_numeric_class(F.col("type_class"))


def _column() -> Column:
    return F.array("column_name")


def not_null(profile: DataFrame) -> DataFrame:
    """REC-1."""
    rows, nulls = F.col("row_count"), F.col("null_count")
    found = profile.where((rows > 0) & ((nulls == 0) | (F.col("null_ratio") == 0.0)))
    return as_rules(
        found,
        checks.NOT_NULL,
        _column(),
        F.when(F.col("nullable"), OBSERVED).otherwise(DECLARED),
        F.when(
            F.col("is_primary_key"),
            F.format_string("'%s' is the primary key and has no empty value.", "column_name"),
        ).otherwise(
            F.format_string("No empty value in %d rows of '%s'.", "row_count", "column_name")
        ),
        evidence_=evidence(
            null_count=nulls,
            null_ratio=F.col("null_ratio"),
            non_null_count=rows - nulls,
            total_rows=rows,
            is_primary_key=F.col("is_primary_key"),
        ),
    )


def unique(profile: DataFrame) -> DataFrame:
    """REC-2."""
    name, rows, nulls = F.col("column_name"), F.col("row_count"), F.col("null_count")
    is_key, distinct = F.col("is_primary_key"), F.col("distinct_count")
    metric = naming.name_has(name, naming.UNIQUE_METRIC_WORDS) | _numeric()
    identifier = (
        is_key | naming.is_id_name(name) | naming.name_has(name, naming.IDENTIFIER_WORDS)
    )
    found = profile.where(
        (rows > 0)
        & ~_temporal()
        & (is_key | ~metric)
        & ~naming.name_has(name, naming.PERSON_NAME_WORDS)
        & identifier
        & (is_key | (F.col("distinct_ratio") >= naming.UNIQUE_THRESHOLD))
    )
    non_null = F.greatest(F.lit(0), rows - nulls)
    repeated = F.when(is_key, F.lit(0)).otherwise(F.greatest(F.lit(0), non_null - distinct))
    return as_rules(
        found,
        checks.UNIQUE,
        _column(),
        F.when(is_key, DECLARED).otherwise(OBSERVED),
        F.when(
            is_key, F.format_string("'%s' is the primary key of %s.", "column_name", "table_name")
        ).otherwise(
            F.format_string(
                "%.1f%% of rows of '%s' hold a value of their own, %d values are empty.",
                F.col("distinct_ratio") * 100,
                name,
                nulls,
            )
        ),
        evidence_=evidence(
            distinct_count=distinct,
            distinct_ratio=F.col("distinct_ratio"),
            null_count=nulls,
            null_ratio=F.col("null_ratio"),
            non_null_count=non_null,
            duplicate_count=repeated,
            total_rows=rows,
            is_primary_key=is_key,
        ),
    )


def between(profile: DataFrame) -> DataFrame:
    """REC-3. ``with_histograms`` adds the distribution to the evidence."""
    low, high = F.col("min_num"), F.col("max_num")
    found = profile.where(low.isNotNull() & high.isNotNull() & ~_temporal() & _numeric())
    return as_rules(
        found,
        checks.BETWEEN,
        _column(),
        RANGE,
        F.format_string(
            "Values of '%s' lie between %s and %s.",
            "column_name", low.cast("string"), high.cast("string"),
        ),
        params_=params(min_value=low, max_value=high),
        evidence_=evidence(
            min_observed=low, max_observed=high, total_rows=F.col("row_count")
        ),
    )


def with_histograms(rules: DataFrame, histogram: DataFrame) -> DataFrame:
    """REC-3: range rules with the bins of their column as evidence (PROF-10).

    ``histogram`` holds a few bins per column, and ``table_name`` where it is of several tables;
    without, it holds for the rules of every table.
    """
    on = [c for c in ("table_name",) if c in histogram.columns]
    bins = F.array_sort(F.collect_list(F.struct("bin", "label", "count", "percentage")))
    shown = F.transform(bins, lambda b: b.dropFields("bin"))
    per_column = histogram.groupBy(*on, F.array("column_name").alias("target_columns")).agg(
        F.to_json(shown).alias("_bins")
    )
    is_range = F.col("rule_type") == checks.BETWEEN
    added = F.map_concat("evidence", F.create_map(F.lit("distribution"), F.col("_bins")))
    return (
        rules.join(per_column, [*on, "target_columns"], "left")
        .withColumn(
            "evidence",
            F.when(is_range & F.col("_bins").isNotNull(), added).otherwise(F.col("evidence")),
        )
        .select(*rules.columns)
    )


def in_set(profile: DataFrame) -> DataFrame:
    """REC-4."""
    name = F.col("column_name")
    low = F.lower(name)
    uuid = (F.col("min_length") == naming.UUID_LENGTH) & (
        F.col("max_length") == naming.UUID_LENGTH
    )
    key = (
        F.col("is_primary_key")
        | F.col("is_foreign_key")
        | F.coalesce(uuid, F.lit(False))
        | low.endswith("_id")
        | low.isin(naming.SET_KEY_NAMES)
        | naming.name_has(name, naming.SET_KEY_WORDS)
    )
    text = (
        low.isin(naming.SET_TEXT_NAMES)
        | low.endswith("_code")
        | naming.name_has(name, naming.SET_TEXT_WORDS)
    )
    found = profile.where(
        F.col("distinct_count").between(1, naming.MAX_SET_SIZE)
        & ~_temporal()
        & ~key
        & ~naming.name_has(name, naming.SET_PLACE_WORDS)
        & ~text
        & ~(naming.name_has(name, naming.SET_METRIC_WORDS) | _numeric())
        & (F.size("top_values") > 0)
    )
    allowed = F.col("top_values.value")
    return as_rules(
        found,
        checks.IN_SET,
        _column(),
        OBSERVED,
        F.format_string("'%s' has only %d different values.", "column_name", "distinct_count"),
        params_=params(allowed_values=allowed),
        evidence_=evidence(
            distinct_count=F.col("distinct_count"),
            cardinality_ratio=F.col("distinct_ratio"),
            distribution=F.to_json("top_values"),
            total_rows=F.col("row_count"),
        ),
    )


def length(profile: DataFrame) -> DataFrame:
    """REC-5."""
    low, high = F.col("min_length"), F.col("max_length")
    found = profile.where(
        F.col("type_class").isin("STRING") & low.isNotNull() & high.isNotNull()
    )
    return as_rules(
        found,
        checks.LENGTH,
        _column(),
        LENGTH,
        F.format_string(
            "Texts of '%s' have %d to %d characters.", "column_name", "min_length", "max_length"
        ),
        params_=params(min_length=low, max_length=high),
        evidence_=evidence(min_length=low, max_length=high, total_rows=F.col("row_count")),
    )


def row_count(profile: DataFrame) -> DataFrame:
    """REC-6. Not part of ``recommend``: one snapshot is no history."""
    tables = profile.groupBy("table_name").agg(F.max("row_count").alias("n"))
    n = F.col("n")
    return as_rules(
        tables,
        checks.ROW_COUNT,
        F.array().cast("array<string>"),
        ROWS,
        F.format_string("'%s' has %d rows.", "table_name", "n"),
        params_=params(
            min_value=F.greatest(F.lit(1), F.floor(n * ROWS_LOW)),
            max_value=F.floor(n * ROWS_HIGH),
        ),
        evidence_=evidence(current_row_count=n),
    )


BASIC: tuple[Recommender, ...] = (not_null, unique, between, in_set, length)


def recommend(profile: DataFrame, recommenders: tuple[Recommender, ...] = BASIC) -> DataFrame:
    """REC-1..5: the basic rules of every profiled column."""
    return reduce(DataFrame.unionByName, [profile.transform(r) for r in recommenders])


def in_column_order(rules: DataFrame, profile: DataFrame) -> DataFrame:
    """Rules by table, by the place of their first column, then by kind."""
    kinds = [checks.NOT_NULL, checks.UNIQUE, checks.BETWEEN, checks.IN_SET, checks.LENGTH]
    places = profile.select(
        "table_name", F.array("column_name").alias("target_columns"), F.col("ordinal").alias("_place")
    )
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("rule_type"))
    return (
        rules.join(places, ["table_name", "target_columns"], "left")
        .orderBy("table_name", "_place", kind)
        .select(*rules.columns)
    )
