"""Spark schemas shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B, TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


TOP_VALUES = T.ArrayType(struct(value=S, count=L, percentage=D))

PROFILE = struct(
    table_name=S,
    ordinal=I,
    column_name=S,
    data_type=S,
    type_class=S,
    is_primary_key=B,
    is_foreign_key=B,
    nullable=B,
    row_count=L,
    null_count=L,
    null_ratio=D,
    distinct_count=L,
    distinct_ratio=D,
    distinct_ratio_nonnull=D,
    min_num=D,
    max_num=D,
    min_str=S,
    max_str=S,
    min_length=I,
    max_length=I,
    mean=D,
    stddev=D,
    top_values=TOP_VALUES,
)

PARAMS = struct(
    min_value=D,
    max_value=D,
    min_length=I,
    max_length=I,
    allowed_values=T.ArrayType(S),
    regex=S,
    sql_expression=S,
)

# Literals (right_value, values) hold JSON text, so that 18 and "18" stay apart.
CONDITION = struct(
    role=S,
    type=S,
    left=S,
    column=S,
    operator=S,
    right_type=S,
    right_value=S,
    target=S,
    comparison_operator=S,
    arith_operator=S,
    operands=T.ArrayType(S),
    values=T.ArrayType(S),
    start_column=S,
    end_column=S,
    value=D,
    unit=S,
)

RULES = struct(
    rule_id=S,
    table_name=S,
    rule_type=S,
    engine=S,
    target_columns=T.ArrayType(S),
    params=PARAMS,
    conditions=T.ArrayType(CONDITION),
    confidence=D,
    reason=S,
    evidence=T.MapType(S, S),
    validation_status=S,
    validation_message=S,
    status=S,
    edited_params=PARAMS,
    created_at=TS,
)

REVIEWS = struct(
    rule_id=S, action=S, edited_params=PARAMS, comment=S, reviewed_at=TS
)

RULE_RUNS = struct(
    run_id=S,
    run_at=TS,
    table_name=S,
    rule_id=S,
    rule_type=S,
    rows=L,
    applicable=L,
    violations=L,
    pass_rate=D,
    status=S,
)

CONSTRAINTS = struct(
    constraint_name=S,
    constraint_type=S,
    table_name=S,
    columns=T.ArrayType(S),
    ref_table=S,
    ref_columns=T.ArrayType(S),
)

# Expected rules arrive as one JSON document: a map from table to its rules.
EXPECTED_RULE = struct(
    rule_type=S,
    target_columns=T.ArrayType(S),
    parameters=struct(
        minValue=D,
        maxValue=D,
        minLength=I,
        maxLength=I,
        allowedValues=T.ArrayType(S),
    ),
    category=S,
    reason=S,
)
EXPECTED_DOCUMENT = struct(
    tables=T.MapType(S, struct(table_name=S, expected_rules=T.ArrayType(EXPECTED_RULE)))
)

LABEL_FIELDS = [
    T.StructField("_is_valid", B, True),
    T.StructField("_injected_fault", S, True),
    T.StructField("_expected_violations", T.ArrayType(S), True),
]


def labelled(record: T.StructType) -> T.StructType:
    """The record schema with the three label columns added."""
    return T.StructType(list(record.fields) + LABEL_FIELDS)
