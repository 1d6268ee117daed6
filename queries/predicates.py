"""COND-* and RULE-*."""

from __future__ import annotations

from pyspark.sql import DataFrame
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks, predicates
from plumbline.operators import rules as rule_ops
from queries.base import query, table

# Lines with nulls on both sides of the comparisons, beside equal values and zeros.
LINES_SQL = """(SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 7) AS quantity, l_extendedprice AS price,
    NULLIF(l_discount, 0.05) AS discount, NULLIF(l_tax, 0.02) AS tax,
    NULLIF(l_returnflag, 'A') AS flag, l_linestatus AS status, l_suppkey
    FROM lineitem)"""


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_quantity", F.lit(7.0)).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.05)).alias("discount"),
        F.nullif("l_tax", F.lit(0.02)).alias("tax"),
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.col("l_linestatus").alias("status"),
        "l_suppkey",
    )


SHIPPED_SQL = """(SELECT l_orderkey, l_linenumber, o_orderdate AS ordered,
    CASE WHEN l_linenumber <> 5 THEN l_shipdate END AS shipped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def shipped(spark, sf_dir) -> DataFrame:
    """Lines with their order date; both sides are large, so the join is left to Spark."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_shipdate")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            F.col("o_orderdate").alias("ordered"),
            F.when(F.col("l_linenumber") != 5, F.col("l_shipdate")).alias("shipped"),
        )
    )


def count_forms(df: DataFrame, cases: dict[str, dict]) -> DataFrame:
    """Rows where each condition holds, where its negation holds, and where neither does."""
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, (name, cond) in enumerate(cases.items()):
        good = predicates.condition(cond)
        bad = predicates.condition(cond, negate=True)
        aggregates += [
            F.count_if(good).alias(f"g{i}"),
            F.count_if(bad).alias(f"b{i}"),
            F.count_if(good.isNull() & bad.isNull()).alias(f"u{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("condition"),
                F.col(f"g{i}").alias("valid"),
                F.col(f"b{i}").alias("violations"),
                F.col(f"u{i}").alias("unknown"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def forms_sql(frm: str, cases: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS condition, count(*) FILTER ({p}) AS valid, count(*) FILTER (NOT ({p})) AS violations,
            count(*) FILTER (({p}) IS NULL) AS unknown FROM {frm}"""
        for n, p in cases.items()
    )


SIGNS = {"EQ": "=", "NEQ": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}


@query(forms_sql(LINES_SQL, {o: f"discount {s} tax" for o, s in SIGNS.items()}))
def cond_column_to_column(spark, sf_dir):
    return count_forms(
        lines(spark, sf_dir),
        {
            o: {"type": "COMPARISON", "left": "discount", "operator": o, "right": {"type": "column", "value": "tax"}}
            for o in SIGNS
        },
    )


@query(
    forms_sql(LINES_SQL, {o: f"quantity {s} 25" for o, s in SIGNS.items()} | {"TEXT": "flag = 'R'"})
)
def cond_column_to_literal(spark, sf_dir):
    literal = lambda left, o, v: {
        "type": "COMPARISON", "left": left, "operator": o, "right": {"type": "literal", "value": v},
    }
    return count_forms(
        lines(spark, sf_dir),
        {o: literal("quantity", o, 25) for o in SIGNS} | {"TEXT": literal("flag", "EQ", "R")},
    )


@query(forms_sql(LINES_SQL, {"IS_NULL": "flag IS NULL", "IS_NOT_NULL": "flag IS NOT NULL"}))
def cond_null_check(spark, sf_dir):
    return count_forms(
        lines(spark, sf_dir),
        {o: {"type": "NULL_CHECK", "column": "flag", "operator": o} for o in ("IS_NULL", "IS_NOT_NULL")},
    )


@query(
    forms_sql(
        LINES_SQL,
        {"IN": "flag IN ('R', 'x')", "NOT_IN": "flag NOT IN ('R', 'x')", "NUMBERS": "quantity IN (1, 2, 3)"},
    )
)
def cond_set(spark, sf_dir):
    member = lambda left, o, v: {"type": "SET", "left": left, "operator": o, "values": v}
    return count_forms(
        lines(spark, sf_dir),
        {
            "IN": member("flag", "IN", ["R", "x"]),
            "NOT_IN": member("flag", "NOT_IN", ["R", "x"]),
            "NUMBERS": member("quantity", "IN", [1, 2, 3]),
        },
    )


ARITHMETIC = {
    "ADD": "quantity + discount + tax",
    "SUBTRACT": "quantity - discount - tax",
    "MULTIPLY": "quantity * discount * tax",
    "DIVIDE": "quantity / NULLIF(discount, 0) / NULLIF(tax, 0)",
}


@query(
    forms_sql(
        LINES_SQL,
        {f"{a}_{o}": f"price {s} ({e})" for a, e in ARITHMETIC.items() for o, s in SIGNS.items()}
        | {"TAX_IS_PRODUCT": "tax = quantity * discount"},
    )
)
def cond_arithmetic(spark, sf_dir):
    cond = lambda target, a, o, operands: {
        "type": "ARITHMETIC", "target": target, "comparison_operator": o,
        "expression": {"operator": a, "operands": operands},
    }
    return count_forms(
        lines(spark, sf_dir),
        {
            f"{a}_{o}": cond("price", a, o, ["quantity", "discount", "tax"])
            for a in ARITHMETIC
            for o in SIGNS
        }
        | {"TAX_IS_PRODUCT": cond("tax", "MULTIPLY", "EQ", ["quantity", "discount"])},
    )


ORDER_SIGNS = {"BEFORE": "<", "BEFORE_EQUAL": "<=", "AFTER": ">", "AFTER_EQUAL": ">="}


@query(forms_sql(SHIPPED_SQL, {o: f"ordered {s} shipped" for o, s in ORDER_SIGNS.items()}))
def cond_temporal_order(spark, sf_dir):
    return count_forms(
        shipped(spark, sf_dir),
        {o: {"type": "TEMPORAL_ORDER", "left": "ordered", "operator": o, "right": "shipped"} for o in ORDER_SIGNS},
    )


DURATIONS = [(o, v, u) for o in ("GT", "GTE", "LT", "LTE") for v, u in ((30, "DAY"), (720, "HOUR"), (90, "MINUTE"))]


@query(
    forms_sql(
        SHIPPED_SQL,
        {f"{o}_{v}_{u}": f"shipped {SIGNS[o]} ordered + INTERVAL {v} {u}" for o, v, u in DURATIONS},
    )
)
def cond_duration(spark, sf_dir):
    return count_forms(
        shipped(spark, sf_dir),
        {
            f"{o}_{v}_{u}": {
                "type": "DURATION", "start_column": "ordered", "end_column": "shipped",
                "operator": o, "value": v, "unit": u,
            }
            for o, v, u in DURATIONS
        },
    )


@query(
    f"""SELECT count(*) FILTER (quantity > 10 AND discount < tax AND flag = 'R') AS all_hold,
               count(*) FILTER (quantity > 10 OR discount < tax OR flag = 'R') AS any_holds,
               count(*) AS all_of_none, CAST(0 AS BIGINT) AS any_of_none FROM {LINES_SQL}"""
)
def cond_and_or(spark, sf_dir):
    found = [
        predicates.condition(c)
        for c in (
            {"type": "COMPARISON", "left": "quantity", "operator": "GT", "right": {"type": "literal", "value": 10}},
            {"type": "COMPARISON", "left": "discount", "operator": "LT", "right": {"type": "column", "value": "tax"}},
            {"type": "COMPARISON", "left": "flag", "operator": "EQ", "right": {"type": "literal", "value": "R"}},
        )
    ]
    return lines(spark, sf_dir).agg(
        F.count_if(predicates.all_of(found)).alias("all_hold"),
        F.count_if(predicates.any_of(found)).alias("any_holds"),
        F.count_if(predicates.all_of([])).alias("all_of_none"),
        F.count_if(predicates.any_of([])).alias("any_of_none"),
    )


# RULE-* -----------------------------------------------------------------------------------

CHAIN = {
    "rule_id": "chain",
    "rule_type": "CROSS_COLUMN",
    "target_columns": ["discount", "tax", "quantity"],
    "conditions": [
        {"type": "COMPARISON", "left": "discount", "operator": "LTE", "right": {"type": "column", "value": "tax"}},
        {"type": "COMPARISON", "left": "tax", "operator": "LT", "right": {"type": "column", "value": "quantity"}},
    ],
}
DEPENDENCY = {
    "rule_id": "dependency",
    "rule_type": "CONDITIONAL_DEPENDENCY",
    "target_columns": ["flag", "quantity", "status", "tax"],
    "conditions": [
        {"role": "IF", "type": "SET", "left": "flag", "operator": "IN", "values": ["R", "N"]},
        {"role": "IF", "type": "COMPARISON", "left": "quantity", "operator": "GT", "right": {"type": "literal", "value": 20}},
        {"role": "THEN", "type": "COMPARISON", "left": "status", "operator": "EQ", "right": {"type": "literal", "value": "F"}},
        {"role": "THEN", "type": "NULL_CHECK", "column": "tax", "operator": "IS_NOT_NULL"},
    ],
}
TEMPORAL = {
    "rule_id": "temporal",
    "rule_type": "TEMPORAL",
    "target_columns": ["ordered", "shipped"],
    "conditions": [
        {"type": "TEMPORAL_ORDER", "left": "ordered", "operator": "BEFORE_EQUAL", "right": "shipped"},
        {"type": "DURATION", "start_column": "ordered", "end_column": "shipped", "operator": "LTE", "value": 365, "unit": "DAY"},
    ],
}
DEPENDENCY_SQL = "flag IN ('R', 'N') AND quantity > 20 AND (status <> 'F' OR tax IS NULL)"


@query(f"SELECT * FROM {LINES_SQL} WHERE discount > tax OR tax >= quantity")
def rule_cross_column(spark, sf_dir):
    return rule_ops.violating_rows(lines(spark, sf_dir), CHAIN)


@query(f"SELECT * FROM {LINES_SQL} WHERE {DEPENDENCY_SQL}")
def rule_conditional(spark, sf_dir):
    return rule_ops.violating_rows(lines(spark, sf_dir), DEPENDENCY)


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(ordered AS VARCHAR) AS ordered, CAST(shipped AS VARCHAR) AS shipped
        FROM {SHIPPED_SQL} WHERE ordered > shipped OR shipped > ordered + INTERVAL 365 DAY"""
)
def rule_temporal(spark, sf_dir):
    text = lambda c: F.col(c).cast("string").alias(c)
    return rule_ops.violating_rows(shipped(spark, sf_dir), TEMPORAL).select(
        "l_orderkey", "l_linenumber", text("ordered"), text("shipped")
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, price FROM {LINES_SQL} WHERE {DEPENDENCY_SQL}
        ORDER BY price DESC, l_orderkey, l_linenumber LIMIT 25"""
)
def rule_first_rows(spark, sf_dir):
    return rule_ops.violating_rows(
        lines(spark, sf_dir),
        DEPENDENCY,
        ["l_orderkey", "l_linenumber", "price"],
        limit=25,
        order=[F.desc("price"), "l_orderkey", "l_linenumber"],
    )


@query(f"SELECT count(*) AS violations, count(*) = 0 AS passed FROM {LINES_SQL} WHERE {DEPENDENCY_SQL}")
def rule_violation_count(spark, sf_dir):
    return rule_ops.violation_count(lines(spark, sf_dir), DEPENDENCY)


@query(
    f"""SELECT l_orderkey, count(*) AS late FROM {SHIPPED_SQL}
        WHERE shipped > ordered + INTERVAL 1 DAY * 700 AND l_linenumber <> 2 GROUP BY l_orderkey"""
)
def rule_bound_sql(spark, sf_dir):
    return rule_ops.bound_sql(
        spark,
        """SELECT l_orderkey, count(*) AS late FROM {lines}
           WHERE shipped > ordered + INTERVAL '1 day' * :rule_param_1 AND l_linenumber <> :rule_param_2
           GROUP BY l_orderkey""",
        {"rule_param_1": 700, "rule_param_2": 2},
        lines=shipped(spark, sf_dir),
    )


ONE_PASS = [
    CHAIN,
    DEPENDENCY,
    {"rule_id": "present", "rule_type": checks.NOT_NULL, "target_columns": ["flag"]},
    {"rule_id": "range", "rule_type": checks.BETWEEN, "target_columns": ["quantity"], "params": {"min_value": 2, "max_value": 49}},
    {"rule_id": "set", "rule_type": checks.IN_SET, "target_columns": ["flag"], "params": {"allowed_values": ["r", "X"]}},
    {"rule_id": "length", "rule_type": checks.LENGTH, "target_columns": ["status"], "params": {"min_length": 2}},
    {"rule_id": "pattern", "rule_type": checks.REGEX, "target_columns": ["status"], "params": {"regex": "^[F-N]$"}},
    {"rule_id": "free", "rule_type": checks.CUSTOM_SQL, "target_columns": ["tax"], "params": {"sql_expression": "tax IS NULL OR tax + discount < 0.1"}},
    {"rule_id": "rows", "rule_type": checks.ROW_COUNT, "target_columns": [], "params": {"min_value": 1, "max_value": 10}},
    {"rule_id": "unique", "rule_type": checks.UNIQUE, "target_columns": ["price"]},
    {"rule_id": "pair", "rule_type": checks.UNIQUE, "target_columns": ["flag", "price"]},
]


def one_pass_sql() -> str:
    cases = {
        "chain": ("CROSS_COLUMN", "discount > tax OR tax >= quantity", "(discount > tax OR tax >= quantity) IS NOT NULL"),
        "dependency": ("CONDITIONAL_DEPENDENCY", DEPENDENCY_SQL, f"({DEPENDENCY_SQL}) IS NOT NULL"),
        "present": (checks.NOT_NULL, "flag IS NULL", "TRUE"),
        "range": (checks.BETWEEN, "quantity NOT BETWEEN 2 AND 49", "quantity IS NOT NULL"),
        "set": (checks.IN_SET, "flag <> 'R'", "flag IS NOT NULL"),
        "length": (checks.LENGTH, "length(status) < 2", "status IS NOT NULL"),
        "pattern": (checks.REGEX, "status NOT BETWEEN 'F' AND 'N'", "status IS NOT NULL"),
        "free": (checks.CUSTOM_SQL, "NOT (tax IS NULL OR tax + discount < 0.1)", "(tax IS NULL OR tax + discount < 0.1) IS NOT NULL"),
    }
    parts = [
        f"""SELECT '{i}' AS rule_id, '{t}' AS rule_type, count(*) AS rows, count(*) FILTER ({known}) AS applicable,
            count(*) FILTER ({bad}) AS violations FROM {LINES_SQL}"""
        for i, (t, bad, known) in cases.items()
    ]
    parts.append(
        f"""SELECT 'rows', '{checks.ROW_COUNT}', count(*), CAST(1 AS BIGINT),
            CASE WHEN count(*) BETWEEN 1 AND 10 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END FROM {LINES_SQL}"""
    )
    parts.append(
        f"""SELECT 'unique', '{checks.UNIQUE}', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT),
            CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT)
            FROM (SELECT price, count(*) AS n FROM {LINES_SQL} GROUP BY price)"""
    )
    parts.append(
        f"""SELECT 'pair', '{checks.UNIQUE}', CAST(sum(n) AS BIGINT), CAST(sum(n) FILTER (flag IS NOT NULL) AS BIGINT),
            CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) FILTER (flag IS NOT NULL) AS BIGINT)
            FROM (SELECT flag, price, count(*) AS n FROM {LINES_SQL} GROUP BY flag, price)"""
    )
    return f"""SELECT *, CASE WHEN applicable > 0 THEN (applicable - violations) / applicable ELSE 1 END AS pass_rate,
               CASE WHEN violations = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
               FROM ({' UNION ALL '.join(parts)})"""


@query(one_pass_sql())
def rules_one_pass(spark, sf_dir):
    return rule_ops.run_rules(lines(spark, sf_dir), ONE_PASS).drop("message")


ODD_SQL = """(SELECT l_quantity, l_partkey, 2000000000 AS wide,
    CASE l_linenumber % 3 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(l_partkey AS VARCHAR) END AS mark FROM lineitem)"""
ODD_RULES = [
    {"rule_id": "overflow", "table_name": "odd", "rule_type": "CROSS_COLUMN", "conditions": [
        {"type": "ARITHMETIC", "target": "wide", "comparison_operator": "EQ",
         "expression": {"operator": "ADD", "operands": ["wide", "wide"]}}]},
    {"rule_id": "text_and_number", "table_name": "odd", "rule_type": "CROSS_COLUMN", "conditions": [
        {"type": "COMPARISON", "left": "mark", "operator": "GT", "right": {"type": "literal", "value": 50}}]},
    {"rule_id": "text_in_numbers", "table_name": "odd", "rule_type": "CONDITIONAL_DEPENDENCY", "conditions": [
        {"role": "IF", "type": "SET", "left": "mark", "operator": "IN", "values": [1, 2, 3]},
        {"role": "THEN", "type": "COMPARISON", "left": "mark", "operator": "NEQ", "right": {"type": "column", "value": "l_partkey"}}]},
    {"rule_id": "good", "table_name": "odd", "rule_type": checks.BETWEEN, "target_columns": ["l_quantity"], "params": {"min_value": 5}},
    {"rule_id": "unknown_column", "table_name": "odd", "rule_type": checks.NOT_NULL, "target_columns": ["gone"]},
    {"rule_id": "unknown_key", "table_name": "odd", "rule_type": checks.UNIQUE, "target_columns": ["wide", "gone"]},
    {"rule_id": "no_condition", "table_name": "odd", "rule_type": "TEMPORAL", "conditions": []},
    {"rule_id": "bad_sql", "table_name": "odd", "rule_type": checks.CUSTOM_SQL, "params": {"sql_expression": "no_such(1)"}},
    {"rule_id": "foreign", "table_name": "other", "rule_type": checks.NOT_NULL, "target_columns": ["wide"]},
]


def odd_sql() -> str:
    number = "TRY_CAST(mark AS DOUBLE)"
    broken = {
        "overflow": ("CROSS_COLUMN", "FALSE", "FALSE"),
        "text_and_number": ("CROSS_COLUMN", f"{number} <= 50", f"{number} IS NOT NULL"),
        "text_in_numbers": ("CONDITIONAL_DEPENDENCY", f"{number} IN (1, 2, 3) AND {number} = l_partkey", f"{number} IS NOT NULL"),
        "good": (checks.BETWEEN, "l_quantity < 5", "l_quantity IS NOT NULL"),
    }
    parts = [
        f"""SELECT '{i}' AS rule_id, '{t}' AS rule_type, count(*) FILTER ({known}) AS applicable,
            count(*) FILTER ({bad}) AS violations, CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
            FROM {ODD_SQL}"""
        for i, (t, bad, known) in broken.items()
    ]
    errors = ("unknown_column", "unknown_key", "no_condition", "bad_sql")
    parts += [
        f"SELECT '{r['rule_id']}', '{r['rule_type']}', NULL, NULL, 'ERROR'" for r in ODD_RULES if r["rule_id"] in errors
    ]
    return " UNION ALL ".join(parts)


@query(odd_sql())
def rules_with_errors(spark, sf_dir):
    rest = F.col("l_linenumber") % 3
    odd = table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_partkey",
        F.lit(2_000_000_000).alias("wide"),
        F.when(rest == 0, "abc").when(rest == 1, F.col("l_partkey").cast("string")).alias("mark"),
    )
    return rule_ops.run_rules(odd, ODD_RULES, "odd").select("rule_id", "rule_type", "applicable", "violations", "status")


@query(
    f"""SELECT rule_type, violations, violations = 0 AS passed
        FROM ({one_pass_sql()}) WHERE rule_id IN ('chain', 'unique', 'pair', 'rows', 'range')"""
)
def rule_violation_counts(spark, sf_dir):
    df = lines(spark, sf_dir)
    chosen = [r for r in ONE_PASS if r["rule_id"] in ("chain", "unique", "pair", "rows", "range")]
    counted = [
        rule_ops.violation_count(df, r).select(F.lit(r["rule_type"]).alias("rule_type"), "violations", "passed")
        for r in chosen
    ]
    return reduce(DataFrame.unionByName, counted)
