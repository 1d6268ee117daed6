"""Whole flows: the multi-column rules that a table suggests, and the labelled benchmark."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import checks, profile
from plumbline.plans import flows
from plumbline.sources import labelled
from queries.base import query, table
from queries.proposing import CASES_SQL, cases, support_sql

CODES = ["status", "priority", "stage", "closed_at"]


def _dependencies_sql() -> str:
    """Pairs of columns whose values repeat, and the share of values of one that have one other."""
    return " UNION ALL ".join(
        f"""SELECT '{min(a, b)},{max(a, b)}' AS columns, count(*) AS n_values, count(*) FILTER (d > 1) AS n_broken
            FROM (SELECT {a}, count(DISTINCT {b}) AS d FROM {CASES_SQL} WHERE {a} IS NOT NULL GROUP BY {a})
            WHERE (SELECT count(DISTINCT {a}) <= 0.5 * count(*) AND count(DISTINCT {b}) <= 0.5 * count(*)
                     AND count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1 FROM {CASES_SQL})"""
        for a in CODES
        for b in CODES
        if a != b
    )


@query(
    f"""
    WITH s AS ({support_sql()}),
    w AS (SELECT if_column, then_column, count(DISTINCT then_value) AS all_values, sum(CASE WHEN then_value IS NULL THEN n ELSE 0 END) AS all_nulls,
                 sum(n) AS all_rows FROM s GROUP BY ALL),
    c AS (SELECT if_column, if_value, then_column, sum(n) AS support, sum(CASE WHEN then_value IS NOT NULL THEN n ELSE 0 END) AS present,
                 count(then_value) AS v, max(CASE WHEN then_value IS NOT NULL THEN n END) AS top FROM s GROUP BY ALL),
    k AS (
      SELECT c.*, CASE WHEN mixed AND support - present >= 0.95 * support THEN 'IS_NULL'
                       WHEN cat AND all_values > 1 AND top >= 0.95 * support THEN 'EQ'
                       WHEN cat AND v < all_values AND present >= 0.95 * support THEN 'IN'
                       WHEN mixed AND present >= 0.95 * support THEN 'IS_NOT_NULL' END AS kind,
             CASE WHEN mixed AND support - present >= 0.95 * support THEN support - present
                  WHEN cat AND all_values > 1 AND top >= 0.95 * support THEN top ELSE present END AS holds
      FROM (SELECT c.*, w.all_values, w.all_nulls > 0 AND w.all_nulls < w.all_rows AS mixed, c.then_column <> 'closed_at' AS cat
            FROM c JOIN w ON c.if_column = w.if_column AND c.then_column = w.then_column) c)
    SELECT 'CONDITIONAL_DEPENDENCY' AS rule_type, least(if_column, then_column) || ',' || greatest(if_column, then_column) AS columns,
           '"' || if_value || '"' AS if_value, kind, CAST(holds AS BIGINT) / CAST(support AS BIGINT) AS confidence
    FROM k WHERE kind IS NOT NULL
    UNION ALL
    SELECT 'FUNCTIONAL_DEPENDENCY', columns, NULL, NULL, max((n_values - n_broken) / n_values)
    FROM ({_dependencies_sql()}) WHERE n_values > 1 AND n_values - n_broken >= 0.95 * n_values GROUP BY columns
    """
)
def flow_mine_rules(spark, sf_dir):
    df = cases(spark, sf_dir)
    found = flows.mine_rules(df, "cases", profile.profile(df, "cases"))
    at = lambda i: F.get("conditions", F.lit(i))
    return found.select(
        "rule_type",
        F.array_join(F.array_sort("target_columns"), ",").alias("columns"),
        at(0)["right_value"].alias("if_value"),
        at(1)["operator"].alias("kind"),
        "confidence",
    )


LABELLED = {
    # table: (key, state, amount, rank)
    "orders": ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
    "customer": ("c_custkey", "c_mktsegment", "c_acctbal", "c_name"),
}
# what rules are wanted of each table: type, column, values or shortest length
WANTED = [
    (checks.NOT_NULL, "id", {}),
    (checks.UNIQUE, "ID", {}),
    (checks.LENGTH, "id", {"minLength": 10, "maxLength": 10}),
    (checks.IN_SET, "state", {"allowedValues": ["o", "f", "p"]}),
    (checks.IN_SET, "rank", {"allowedValues": ["1-urgent", "2-HIGH", "3-medium", "4-none"]}),
    (checks.BETWEEN, "amount", {"minValue": 0.0}),
    (checks.LENGTH, "rank", {"minLength": 18}),
]


def labelled_rows(spark, sf_dir, name: str):
    """Rows of which five in ten are labelled broken, one of these for no visible reason."""
    key, state, amount, rank = (F.col(c) for c in LABELLED[name])
    fault = key % 10
    return table(spark, sf_dir, name).select(
        F.when(fault != 1, F.format_string("k%09d", key)).alias("id"),
        F.when(fault == 2, "?").otherwise(state).alias("state"),
        F.when(fault == 3, 1e9).otherwise(amount).alias("amount"),
        F.when(fault == 4, "  ").otherwise(rank).alias("rank"),
        (~fault.between(1, 5)).alias("_is_valid"),
        F.concat(F.lit("FAULT_"), fault.cast("string")).alias("_injected_fault"),
    )


def _benchmark_sql(name: str) -> str:
    """Scores of one table: what its clean rows suggest, met with WANTED and tried on all rows."""
    key, state, amount, rank = LABELLED[name]
    few = "({c}_values BETWEEN 1 AND 20)"
    meets = [
        f"len(list_intersect({c}_set, {[v.lower() for v in given['allowedValues']]})) >= 0.7 * least(len({c}_set), {len(given['allowedValues'])}) AND {few.format(c=c)}"
        if kind == checks.IN_SET
        else f"{c.lower()}_short = {given['minLength']}" + (f" AND {c}_long = {given['maxLength']}" if "maxLength" in given else "")
        if kind == checks.LENGTH
        else "TRUE"
        for kind, c, given in WANTED
    ]
    found = " + ".join(f"CASE WHEN {m} THEN 1 ELSE 0 END" for m in meets)
    facts = ", ".join(
        f"count(DISTINCT {c}) AS {c}_values, min(length({c})) AS {c}_short, max(length({c})) AS {c}_long, list(DISTINCT lower({c})) AS {c}_set"
        for c in ("id", "state", "rank")
    )
    broken = " OR ".join(
        [f"{c} IS NULL OR trim({c}) = '' OR length({c}) NOT BETWEEN {c}_short AND {c}_long" for c in ("id", "state", "rank")]
        + [f"({few.format(c=c)} AND NOT list_contains({c}_set, lower({c})))" for c in ("state", "rank")]
        + ["amount NOT BETWEEN low AND high"]
    )
    return f"""
    SELECT '{name}' AS table_name, 9 + CASE WHEN {few.format(c='state')} THEN 1 ELSE 0 END + CASE WHEN {few.format(c='rank')} THEN 1 ELSE 0 END AS generated,
           {len(WANTED)} AS expected, {found} AS found, d.* EXCLUDE (faults), faults
    FROM (SELECT {facts}, min(amount) AS low, max(amount) AS high FROM {_labelled_sql(name)} WHERE ok) f,
      LATERAL (SELECT count(*) AS records, count(*) FILTER (ok) AS clean_records, count(*) FILTER (ok AND NOT ({broken})) AS clean_passed,
                      count(*) FILTER (NOT ok) AS faults, count(*) FILTER (NOT ok AND ({broken})) AS caught_defects FROM {_labelled_sql(name)}) d"""


def _labelled_sql(name: str) -> str:
    key, state, amount, rank = LABELLED[name]
    return f"""(SELECT CASE WHEN {key} % 10 <> 1 THEN printf('k%09d', {key}) END AS id, CASE WHEN {key} % 10 = 2 THEN '?' ELSE {state} END AS state,
        CASE WHEN {key} % 10 = 3 THEN 1e9 ELSE {amount} END AS amount, CASE WHEN {key} % 10 = 4 THEN '  ' ELSE {rank} END AS rank,
        {key} % 10 NOT BETWEEN 1 AND 5 AS ok FROM {name})"""


@query(
    f"""
    WITH b AS ({" UNION ALL ".join(map(_benchmark_sql, LABELLED))}),
    s AS (SELECT *, round(found / generated * 100, 2) AS precision, round(found / expected * 100, 2) AS recall FROM b),
    t AS (SELECT *, round(2 * (precision * recall) / (precision + recall), 2) AS f1, round(clean_passed / clean_records * 100, 2) AS clean_pass_rate,
                 round(caught_defects / faults * 100, 2) AS detection_rate FROM s)
    SELECT table_name, CAST(generated AS BIGINT) AS generated, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS true_positives,
           precision, recall, f1, records, clean_records, clean_passed, faults AS defect_records, caught_defects, clean_pass_rate, detection_rate,
           round(avg(f1) OVER (), 2) AS average_f1,
           CASE WHEN round(sum(caught_defects) OVER () / sum(faults) OVER () * 100, 2) >= 90 AND round(avg(f1) OVER (), 2) >= 80 THEN 'EXCELLENT' ELSE 'GOOD' END AS status
    FROM t
    """
)
def flow_labelled_benchmark(spark, sf_dir):
    """Rules that clean rows suggest, against those wanted and against labelled rows."""
    records = {name: labelled_rows(spark, sf_dir, name) for name in LABELLED}
    rules = [
        {"rule_type": kind, "target_columns": [column], "parameters": given, "category": None, "reason": None}
        for kind, column, given in WANTED
    ]
    document = {"tables": {name: {"table_name": name, "expected_rules": rules} for name in LABELLED}}
    texts = spark.createDataFrame([(json.dumps(document),)], "text string")
    parsed = texts.select(F.from_json("text", schemas.EXPECTED_DOCUMENT).alias("d"))
    wanted = labelled.expected_rules(parsed, F.col("d.tables"))
    scores, detection, overall = flows.labelled_benchmark(records, wanted)
    joined = scores.drop("found_expected").join(detection, "table_name")
    return joined.withColumns({c: overall.select(c).scalar() for c in ("average_f1", "status")})
