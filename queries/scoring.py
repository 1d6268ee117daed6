"""EV-*."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import checks, evaluate, recommend
from plumbline.operators import rules as rule_ops
from queries.base import TABLES, query, table
from queries.proposing import rules_sql
from queries.ruletables import (
    COLUMNS_SQL, REVIEWED_SQL, RULES_SQL, USED_SQL, derived_rules, known_columns, reviews,
)
from queries.sources import labelled_documents

KINDS = f"""CASE {{k}} % 3 WHEN 0 THEN '{checks.IN_SET}' WHEN 1 THEN '{checks.LENGTH}' ELSE '{checks.NOT_NULL}' END"""

PROPOSED_SQL = f"""(SELECT 'nation_' || c_nationkey AS table_name, 'p' || c_custkey AS rule_id, {KINDS.format(k='c_custkey')} AS rule_type,
    'col_' || c_custkey % 4 AS col, list_transform(range(c_custkey % 5, c_custkey % 5 + c_custkey % 4), lambda x: 'v' || x) AS allowed,
    c_custkey % 2 AS min_length, c_custkey % 5 AS max_length FROM customer)"""
EXPECTED_SQL = f"""(SELECT 'nation_' || s_nationkey AS table_name, s_suppkey AS expected_index, {KINDS.format(k='s_suppkey')} AS rule_type,
    'col_' || s_suppkey % 4 AS col, list_transform(range(s_suppkey % 5, s_suppkey % 5 + 3), lambda x: 'v' || x) AS allowed,
    s_suppkey % 2 AS min_length, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 END AS max_length FROM supplier)"""
MATCH_SQL = f"""(SELECT p.table_name, p.rule_id, min(e.expected_index) AS expected_index FROM {PROPOSED_SQL} p JOIN {EXPECTED_SQL} e
    ON p.table_name = e.table_name AND p.rule_type = e.rule_type AND p.col = e.col
    WHERE CASE p.rule_type
      WHEN '{checks.IN_SET}' THEN len(p.allowed) > 0 AND len(list_intersect(p.allowed, e.allowed)) >= 0.7 * least(len(p.allowed), len(e.allowed))
      WHEN '{checks.LENGTH}' THEN p.min_length = e.min_length AND (e.max_length IS NULL OR p.max_length = e.max_length)
      ELSE TRUE END GROUP BY ALL)"""


def _params(**given):
    return F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PARAMS.fields]
    )


def _kind(k):
    return F.when(k % 3 == 0, checks.IN_SET).when(k % 3 == 1, checks.LENGTH).otherwise(checks.NOT_NULL)


def _values(start, stop, mark: str):
    numbers = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda x: F.concat(F.lit(mark), x.cast("string")))


def proposed(spark, sf_dir) -> DataFrame:
    """One proposed rule per customer, for its nation's table."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table_name"),
        F.concat(F.lit("p"), k.cast("string")).alias("rule_id"),
        _kind(k).alias("rule_type"),
        F.array(F.concat(F.lit("col_"), (k % 4).cast("string"))).alias("target_columns"),
        _params(
            allowed_values=_values(k % 5, k % 5 + k % 4, "v"), min_length=k % 2, max_length=k % 5
        ).alias("params"),
    )


def expected(spark, sf_dir) -> DataFrame:
    """One expected rule per supplier, in capitals to be matched without case."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("table_name"),
        k.alias("expected_index"),
        _kind(k).alias("rule_type"),
        F.array(F.concat(F.lit("COL_"), (k % 4).cast("string"))).alias("target_columns"),
        _params(
            allowed_values=_values(k % 5, k % 5 + 3, "V"),
            min_length=k % 2,
            max_length=F.when(k % 2 == 0, k % 5),
        ).alias("params"),
    )


@query(f"SELECT * FROM {MATCH_SQL}")
def ev_matches(spark, sf_dir):
    return evaluate.matches(proposed(spark, sf_dir), expected(spark, sf_dir))


SCORES_SQL = f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * (precision * recall) / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT *, CASE WHEN generated > 0 THEN true_positives / generated * 100 ELSE 0 END AS precision,
              CASE WHEN expected > 0 THEN found_expected / expected * 100 ELSE 0 END AS recall FROM (
      SELECT table_name, COALESCE(g, 0) AS generated, COALESCE(w, 0) AS expected, COALESCE(t, 0) AS true_positives, COALESCE(f, 0) AS found_expected
      FROM (SELECT table_name, count(*) AS g FROM {PROPOSED_SQL} GROUP BY 1) a
      FULL JOIN (SELECT table_name, count(*) AS w FROM {EXPECTED_SQL} GROUP BY 1) b USING (table_name)
      LEFT JOIN (SELECT table_name, count(*) AS t, count(DISTINCT expected_index) AS f FROM {MATCH_SQL} GROUP BY 1) c USING (table_name))))"""


@query(f"SELECT * FROM {SCORES_SQL}")
def ev_rule_scores(spark, sf_dir):
    return evaluate.rule_scores(proposed(spark, sf_dir), expected(spark, sf_dir))


@query(
    f"""SELECT table_name, expected_index, rule_type FROM {EXPECTED_SQL} e
        WHERE NOT EXISTS (SELECT 1 FROM {MATCH_SQL} m WHERE m.table_name = e.table_name AND m.expected_index = e.expected_index)"""
)
def ev_missing_expected(spark, sf_dir):
    return evaluate.missing_expected(proposed(spark, sf_dir), expected(spark, sf_dir)).select(
        "table_name", "expected_index", "rule_type"
    )


# Labelled documents: toxic ones are said to break the length, poor ones the range.
LENGTH_LABEL, RANGE_LABEL = f"{checks.LENGTH}:text", f"{checks.BETWEEN}:n_chars"
UNIQUE_LABEL = f"{checks.UNIQUE}:source"
DOCUMENT_RULES = [
    {"rule_id": "length", "rule_type": checks.LENGTH, "target_columns": ["text"], "params": {"min_length": 100, "max_length": 3000}},
    {"rule_id": "range", "rule_type": checks.BETWEEN, "target_columns": ["n_chars"], "params": {"min_value": 200, "max_value": 5000}},
    {"rule_id": "language", "rule_type": checks.IN_SET, "target_columns": ["lang"], "params": {"allowed_values": ["EN", "FR", "DE"]}},
    {"rule_id": "source", "rule_type": checks.UNIQUE, "target_columns": ["source"]},
]
TESTED_SQL = f"""(SELECT d.doc_id, quality = 1 AND toxic = 0 AS valid,
      CASE WHEN toxic = 1 THEN 'DUPLICATE_PRIMARY_KEY' WHEN quality = 0 THEN 'LOW_QUALITY' END AS fault,
      CASE WHEN toxic = 1 THEN ['{LENGTH_LABEL}'] WHEN quality = 0 THEN ['{RANGE_LABEL}', '{LENGTH_LABEL}'] ELSE [] END AS want,
      list_filter([CASE WHEN toxic = 1 AND (SELECT count(*) > count(DISTINCT source) FROM documents) THEN '{UNIQUE_LABEL}' END,
        CASE WHEN length(text) NOT BETWEEN 100 AND 3000 THEN '{LENGTH_LABEL}' END,
        CASE WHEN n_chars NOT BETWEEN 200 AND 5000 THEN '{RANGE_LABEL}' END,
        CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN '{checks.IN_SET}:lang' END], lambda x: x IS NOT NULL) AS failed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def tested(spark, sf_dir) -> DataFrame:
    fault = F.col("_injected_fault")
    rows = labelled_documents(spark, sf_dir).withColumn(
        "_expected_violations",
        F.when(fault == "TOXIC_TEXT", F.array(F.lit(LENGTH_LABEL)))
        .when(fault == "LOW_QUALITY", F.array(F.lit(RANGE_LABEL), F.lit(LENGTH_LABEL))),
    ).withColumn("_injected_fault", F.when(fault == "TOXIC_TEXT", "DUPLICATE_PRIMARY_KEY").otherwise(fault))
    return evaluate.tested_rows(rows, DOCUMENT_RULES, key="source")


@query(
    f"""SELECT 'documents' AS table_name, *, CASE WHEN clean_records > 0 THEN clean_passed / clean_records * 100 ELSE 100 END AS clean_pass_rate,
        CASE WHEN defect_records > 0 THEN caught_defects / defect_records * 100 ELSE 100 END AS detection_rate
        FROM (SELECT count(*) AS records, count(*) FILTER (COALESCE(valid, TRUE)) AS clean_records,
          count(*) FILTER (COALESCE(valid, TRUE) AND len(failed) = 0) AS clean_passed, count(*) FILTER (NOT valid) AS defect_records,
          count(*) FILTER (NOT valid AND len(failed) > 0) AS caught_defects FROM {TESTED_SQL})"""
)
def ev_detection(spark, sf_dir):
    return evaluate.detection_scores(tested(spark, sf_dir), "documents")


@query(
    f"""SELECT fault, len(failed) > 0 AS is_detected, array_to_string(failed[1:2], ',') AS detected_by, count(*) AS n
        FROM {TESTED_SQL} WHERE NOT valid GROUP BY ALL"""
)
def ev_scenarios(spark, sf_dir):
    found = evaluate.scenarios(tested(spark, sf_dir))
    return found.groupBy(
        "fault", "is_detected", F.array_join("detected_by", ",").alias("detected_by")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT doc_id, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(failed, x))), ',') AS not_detected,
        array_to_string(list_sort(list_filter(failed, lambda x: NOT list_contains(want, x))), ',') AS not_expected,
        len(list_filter(want, lambda x: NOT list_contains(failed, x))) = 0 AS found_all FROM {TESTED_SQL} WHERE NOT valid"""
)
def ev_expected_violations(spark, sf_dir):
    found = evaluate.expected_violations(tested(spark, sf_dir))
    return found.select(
        "doc_id",
        F.array_join("not_detected", ",").alias("not_detected"),
        F.array_join("not_expected", ",").alias("not_expected"),
        "found_all",
    )


DETECTION_SQL = """(SELECT 'nation_' || c_nationkey AS table_name, count(*) AS records, count(*) FILTER (c_acctbal < 0) AS defect_records,
    count(*) FILTER (c_acctbal < -300) AS caught_defects, count(*) FILTER (c_acctbal >= 0 AND c_custkey % 9 > 0) AS clean_passed FROM customer GROUP BY 1)"""


@query(
    f"""SELECT *, CASE WHEN detection_rate >= 90 AND average_f1 >= 80 THEN 'EXCELLENT' ELSE 'GOOD' END AS status FROM (
        SELECT count(*) AS tables, CAST(sum(generated) AS BIGINT) AS rules_generated, CAST(sum(expected) AS BIGINT) AS rules_expected,
          CAST(sum(true_positives) AS BIGINT) AS true_positives, round(avg(precision), 2) AS average_precision, round(avg(recall), 2) AS average_recall,
          round(avg(f1), 2) AS average_f1, round(sum(caught_defects) / sum(defect_records) * 100, 2) AS detection_rate,
          round(avg(clean_passed / (records - defect_records) * 100), 2) AS clean_pass_rate
        FROM {SCORES_SQL} s JOIN {DETECTION_SQL} d USING (table_name))"""
)
def ev_overall(spark, sf_dir):
    balance = F.col("c_acctbal")
    clean = balance >= 0
    detection = (
        table(spark, sf_dir, "customer")
        .groupBy(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table_name"))
        .agg(
            F.count_if(~clean).alias("defect_records"),
            F.count_if(balance < -300).alias("caught_defects"),
            (F.count_if(clean & (F.col("c_custkey") % 9 > 0)) / F.count_if(clean) * 100).alias("clean_pass_rate"),
        )
    )
    scores = evaluate.rule_scores(proposed(spark, sf_dir), expected(spark, sf_dir))
    return evaluate.overall(scores, detection, 2)


SAFETY_SQL = f"""(SELECT table_name, column_count, total_rules, covered_columns, invalid_columns, duplicates, type_failures,
      CASE WHEN column_count > 0 THEN covered_columns / column_count * 100 ELSE 0 END AS coverage_pct,
      CASE WHEN total_rules > 0 THEN invalid_columns / total_rules ELSE 0 END AS invalid_column_rate,
      CASE WHEN total_rules > 0 THEN duplicates / total_rules ELSE 0 END AS duplicate_rate,
      CASE WHEN total_rules > 0 THEN type_failures / total_rules ELSE 0 END AS type_failure_rate,
      invalid_columns + duplicates + type_failures = 0 AS is_safe
    FROM (SELECT table_name, COALESCE(cc, 0) AS column_count, COALESCE(n, 0) AS total_rules, COALESCE(cov, 0) AS covered_columns,
            COALESCE(inv, 0) AS invalid_columns, COALESCE(dup, 0) AS duplicates, COALESCE(tf, 0) AS type_failures
      FROM (SELECT table_name, count(*) AS cc FROM {COLUMNS_SQL} GROUP BY 1) c
      FULL JOIN (SELECT table_name, count(*) AS n, count(*) - count(DISTINCT (rule_type, columns)) AS dup FROM {RULES_SQL} GROUP BY 1) r USING (table_name)
      LEFT JOIN (SELECT u.table_name, count(*) FILTER (k.type_class IS NULL) AS inv, count(DISTINCT k.column_name) AS cov,
            count(*) FILTER (rule_type = '{checks.BETWEEN}' AND type_class = 'STRING' OR rule_type = '{checks.LENGTH}' AND type_class <> 'STRING') AS tf
          FROM {USED_SQL} u LEFT JOIN {COLUMNS_SQL} k ON k.table_name = u.table_name AND k.column_name = u.c GROUP BY 1) f USING (table_name)))"""


@query(f"SELECT * FROM {SAFETY_SQL}")
def ev_safety(spark, sf_dir):
    return evaluate.safety(derived_rules(spark, sf_dir), known_columns(spark, sf_dir))


@query(f"SELECT table_name, rule_type, count(*) AS n FROM {RULES_SQL} GROUP BY ROLLUP (table_name, rule_type)")
def ev_rules_by_type(spark, sf_dir):
    return evaluate.rules_by_type(derived_rules(spark, sf_dir))


@query(
    f"""SELECT count(*) AS tables, CAST(sum(column_count) AS BIGINT) AS columns, CAST(sum(total_rules) AS BIGINT) AS rules,
        sum(covered_columns) / sum(column_count) * 100 AS coverage_pct, sum(total_rules) / count(*) AS rules_per_table,
        sum(invalid_columns) / sum(total_rules) AS invalid_column_rate, sum(duplicates) / sum(total_rules) AS duplicate_rate,
        sum(type_failures) / sum(total_rules) AS type_failure_rate, bool_and(is_safe) AS all_safe FROM {SAFETY_SQL}"""
)
def ev_full_evaluation(spark, sf_dir):
    return evaluate.full_evaluation(
        evaluate.safety(derived_rules(spark, sf_dir), known_columns(spark, sf_dir))
    )


@query(
    f"""SELECT engine, count(*) AS total_candidates, count(*) FILTER (status <> 'DRAFT') AS total_reviewed,
        CASE WHEN count(*) FILTER (status <> 'DRAFT') > 0 THEN count(*) FILTER (status = 'ACCEPTED') / count(*) FILTER (status <> 'DRAFT') ELSE 0 END AS accept_rate,
        CASE WHEN count(*) FILTER (status <> 'DRAFT') > 0 THEN count(*) FILTER (status = 'EDITED') / count(*) FILTER (status <> 'DRAFT') ELSE 0 END AS edit_rate,
        CASE WHEN count(*) FILTER (status <> 'DRAFT') > 0 THEN count(*) FILTER (status = 'REJECTED') / count(*) FILTER (status <> 'DRAFT') ELSE 0 END AS reject_rate
        FROM {REVIEWED_SQL} GROUP BY ROLLUP (engine)"""
)
def ev_review_rates(spark, sf_dir):
    from plumbline.operators import ruletable

    reviewed = ruletable.apply_reviews(derived_rules(spark, sf_dir), reviews(spark, sf_dir))
    return evaluate.review_rates(reviewed)


@query(
    f"""SELECT *, executed / mapped AS executability, accepted / suggestions AS acceptance_rate, used / suggestions AS utilization_rate FROM
        (SELECT count(*) AS suggestions, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status IN ('ACCEPTED', 'EDITED')) AS used FROM {RULES_SQL}),
        (SELECT count(*) AS mapped, count(*) FILTER (event_type <> 'error') AS executed FROM events)"""
)
def ev_suggestion_rates(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "ERROR").otherwise("PASSED").alias("status")
    )
    return evaluate.suggestion_rates(derived_rules(spark, sf_dir), runs)


@query(
    f"""SELECT table_name, count(s) AS selected, count(t) AS truth, count(s + t) AS correct,
        CASE WHEN count(t) > 0 THEN count(s + t) / count(t) ELSE 0 END AS recall, CASE WHEN count(s) > 0 THEN count(s + t) / count(s) ELSE 0 END AS precision
        FROM (SELECT DISTINCT table_name, rule_type, 1 AS s FROM {PROPOSED_SQL}) a
        FULL JOIN (SELECT DISTINCT table_name, rule_type, 1 AS t FROM {EXPECTED_SQL}) b USING (table_name, rule_type) GROUP BY table_name"""
)
def ev_router_scores(spark, sf_dir):
    return evaluate.router_scores(proposed(spark, sf_dir), expected(spark, sf_dir))
