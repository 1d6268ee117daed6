"""Rules that contradict or imply each other, on rules derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import checks, mine, rulegraph
from queries.base import query, table

# One rule per line, between two of four columns of a table per order.
RULES_SQL = """(SELECT 'order_' || l_orderkey AS table_name, 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS rule_id,
    'c' || (l_partkey % 4) AS a, 'c' || (l_suppkey % 4) AS b, l_linenumber % 3 AS kind, CAST(l_quantity AS BIGINT) % 5 AS days, l_discount AS confidence
    FROM (SELECT DISTINCT * FROM lineitem) WHERE l_partkey % 4 <> l_suppkey % 4)"""


def line_rules(spark, sf_dir):
    part, supplier, number = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    kind = number % 3
    a, b = (F.concat(F.lit("c"), (c % 4).cast("string")) for c in (part, supplier))
    order = mine.condition(type="TEMPORAL_ORDER", left=a, operator=F.when(kind == 0, "BEFORE").otherwise("EQ"), right_type="column", right_value=b)
    after = mine.condition(
        type="DURATION", start_column=a, end_column=b, operator="GTE",
        value=(F.col("l_quantity").cast("bigint") % 5).cast("double"), unit="DAY",
    )
    text = lambda c: c.cast("string")
    given = {
        "rule_id": F.concat(F.lit("r"), F.concat_ws("_", text(F.col("l_orderkey")), text(number), text(part), text(supplier))),
        "table_name": F.concat(F.lit("order_"), text(F.col("l_orderkey"))),
        "rule_type": F.lit("TEMPORAL"),
        "target_columns": F.array(a, b),
        "conditions": F.array(F.when(kind == 1, after).otherwise(order)),
        "confidence": F.col("l_discount"),
        "validation_status": F.lit("VALID"),
    }
    lines = table(spark, sf_dir, "lineitem").distinct().where(part % 4 != supplier % 4)
    return lines.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RULES.fields])


# kind 0: a before b; 1: b at least so many days after a; 2: a equals b
EDGES_SQL = f"""
    SELECT table_name, rule_id, confidence, b AS x, a AS y, CASE kind WHEN 0 THEN -1 WHEN 1 THEN -days * 86400000000 ELSE 0 END AS w FROM {RULES_SQL}
    UNION ALL SELECT table_name, rule_id, confidence, a, b, 0 FROM {RULES_SQL} WHERE kind = 2"""
CONTRADICTIONS_SQL = f"""
    WITH RECURSIVE e AS MATERIALIZED ({EDGES_SQL}),
    tight AS MATERIALIZED (SELECT table_name, x, y, min(w) AS w, arg_min(rule_id, (w, rule_id)) AS rule_id FROM e GROUP BY ALL),
    walks AS (
      SELECT table_name, rule_id AS start, x AS home, y AS here, w, [rule_id] AS path, [x] AS columns FROM e
      UNION ALL
      SELECT k.table_name, start, home, t.y, k.w + t.w, list_append(path, t.rule_id), list_append(columns, t.x)
      FROM walks AS k JOIN tight AS t ON t.table_name = k.table_name AND t.x = k.here WHERE len(path) < 4),
    closed AS (SELECT * FROM walks WHERE home = here AND w < 0),
    best AS (
      SELECT table_name, start, home, columns[2] AS second, arg_min(w, (len(path), w, path)) AS w,
             arg_min(path, (len(path), w, path)) AS path, arg_min(columns, (len(path), w, path)) AS columns
      FROM closed GROUP BY ALL),
    one AS (
      SELECT table_name, start, arg_min(w, (len(path), w, path)) AS w, arg_min(path, (len(path), w, path)) AS path
      FROM best WHERE len(list_distinct(columns)) = len(columns) GROUP BY ALL)
    SELECT table_name, start AS rule_id, array_to_string(list_sort(list_filter(list_distinct(path), lambda p: p <> start)), ',') AS partners,
           w AS slack FROM one
    """


@query(CONTRADICTIONS_SQL)
def rt_contradictions(spark, sf_dir):
    found = rulegraph.contradictions(line_rules(spark, sf_dir))
    return found.withColumn("partners", F.array_join("partners", ","))


@query(
    f"""
    SELECT rule_id, CASE WHEN partners IS NULL THEN 'VALID' ELSE 'WARNING' END AS validation_status,
           CASE WHEN partners = '' THEN 'Contradicts itself' ELSE 'Cannot hold together with ' || replace(partners, ',', ', ') END AS validation_message
    FROM {RULES_SQL} LEFT JOIN ({CONTRADICTIONS_SQL}) USING (rule_id)
    """
)
def rt_contradiction_warnings(spark, sf_dir):
    found = rulegraph.warn_of_contradictions(line_rules(spark, sf_dir))
    return found.select("rule_id", "validation_status", "validation_message")


# Orders c0 < c1 < ...: a rule of a line leads from a smaller to a greater column, so nothing contradicts.
ASCENDING_SQL = """(SELECT 'nation_' || c_nationkey AS table_name, 'r' || c_custkey AS rule_id, c_custkey % 7 AS i,
    c_custkey % 7 + 1 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 3 AS j FROM customer)"""


def ascending_rules(spark, sf_dir):
    key = F.col("c_custkey")
    first = key % 7
    second = first + 1 + F.floor(F.abs("c_acctbal")) % 3
    a, b = (F.concat(F.lit("c"), c.cast("string")) for c in (first, second))
    given = {
        "rule_id": F.concat(F.lit("r"), key.cast("string")),
        "table_name": F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")),
        "rule_type": F.lit("CROSS_COLUMN"),
        "target_columns": F.array(a, b),
        "conditions": F.array(mine.condition(type="COMPARISON", left=a, operator="LTE", right_type="column", right_value=b)),
        "confidence": F.lit(1.0),
    }
    return table(spark, sf_dir, "customer").select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RULES.fields]
    )


# Of equal rules the first by id stays; of the others those that no path of two or more edges replaces.
@query(
    f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT table_name, i, j, min(rule_id) AS rule_id FROM {ASCENDING_SQL} GROUP BY ALL),
    paths AS (
      SELECT table_name, i, j, 1 AS k FROM e
      UNION
      SELECT p.table_name, p.i, e.j, 2 FROM paths AS p JOIN e ON e.table_name = p.table_name AND e.i = p.j)
    SELECT table_name, rule_id FROM e
    WHERE NOT EXISTS (SELECT 1 FROM paths AS p WHERE p.table_name = e.table_name AND p.i = e.i AND p.j = e.j AND p.k = 2)
    """
)
def rt_without_implied(spark, sf_dir):
    return rulegraph.without_implied(ascending_rules(spark, sf_dir)).select("table_name", "rule_id")


@query(
    f"""
    WITH kept AS (
      SELECT table_name, i, j FROM {ASCENDING_SQL} GROUP BY ALL),
    f AS (SELECT a.table_name, a.i, a.j FROM kept AS a)
    SELECT table_name, 'd' || i || '_' || j AS rule_id FROM f
    WHERE EXISTS (
      WITH RECURSIVE reach AS (
        SELECT g.j AS here FROM f AS g WHERE g.table_name = f.table_name AND g.i = f.i AND g.j <> f.j
        UNION SELECT g.j FROM reach JOIN f AS g ON g.i = reach.here WHERE g.table_name = f.table_name)
      SELECT 1 FROM reach WHERE here = f.j)
    """
)
def rt_implied_dependencies(spark, sf_dir):
    found = ascending_rules(spark, sf_dir).dropDuplicates(["table_name", "target_columns"])
    name = F.concat(F.lit("d"), F.substring(F.col("target_columns")[0], 2, 9), F.lit("_"), F.substring(F.col("target_columns")[1], 2, 9))
    rules = found.withColumn("rule_id", name).withColumn("rule_type", F.lit(checks.DEPENDENCY)).withColumn("conditions", F.array().cast(schemas.RULES["conditions"].dataType))
    return rulegraph.implied(rules).select("table_name", "rule_id")
