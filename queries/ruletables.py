"""RT-*, on rules derived from customers and reviews derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import checks, profile, recommend, ruletable
from plumbline.plans import flows
from queries.base import TABLES, query, table

RULES_SQL = f"""(SELECT *, CASE type WHEN 'a' THEN '{checks.BETWEEN}' WHEN 'b' THEN '{checks.LENGTH}' ELSE '{checks.IN_SET}' END AS rule_type FROM (
    SELECT c_custkey AS k, 'r' || c_custkey AS rule_id, 'nation_' || c_nationkey AS table_name,
      CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS type,
      CASE WHEN c_custkey % 2 = 0 THEN 'x,' ELSE '' END || lower(c_mktsegment) AS columns,
      CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS min_value, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 2000 END AS max_value,
      CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 7 END AS min_length, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 7 + c_custkey % 4 END AS max_length,
      CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS allowed,
      CASE WHEN c_custkey % 4 = 0 THEN 'left' || c_custkey % 5 ELSE '' END AS conds,
      (c_custkey % 100) / 100 AS confidence,
      CASE WHEN c_custkey % 4 = 0 THEN 'ADVANCED' ELSE 'BASIC' END AS engine,
      CASE c_custkey % 5 WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'EDITED' WHEN 3 THEN 'REJECTED' ELSE 'DRAFT' END AS status,
      CASE WHEN c_custkey % 6 = 0 THEN 'WARNING' ELSE 'VALID' END AS validation_status
    FROM customer))"""


def derived_rules(spark, sf_dir) -> DataFrame:
    """One rule per customer, in the rules schema; ``k`` is the customer key."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    kind = k % 3
    struct = lambda schema, **given: F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    params = struct(
        schemas.PARAMS,
        min_value=F.when(kind == 0, F.col("c_acctbal")),
        max_value=F.when(kind == 0, F.col("c_acctbal") + 2000),
        min_length=F.when(kind == 1, k % 7),
        max_length=F.when(kind == 1, k % 7 + k % 4),
        allowed_values=F.when(kind == 2, F.array(seg)),
    )
    cond = struct(
        schemas.CONDITION,
        type=F.lit("NULL_CHECK"),
        column=F.concat(F.lit("left"), (k % 5).cast("string")),
        operator=F.lit("IS_NULL"),
    )
    given = {
        "rule_id": F.concat(F.lit("r"), k.cast("string")),
        "table_name": F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")),
        "rule_type": F.when(kind == 0, checks.BETWEEN).when(kind == 1, checks.LENGTH).otherwise(checks.IN_SET),
        "engine": F.when(k % 4 == 0, "ADVANCED").otherwise("BASIC"),
        "target_columns": F.when(k % 2 == 0, F.array(F.lit("x"), F.lower(seg))).otherwise(F.array(F.lower(seg))),
        "params": params,
        "conditions": F.when(k % 4 == 0, F.array(cond)).otherwise(F.array().cast(schemas.RULES["conditions"].dataType)),
        "confidence": (k % 100) / 100,
        "status": F.when(k % 5 == 1, "ACCEPTED").when(k % 5 == 2, "EDITED").when(k % 5 == 3, "REJECTED").otherwise("DRAFT"),
        "validation_status": F.when(k % 6 == 0, "WARNING").otherwise("VALID"),
    }
    return table(spark, sf_dir, "customer").select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RULES.fields],
        k.alias("k"),
    )


COLUMNS_SQL = """(SELECT DISTINCT 'nation_' || c_nationkey AS table_name, lower(c_mktsegment) AS column_name,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INTEGER' WHEN c_mktsegment = 'FURNITURE' THEN 'DATETIME' ELSE 'STRING' END AS type_class
    FROM customer)"""


def known_columns(spark, sf_dir) -> DataFrame:
    """Profiled columns of the nations' tables; column x is not among them."""
    seg = F.col("c_mktsegment")
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table_name"),
            F.lower(seg).alias("column_name"),
            F.when(seg.isin("BUILDING", "MACHINERY"), "INTEGER").when(seg == "FURNITURE", "DATETIME").otherwise("STRING").alias("type_class"),
            F.lit(False).alias("is_primary_key"),
        )
        .distinct()
    )


@query(
    f"""SELECT table_name, rule_type, count(*) AS n FROM (
          SELECT table_name, rule_type FROM {RULES_SQL}
          UNION ALL SELECT 'supplier', '{checks.NOT_NULL}' FROM range(4)
          UNION ALL SELECT 'supplier', '{checks.BETWEEN}' FROM range(3)
          UNION ALL SELECT 'supplier', '{checks.LENGTH}') GROUP BY ALL"""
)
def rt_union(spark, sf_dir):
    profiled = profile.profile(table(spark, sf_dir, "supplier"), "supplier", approx=True)
    own = [r(profiled) for r in (recommend.not_null, recommend.between, recommend.length)]
    rules = ruletable.union_rules(derived_rules(spark, sf_dir), *own)
    return rules.groupBy("table_name", "rule_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rule_id, confidence FROM {RULES_SQL} WHERE confidence >= 0.75")
def rt_confident(spark, sf_dir):
    return ruletable.confident(derived_rules(spark, sf_dir)).select("rule_id", "confidence")


@query(
    f"""SELECT table_name, CASE WHEN confidence >= 0.8 THEN 'SHOW' WHEN confidence >= 0.6 THEN 'LOW' ELSE 'HIDE' END AS band,
        count(*) AS n FROM {RULES_SQL} GROUP BY ALL"""
)
def rt_confidence_band(spark, sf_dir):
    band = ruletable.confidence_band(F.col("confidence")).alias("band")
    return derived_rules(spark, sf_dir).groupBy("table_name", band).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rule_id, confidence FROM {RULES_SQL}")
def rt_by_confidence(spark, sf_dir):
    return ruletable.by_confidence(derived_rules(spark, sf_dir), "rule_id").select("rule_id", "confidence")


@query(
    f"""SELECT rule_id, table_name FROM {RULES_SQL}
        QUALIFY row_number() OVER (PARTITION BY table_name, rule_type, columns ORDER BY confidence DESC, k) = 1"""
)
def rt_dedupe_groups(spark, sf_dir):
    return ruletable.dedupe_groups(derived_rules(spark, sf_dir), F.desc("confidence"), F.asc("k")).select("rule_id", "table_name")


@query(
    f"""SELECT rule_id, table_name FROM {RULES_SQL}
        QUALIFY row_number() OVER (PARTITION BY table_name, rule_type, columns, conds ORDER BY k) = 1"""
)
def rt_dedupe_rules(spark, sf_dir):
    return ruletable.dedupe_rules(derived_rules(spark, sf_dir), F.asc("k")).select("rule_id", "table_name")


@query(
    f"""SELECT rule_type, columns, COALESCE(allowed, '') AS allowed, min_value, max_value, min_length, max_length, count(*) AS n
        FROM {RULES_SQL} GROUP BY ALL"""
)
def rt_canonical_key(spark, sf_dir):
    """Rules with the same canonical key, counted: the key tells apart what the parts do."""
    key = ruletable.canonical_key(F.col("rule_type"), F.reverse("target_columns"), F.col("params"))
    return (
        derived_rules(spark, sf_dir)
        .groupBy(key.alias("key"))
        .agg(
            F.min("rule_type").alias("rule_type"),
            F.min(F.array_join("target_columns", ",")).alias("columns"),
            F.min(F.coalesce(F.array_join("params.allowed_values", ","), F.lit(""))).alias("allowed"),
            F.min("params.min_value").alias("min_value"),
            F.min("params.max_value").alias("max_value"),
            F.min("params.min_length").cast("bigint").alias("min_length"),
            F.min("params.max_length").cast("bigint").alias("max_length"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("key")
    )


USED_SQL = f"(SELECT rule_id, rule_type, table_name, unnest(string_split(columns, ',')) AS c FROM {RULES_SQL})"


@query(
    f"""SELECT rule_id, string_agg('Unknown target column: ' || c, '; ' ORDER BY c) AS messages FROM {USED_SQL} u
        WHERE NOT EXISTS (SELECT 1 FROM {COLUMNS_SQL} k WHERE k.table_name = u.table_name AND k.column_name = u.c) GROUP BY rule_id"""
)
def rt_schema_messages(spark, sf_dir):
    found = ruletable.schema_messages(derived_rules(spark, sf_dir), known_columns(spark, sf_dir))
    return found.select("rule_id", F.array_join("messages", "; ").alias("messages"))


TYPE_SQL = f"""SELECT rule_id, CASE WHEN rule_type = '{checks.BETWEEN}' AND type_class = 'STRING' THEN 'Column ' || c || ' must be a number or a time'
    WHEN rule_type = '{checks.LENGTH}' AND type_class <> 'STRING' THEN 'Column ' || c || ' must be text' END AS message
    FROM {USED_SQL} u JOIN {COLUMNS_SQL} k ON k.table_name = u.table_name AND k.column_name = u.c"""


@query(f"SELECT rule_id, string_agg(message, '; ' ORDER BY message) AS messages FROM ({TYPE_SQL}) WHERE message IS NOT NULL GROUP BY rule_id")
def rt_type_messages(spark, sf_dir):
    found = ruletable.type_messages(derived_rules(spark, sf_dir), known_columns(spark, sf_dir))
    return found.select("rule_id", F.array_join("messages", "; ").alias("messages"))


CONFLICT_SQL = f"""SELECT DISTINCT a.rule_id FROM {RULES_SQL} a JOIN {RULES_SQL} b
    ON a.table_name = b.table_name AND a.rule_type = b.rule_type AND a.columns = b.columns
    WHERE a.max_value < b.min_value OR a.min_value > b.max_value OR a.max_length < b.min_length OR a.min_length > b.max_length"""


@query(CONFLICT_SQL)
def rt_conflicts(spark, sf_dir):
    return ruletable.conflicts(derived_rules(spark, sf_dir)).select("rule_id")


@query(
    f"""SELECT r.rule_id, CASE WHEN b.rule_id IS NOT NULL THEN 'INVALID' WHEN c.rule_id IS NOT NULL THEN 'WARNING' ELSE r.validation_status END AS validation_status
        FROM {RULES_SQL} r
        LEFT JOIN (SELECT DISTINCT rule_id FROM {USED_SQL} u WHERE NOT EXISTS (SELECT 1 FROM {COLUMNS_SQL} k WHERE k.table_name = u.table_name AND k.column_name = u.c)
              UNION SELECT DISTINCT rule_id FROM ({TYPE_SQL}) WHERE message IS NOT NULL) b ON b.rule_id = r.rule_id
        LEFT JOIN ({CONFLICT_SQL}) c ON c.rule_id = r.rule_id"""
)
def rt_validate(spark, sf_dir):
    found = ruletable.validate(derived_rules(spark, sf_dir), known_columns(spark, sf_dir))
    return found.select("rule_id", "validation_status")


PUBLISHED_SQL = f"(SELECT * FROM {RULES_SQL} WHERE status IN ('ACCEPTED', 'EDITED'))"


@query(
    f"""SELECT n.rule_id, CASE WHEN EXISTS (SELECT 1 FROM {PUBLISHED_SQL} o WHERE o.table_name = n.table_name AND o.rule_type = n.rule_type
              AND o.columns = n.columns AND o.conds = n.conds AND o.min_value IS NOT DISTINCT FROM n.min_value AND o.min_length IS NOT DISTINCT FROM n.min_length
              AND o.max_length IS NOT DISTINCT FROM n.max_length AND o.allowed IS NOT DISTINCT FROM n.allowed) THEN 'DUPLICATE'
            WHEN EXISTS (SELECT 1 FROM {PUBLISHED_SQL} o WHERE o.table_name = n.table_name AND o.rule_type = n.rule_type AND o.columns = n.columns)
            THEN 'POSSIBLE_CONFLICT' ELSE 'NEW' END AS classification FROM {RULES_SQL} n"""
)
def rt_classify(spark, sf_dir):
    """All rules against the published ones."""
    rules = derived_rules(spark, sf_dir)
    return ruletable.classify(rules, ruletable.publishable(rules)).select("rule_id", "classification")


REVIEWS_SQL = """(SELECT 'r' || user_id AS rule_id, ts, CASE event_type WHEN 'purchase' THEN 'EDITED' WHEN 'error' THEN 'REJECTED' ELSE 'ACCEPTED' END AS action,
    CASE WHEN event_type = 'purchase' AND value > 30 THEN value END AS edit FROM events)"""
REVIEWED_SQL = f"""(SELECT r.rule_id, r.engine, COALESCE(v.action, r.status) AS status, r.min_value, e.edit
    FROM {RULES_SQL} r
    LEFT JOIN (SELECT rule_id, arg_max(action, ts) AS action FROM {REVIEWS_SQL} GROUP BY rule_id) v ON v.rule_id = r.rule_id
    LEFT JOIN (SELECT rule_id, arg_max(edit, ts) AS edit FROM {REVIEWS_SQL} WHERE edit IS NOT NULL GROUP BY rule_id) e ON e.rule_id = r.rule_id)"""


def reviews(spark, sf_dir) -> DataFrame:
    """Events as reviews: the user is the rule, the event the action."""
    kind, value = F.col("event_type"), F.col("value")
    params = F.struct(
        *[
            (value if f.name == "min_value" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.PARAMS.fields
        ]
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("rule_id"),
        F.when(kind == "purchase", "EDITED").when(kind == "error", "REJECTED").otherwise("ACCEPTED").alias("action"),
        F.when((kind == "purchase") & (value > 30), params).alias("edited_params"),
        F.lit(None).cast("string").alias("comment"),
        F.col("ts").alias("reviewed_at"),
    )


@query(f"SELECT rule_id, status, edit AS edited_min FROM {REVIEWED_SQL}")
def rt_apply_reviews(spark, sf_dir):
    found = ruletable.apply_reviews(derived_rules(spark, sf_dir), reviews(spark, sf_dir))
    return found.select("rule_id", "status", F.col("edited_params.min_value").alias("edited_min"))


@query(
    f"""SELECT rule_id, status, CASE WHEN edit IS NOT NULL THEN edit ELSE min_value END AS min_value
        FROM {REVIEWED_SQL} WHERE status IN ('ACCEPTED', 'EDITED')"""
)
def rt_publish(spark, sf_dir):
    found = flows.publish(derived_rules(spark, sf_dir), reviews(spark, sf_dir))
    return found.select("rule_id", "status", "params.min_value")


@query(
    f"""SELECT rule_id, status FROM {RULES_SQL} WHERE status IN ('ACCEPTED', 'EDITED')
        AND rule_id IN (SELECT 'r' || user_id FROM events WHERE value > 100)"""
)
def rt_publishable_of_list(spark, sf_dir):
    ids = (
        table(spark, sf_dir, "events")
        .where("value > 100")
        .select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("rule_id"))
        .distinct()
    )
    return ruletable.publishable(derived_rules(spark, sf_dir), ids).select("rule_id", "status")


@query(
    f"""SELECT count(*) AS all_rules, count(*) FILTER (engine = 'BASIC') AS basic, count(*) FILTER (engine = 'ADVANCED') AS advanced,
        count(*) FILTER (validation_status = 'WARNING') AS warning, count(*) FILTER (status IN ('ACCEPTED', 'EDITED')) AS accepted,
        count(*) FILTER (status <> 'DRAFT') AS reviewed, count(*) FILTER (status <> 'DRAFT') * 100.0::DOUBLE / count(*) AS percent_reviewed FROM {RULES_SQL}"""
)
def rt_board_counts(spark, sf_dir):
    return ruletable.board_counts(derived_rules(spark, sf_dir))


@query(
    f"""SELECT COALESCE(k.table_name, t.table_name) AS table_name, COALESCE(k.column_name, t.c) AS column_name, COALESCE(total, 0) AS total_rules,
          COALESCE(reviewed, 0) AS reviewed, COALESCE(accepted, 0) AS accepted, COALESCE(rejected, 0) AS rejected,
          COALESCE(warn, FALSE) AS has_warning, COALESCE(adv, FALSE) AS has_advanced, COALESCE(types, '') AS rule_types
        FROM {COLUMNS_SQL} k FULL JOIN (
          SELECT u.table_name, u.c, count(*) AS total, count(*) FILTER (status <> 'DRAFT') AS reviewed,
            count(*) FILTER (status IN ('ACCEPTED', 'EDITED')) AS accepted, count(*) FILTER (status = 'REJECTED') AS rejected,
            bool_or(validation_status = 'WARNING') AS warn, bool_or(engine = 'ADVANCED') AS adv, string_agg(DISTINCT u.rule_type, ',' ORDER BY u.rule_type) AS types
          FROM (SELECT *, unnest(CASE WHEN k % 11 = 0 THEN ['__TABLE_LEVEL__'] ELSE string_split(columns, ',') END) AS c FROM {RULES_SQL}) u GROUP BY ALL) t
        ON k.table_name = t.table_name AND k.column_name = t.c"""
)
def rt_column_board(spark, sf_dir):
    rules = derived_rules(spark, sf_dir).withColumn(
        "target_columns", F.when(F.col("k") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("target_columns"))
    )
    return (
        ruletable.column_board(rules, known_columns(spark, sf_dir))
        .drop("is_primary_key")
        .withColumn("rule_types", F.array_join("rule_types", ","))
    )
