"""SRC-* and FN-*."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import masking, naming, numbers
from plumbline.operators import checks
from plumbline.operators import rules as rule_ops
from plumbline.plans import flows
from plumbline.sources import labelled, tables
from queries.base import query, table


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled records; those without labels have no validity."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    fault = (
        F.when(F.col("toxic") == 1, "TOXIC_TEXT")
        .when(F.col("quality") == 0, "LOW_QUALITY")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (F.col("quality") == 1).alias("_quality_ok"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("_is_valid"),
        fault.alias("_injected_fault"),
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_table_scan(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/customer.parquet")


@query(
    """
    SELECT user_id, k, is_valid FROM (
      SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value < 100 AS is_valid
      FROM events)
    """
)
def src_json_records(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    record = F.struct(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("value") < 100).alias("_is_valid"),
    )
    texts = events.select(F.to_json(F.struct(F.array(record).alias("records"))).alias("document"))
    found = labelled.records_in(texts, "document", schemas.struct(user_id=T.LongType(), k=T.LongType()))
    return found.select("user_id", "k", F.col("_is_valid").alias("is_valid"))


@query(
    """
    SELECT n_name AS table_name, i AS expected_index,
           CASE i WHEN 0 THEN 'columnValuesToBeNotNull' ELSE 'columnValuesToBeBetween' END AS rule_type,
           CASE i WHEN 0 THEN 'c_custkey' ELSE 'c_acctbal' END AS target_column,
           CASE i WHEN 1 THEN lo END AS min_value, CASE i WHEN 1 THEN hi END AS max_value
    FROM (SELECT n_name, min(c_acctbal) AS lo, max(c_acctbal) AS hi
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
         (VALUES (CAST(0 AS INTEGER)), (CAST(1 AS INTEGER))) AS v(i)
    """
)
def src_expected_rules(spark, sf_dir):
    spread = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    )
    rule = lambda kind, column, **p: F.struct(
        F.lit(kind).alias("rule_type"),
        F.array(F.lit(column)).alias("target_columns"),
        F.struct(
            p.get("lo", F.lit(None).cast("double")).alias("minValue"),
            p.get("hi", F.lit(None).cast("double")).alias("maxValue"),
        ).alias("parameters"),
    )
    rules = F.array(
        rule(checks.NOT_NULL, "c_custkey"),
        rule(checks.BETWEEN, "c_acctbal", lo=F.col("lo"), hi=F.col("hi")),
    )
    text = F.to_json(
        F.struct(
            F.create_map(
                F.col("n_name"),
                F.struct(F.col("n_name").alias("table_name"), rules.alias("expected_rules")),
            ).alias("tables")
        )
    )
    parsed = spread.select(F.from_json(text, schemas.EXPECTED_DOCUMENT).alias("d"))
    return labelled.expected_rules(parsed, F.col("d.tables")).select(
        "table_name", "expected_index", "rule_type",
        F.element_at("target_columns", 1).alias("target_column"),
        "params.min_value", "params.max_value",
    )


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value < 100 AS is_valid FROM events")
def src_read_records(spark, sf_dir):
    """Events written as JSON documents of a thousand each and read as labelled records."""
    record = F.struct(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("value") < 100).alias("_is_valid"),
    )
    where = shared_folder(spark)
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("part"), record.alias("r"))
    events.groupBy("part").agg(F.collect_list("r").alias("records")).select("records").write.option("maxRecordsPerFile", 1).json(where)
    found = labelled.read_records(spark, where, schemas.struct(user_id=T.LongType(), k=T.LongType()))
    return found.select("user_id", "k", F.col("_is_valid").alias("is_valid"))


@query("SELECT event_id, user_id, props, value < 100 AS is_valid FROM events")
def src_read_large_records(spark, sf_dir):
    """Events written as JSON documents of a hundred thousand each, which hold braces in strings, and read in blocks."""
    record = F.struct("event_id", "user_id", "props", (F.col("value") < 100).alias("_is_valid"))
    where = shared_folder(spark)
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100_000).alias("part"), record.alias("r"))
    events.groupBy("part").agg(F.collect_list("r").alias("records")).select("records").write.option("maxRecordsPerFile", 1).json(where)
    given = schemas.struct(event_id=T.LongType(), user_id=T.LongType(), props=T.StringType())
    found = labelled.read_large_records(spark, where, given)
    return found.select("event_id", "user_id", "props", F.col("_is_valid").alias("is_valid"))


@query(
    """SELECT n_name AS table_name, CAST(0 AS INTEGER) AS expected_index, 'columnValuesToBeBetween' AS rule_type,
              'c_acctbal' AS target_column, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def src_read_expected(spark, sf_dir):
    """Expected ranges written as a JSON document with a map of tables, and read back."""
    rule = F.struct(
        F.lit(checks.BETWEEN).alias("rule_type"),
        F.array(F.lit("c_acctbal")).alias("target_columns"),
        F.struct(F.min("c_acctbal").alias("minValue"), F.max("c_acctbal").alias("maxValue")).alias("parameters"),
    )
    spread = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.array(rule).alias("expected_rules"))
    )
    spec = F.struct(F.col("n_name").alias("table_name"), "expected_rules")
    where = shared_folder(spark)
    spread.select(F.create_map("n_name", spec).alias("tables")).write.option("maxRecordsPerFile", 1).json(where)
    return labelled.read_expected(spark, where).select(
        "table_name", "expected_index", "rule_type",
        F.element_at("target_columns", 1).alias("target_column"),
        "params.min_value", "params.max_value",
    )


@query(
    """SELECT table_name, rule_id, rows, violations, CASE WHEN violations = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (
       SELECT 'orders' AS table_name, 'price' AS rule_id, count(*) AS rows, count(*) FILTER (o_totalprice > 400000) AS violations FROM orders
       UNION ALL SELECT 'orders', 'key', count(*), CAST(0 AS BIGINT) FROM orders
       UNION ALL SELECT 'lineitem', 'quantity', count(*), count(*) FILTER (l_quantity > 45) FROM lineitem)"""
)
def flow_rule_runs(spark, sf_dir):
    """Rules of several tables, each run on its own table."""
    rules = [
        {"rule_id": "price", "table_name": "orders", "rule_type": checks.BETWEEN, "target_columns": ["o_totalprice"], "params": {"max_value": 400000}},
        {"rule_id": "key", "table_name": "orders", "rule_type": checks.UNIQUE, "target_columns": ["o_orderkey"]},
        {"rule_id": "quantity", "table_name": "lineitem", "rule_type": checks.BETWEEN, "target_columns": ["l_quantity"], "params": {"max_value": 45}},
        {"rule_id": "absent", "table_name": "elsewhere", "rule_type": checks.NOT_NULL, "target_columns": ["x"]},
    ]
    chosen = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem")}
    return flows.rule_runs(chosen, rules, "run").select("table_name", "rule_id", "rows", "violations", "status")


@query(
    """
    SELECT d.doc_id, lang, source, n_chars,
           CASE WHEN COALESCE(quality = 1 AND toxic = 0, TRUE) THEN 'clean' ELSE 'defect' END AS part
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def src_labelled_split(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir).drop("text")
    clean = labelled.without_labels(labelled.clean_rows(rows)).withColumn("part", F.lit("clean"))
    defect = labelled.without_labels(labelled.defect_rows(rows)).withColumn("part", F.lit("defect"))
    return clean.unionByName(defect)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder, or else the warehouse."""
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


@query(
    """
    SELECT 'orders' AS table_name, 'price' AS rule_id, count(*) AS rows,
           count(*) FILTER (o_totalprice > 400000) AS violations FROM orders
    UNION ALL
    SELECT 'lineitem', 'quantity', count(*), count(*) FILTER (l_quantity > 45) FROM lineitem
    """
)
def src_save_results(spark, sf_dir):
    where = shared_folder(spark)
    for name, rule in {
        "orders": {"rule_id": "price", "rule_type": checks.BETWEEN, "target_columns": ["o_totalprice"], "params": {"max_value": 400000}},
        "lineitem": {"rule_id": "quantity", "rule_type": checks.BETWEEN, "target_columns": ["l_quantity"], "params": {"max_value": 45}},
    }.items():
        ran = rule_ops.run_rules(table(spark, sf_dir, name), [rule])
        tables.save_results(ran.withColumn("table_name", F.lit(name)), where)
    return spark.read.parquet(where).select(
        F.col("table_name").cast("string").alias("table_name"), "rule_id", "rows", "violations"
    )


MASKED_SQL = """
    SELECT c_custkey, left(c_name, 5) || '...' || right(c_name, 4) AS customer_id,
           '***-**-' || right(c_name, 4) AS ssn,
           left(c_name, 2) || '*****' || right(c_name, 2) AS passport,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN '*** Đường bảo mật (Masked) ***' END AS address,
           left(c_name, 2) || '*****@' || CASE WHEN c_nationkey % 2 = 0 THEN 'mail.test' ELSE '***.com' END AS email,
           CASE WHEN length(c_name || c_mktsegment) > 10
                THEN left(c_name || c_mktsegment, 5) || '...' || right(c_name || c_mktsegment, 4)
                ELSE c_name || c_mktsegment END AS id,
           c_mktsegment
    FROM customer
"""


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        name.alias("customer_id"),
        name.alias("ssn"),
        name.alias("passport"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("address"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_name", F.lit("@mail.test")))
        .otherwise(name)
        .alias("email"),
        F.concat("c_name", "c_mktsegment").alias("id"),
        "c_mktsegment",
    )


@query(MASKED_SQL)
def fn_mask(spark, sf_dir):
    return masking.mask(personal(spark, sf_dir))


@query(MASKED_SQL + " ORDER BY c_custkey DESC LIMIT 20")
def src_preview(spark, sf_dir):
    return tables.preview(personal(spark, sf_dir), 20, F.desc("c_custkey"))


@query(
    """
    SELECT user_id, count(*) AS events,
           count(*) FILTER (regexp_matches(event_type || '_email', 'ssn|drivers|passport|email|address|phone|customer_id')) AS named_pii,
           count(*) FILTER (regexp_matches(event_type, 'ssn|drivers|passport|email|address|phone|customer_id')) AS plain
    FROM events GROUP BY user_id
    """
)
def fn_pii_names(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(naming.is_pii_name(F.concat(kind, F.lit("_EMAIL")))).alias("named_pii"),
        F.count_if(naming.is_pii_name(kind)).alias("plain"),
    )


@query(
    """
    SELECT p_partkey,
           CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
                ELSE printf('%.1f', p_retailprice) END || ' - ' || CAST(p_size AS VARCHAR) AS label,
           round(p_size * 100.0 / 50, 1) AS percent
    FROM (SELECT p_partkey, p_size, round(CAST(p_retailprice AS DOUBLE), 1) AS p_retailprice FROM part)
    """
)
def fn_labels_and_percents(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numbers.range_label(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("label"),
        numbers.percent(F.col("p_size"), F.lit(50), 1).alias("percent"),
    )


@query(
    """
    SELECT event_type, count(*) AS events, count(TRY_CAST(props AS DOUBLE)) AS numeric_props,
           count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS numeric_keys,
           count(TRY_CAST(json_extract_string(props, '$.k') || event_type AS DOUBLE)) AS numeric_joined
    FROM events GROUP BY event_type
    """
)
def fn_parse_number(spark, sf_dir):
    key = F.get_json_object("props", "$.k")
    numeric = lambda c: F.count(numbers.parse_number(c, T.StringType()))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        numeric(F.col("props")).alias("numeric_props"),
        numeric(key).alias("numeric_keys"),
        numeric(F.concat(key, "event_type")).alias("numeric_joined"),
    )
