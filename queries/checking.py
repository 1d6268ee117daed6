"""CHK-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks
from plumbline.operators import rules as rule_ops
from plumbline.plans import flows
from queries.base import all_tables, query, table
from queries.predicates import LINES_SQL, ONE_PASS, lines

# Texts with blanks, white space and nulls.
TEXTS_SQL = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE lang END AS lang,
    upper(source) AS source, text, n_chars FROM documents)"""


def texts(spark, sf_dir):
    rest = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(rest == 0, "").when(rest == 1, "  ").when(rest > 2, F.col("lang")).alias("lang"),
        F.upper("source").alias("source"),
        "text",
        "n_chars",
    )


@query(f"SELECT doc_id FROM {TEXTS_SQL} WHERE lang IS NULL OR trim(lang) = ''")
def chk_not_null(spark, sf_dir):
    df = texts(spark, sf_dir)
    return df.where(checks.null_violation("lang", df.schema["lang"].dataType)).select("doc_id")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def chk_unique_values(spark, sf_dir):
    return checks.repeated_values(table(spark, sf_dir, "part"), "p_name")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
       FROM lineitem QUALIFY n > 1"""
)
def chk_unique_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return checks.repeated_rows(df, ["l_orderkey", "l_linenumber"])


@query(
    f"""SELECT doc_id FROM {TEXTS_SQL} WHERE n_chars < 100 OR n_chars > 5000
        OR TRY_CAST(substr(source, 4) AS DOUBLE) > 15"""
)
def chk_between(spark, sf_dir):
    df = texts(spark, sf_dir).withColumn("mark", F.substr("source", F.lit(4)))
    kind = lambda c: df.schema[c].dataType
    size = checks.between_violation("n_chars", kind("n_chars"), 100, 5000)
    mark = checks.between_violation("mark", kind("mark"), high=15)
    return df.where(size | mark).select("doc_id")


@query(
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate < TIMESTAMP '1993-02-01 00:00:00' OR o_orderdate > TIMESTAMP '1997-06-30 12:00:00'"""
)
def chk_between_times(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    kind = df.schema["o_orderdate"].dataType
    return df.where(checks.between_violation("o_orderdate", kind, "1993-02-01", "1997-06-30 12:00:00"))


@query(f"SELECT doc_id FROM {TEXTS_SQL} WHERE lower(source) NOT IN ('src0', 'src1', 'src2') OR lower(lang) NOT IN ('en', 'de', '')")
def chk_in_set(spark, sf_dir):
    source = checks.set_violation("source", ["src0", "SRC1", "Src2"])
    lang = checks.set_violation("lang", ["EN", "de", ""])
    return texts(spark, sf_dir).where(source | lang).select("doc_id")


@query("SELECT doc_id, length(text) AS characters FROM documents WHERE length(text) NOT BETWEEN 50 AND 4000")
def chk_length(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.where(checks.length_violation("text", 50, 4000)).select(
        "doc_id", F.length("text").cast("bigint").alias("characters")
    )


@query("SELECT count(*) AS rows, count(*) BETWEEN 1000 AND 20000 AS passed FROM orders")
def chk_row_count(spark, sf_dir):
    return checks.row_count_between(table(spark, sf_dir, "orders"), 1000, 20000)


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https://[a-z.]+/(en|de|fr|es)/[0-9]+')")
def chk_regex(spark, sf_dir):
    bad = checks.pattern_violation("url", "^https://[a-z.]+/(en|de|fr|es)/[0-9]+")
    return table(spark, sf_dir, "pages").where(bad).select("page_id", "url")


@query(f"SELECT l_orderkey, l_linenumber, discount, tax FROM {LINES_SQL} WHERE NOT (tax IS NULL OR tax + discount < 0.1)")
def chk_custom_sql(spark, sf_dir):
    bad = checks.expression_violation("tax IS NULL OR tax + discount < 0.1")
    return lines(spark, sf_dir).where(bad).select("l_orderkey", "l_linenumber", "discount", "tax")


ROW_RULES = [r for r in ONE_PASS if rule_ops.is_row_rule(r)]
FAILED_SQL = f"""(SELECT *, concat_ws(',',
    CASE WHEN discount > tax OR tax >= quantity THEN 'chain' END,
    CASE WHEN flag IN ('R', 'N') AND quantity > 20 AND (status <> 'F' OR tax IS NULL) THEN 'dependency' END,
    CASE WHEN flag IS NULL THEN 'present' END,
    CASE WHEN quantity NOT BETWEEN 2 AND 49 THEN 'range' END,
    CASE WHEN flag <> 'R' THEN 'set' END,
    CASE WHEN length(status) < 2 THEN 'length' END,
    CASE WHEN status NOT BETWEEN 'F' AND 'N' THEN 'pattern' END,
    CASE WHEN NOT (tax IS NULL OR tax + discount < 0.1) THEN 'free' END) AS failed FROM {LINES_SQL})"""


@query(f"SELECT l_orderkey, l_linenumber, price, failed FROM {FAILED_SQL}")
def chk_failing_rules(spark, sf_dir):
    return rule_ops.failing_rules(lines(spark, sf_dir), ROW_RULES).select(
        "l_orderkey", "l_linenumber", "price", F.array_join("failed", ",").alias("failed")
    )


@query(
    f"""SELECT flag, count(*) AS rows, count(*) FILTER (failed = 'length' OR failed = '') AS clean
        FROM {FAILED_SQL} GROUP BY flag"""
)
def chk_clean_rows(spark, sf_dir):
    rules = [r for r in ROW_RULES if r["rule_id"] != "length"]
    return (
        rule_ops.failing_rules(lines(spark, sf_dir), rules)
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(rule_ops.is_clean()).alias("clean"))
    )


@query(
    """SELECT user_id, day, count(*) AS n, CASE WHEN user_id IS NULL OR day IS NULL THEN 'NULL' ELSE 'DUPLICATE' END AS problem
       FROM (SELECT NULLIF(user_id, 3) AS user_id, NULLIF(dayofmonth(ts), 7) AS day FROM events)
       GROUP BY user_id, day HAVING user_id IS NULL OR day IS NULL OR count(*) > 1"""
)
def chk_primary_key(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.nullif("user_id", F.lit(3)).alias("user_id"),
        F.nullif(F.dayofmonth("ts"), F.lit(7)).cast("bigint").alias("day"),
    )
    return checks.primary_key(df, ["user_id", "day"])


@query(
    """SELECT l_partkey, l_suppkey, count(*) AS n FROM (SELECT l_partkey, NULLIF(l_suppkey, 5) AS l_suppkey FROM lineitem)
       WHERE l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey HAVING count(*) > 1"""
)
def chk_unique_key(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.nullif("l_suppkey", F.lit(5)).alias("l_suppkey")
    )
    return checks.unique_key(df, ["l_partkey", "l_suppkey"])


@query(
    """SELECT l_partkey, count(*) AS n FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY l_partkey"""
)
def chk_foreign_key(spark, sf_dir):
    parents = table(spark, sf_dir, "part").where("p_size > 10")
    return checks.orphan_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], parents, ["p_partkey"])


@query(
    """SELECT doc_id, lang, source FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
)
def chk_foreign_key_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return checks.orphan_rows(docs, ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 = l_linenumber)
       GROUP BY l_orderkey, l_linenumber"""
)
def chk_foreign_key_composite(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 7).cast("int").alias("rest")
    )
    return checks.orphan_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], parents, ["o_orderkey", "rest"]
    )


@query(
    """SELECT p_size, count(DISTINCT p_type) AS n_values, count(*) AS n FROM part
       GROUP BY p_size HAVING count(DISTINCT p_type) > 1"""
)
def chk_dependency(spark, sf_dir):
    return checks.dependency_breaks(table(spark, sf_dir, "part"), ["p_size"], "p_type")


@query(
    """SELECT p_partkey, p_size, p_type FROM part
       WHERE p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING count(DISTINCT p_type) > 1)"""
)
def chk_dependency_rows(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return checks.dependency_break_rows(df, ["p_size"], "p_type").drop("n_values")


CONSTRAINTS = [
    ("pk_orders", "PRIMARY_KEY", "orders", ["o_orderkey"], None, None),
    ("pk_lineitem", "PRIMARY_KEY", "lineitem", ["l_orderkey", "l_linenumber"], None, None),
    ("pk_part", "PRIMARY_KEY", "part", ["p_partkey"], None, None),
    ("pk_events", "PRIMARY_KEY", "events", ["event_id"], None, None),
    ("uq_part_name", "UNIQUE", "part", ["p_name"], None, None),
    ("uq_turn", "UNIQUE", "conversations", ["conv_id", "turn"], None, None),
    ("fk_order_customer", "FOREIGN_KEY", "orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("fk_line_order", "FOREIGN_KEY", "lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("fk_customer_nation", "FOREIGN_KEY", "customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("fk_nation_region", "FOREIGN_KEY", "nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("fk_document_label", "FOREIGN_KEY", "documents", ["doc_id"], "labels", ["doc_id"]),
    ("fk_user_customer", "FOREIGN_KEY", "events", ["user_id"], "supplier", ["s_suppkey"]),
]


def constraints_sql() -> str:
    parts = []
    for name, kind, t, columns, ref, ref_columns in CONSTRAINTS:
        keys = ", ".join(columns)
        if kind == "FOREIGN_KEY":
            meets = " AND ".join(f"r.{b} = t.{a}" for a, b in zip(columns, ref_columns))
            inner = f"SELECT {keys}, count(*) AS n FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM {ref} r WHERE {meets}) GROUP BY {keys}"
        else:
            inner = f"SELECT {keys}, count(*) AS n FROM {t} GROUP BY {keys} HAVING count(*) > 1"
        parts.append(
            f"""SELECT '{name}' AS constraint_name, '{kind}' AS constraint_type, '{t}' AS table_name, '{",".join(columns)}' AS columns,
                count(*) AS broken_keys, CAST(COALESCE(sum(n), 0) AS BIGINT) AS broken_rows, count(*) = 0 AS passed FROM ({inner})"""
        )
    return " UNION ALL ".join(parts)


def constraints(spark):
    names = [f.name for f in schemas.CONSTRAINTS.fields]
    return local_frame(spark, [dict(zip(names, c)) for c in CONSTRAINTS], schemas.CONSTRAINTS)


@query(constraints_sql())
def chk_constraints(spark, sf_dir):
    return flows.check_constraints(all_tables(spark, sf_dir), constraints(spark))


@query(
    """SELECT column_name, is_primary_key, is_foreign_key, nullable, row_count FROM (VALUES
         ('o_orderkey', TRUE, FALSE, FALSE), ('o_custkey', FALSE, TRUE, TRUE), ('o_orderstatus', FALSE, FALSE, TRUE),
         ('o_totalprice', FALSE, FALSE, TRUE), ('o_orderdate', FALSE, FALSE, TRUE), ('o_orderpriority', FALSE, FALSE, TRUE))
         AS v(column_name, is_primary_key, is_foreign_key, nullable), (SELECT count(*) AS row_count FROM orders)"""
)
def profile_with_constraints(spark, sf_dir):
    orders = {"orders": table(spark, sf_dir, "orders")}
    return flows.profile_with_constraints(orders, constraints(spark), approx=True).select(
        "column_name", "is_primary_key", "is_foreign_key", "nullable", "row_count"
    )
