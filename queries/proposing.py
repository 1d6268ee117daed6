"""REC-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import naming
from plumbline.local import on_driver
from plumbline.operators import affine, checks, mine, profile, recommend
from plumbline.plans import flows
from queries.base import TABLES, all_tables, query, table
from queries.predicates import LINES_SQL, SHIPPED_SQL, lines, shipped
from queries.profiles import HISTOGRAM_COLUMNS, histogram_sql, profile_sql

KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "documents": ["doc_id"], "part": ["p_partkey"]}


def rules_sql(tables: dict, source: dict | None = None, keys: dict | None = None) -> str:
    """The basic rules, from the profile of the same tables in SQL."""
    has = lambda words: f"regexp_matches(low, '{'|'.join(words)}')"
    inside = lambda names: "low IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    key_list = ", ".join(f"'{t}.{c}'" for t, cs in (keys or {}).items() for c in cs) or "''"
    tops = []
    for t, columns in tables.items():
        frm = (source or {}).get(t, t)
        for c, kind in columns.items():
            if kind == "text":
                tops.append(
                    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS v, count(*) AS n,
                    (SELECT count(DISTINCT {c}) FROM {frm} WHERE {c} <> '') AS d FROM {frm} WHERE {c} <> '' GROUP BY {c}"""
                )
    return f"""
    WITH prof AS (
      SELECT *, lower(column_name) AS low, table_name || '.' || column_name IN ({key_list}) AS pk,
             type_class IN ('DATE', 'DATETIME') OR regexp_matches(lower(column_name), '{'|'.join(naming.TEMPORAL_NAME_WORDS)}') AS temporal,
             type_class IN ('INTEGER', 'NUMBER') AS numeric
      FROM ({profile_sql(tables, source)})),
    tops AS (
      SELECT table_name, column_name, string_agg(v, '|' ORDER BY n DESC, v) AS allowed
      FROM ({' UNION ALL '.join(tops)}) WHERE d <= 20 GROUP BY table_name, column_name)
    SELECT table_name, column_name, '{checks.NOT_NULL}' AS rule_type,
           CASE WHEN pk THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value,
           NULL::INTEGER AS min_length, NULL::INTEGER AS max_length, NULL::VARCHAR AS allowed
    FROM prof WHERE row_count > 0 AND null_count = 0
    UNION ALL
    SELECT table_name, column_name, '{checks.UNIQUE}', CASE WHEN pk THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END, NULL, NULL, NULL, NULL, NULL
    FROM prof WHERE row_count > 0 AND NOT temporal AND (pk OR NOT (numeric OR {has(naming.UNIQUE_METRIC_WORDS)}))
      AND NOT {has(naming.PERSON_NAME_WORDS)}
      AND (pk OR low = 'id' OR low LIKE '%\\_id' ESCAPE '\\' OR low LIKE 'id\\_%' ESCAPE '\\' OR (low LIKE '%id' AND length(low) <= 10)
           OR {has(naming.IDENTIFIER_WORDS)})
      AND (pk OR distinct_count / row_count >= 0.99)
    UNION ALL
    SELECT table_name, column_name, '{checks.BETWEEN}', 0.9::DOUBLE, min_num, max_num, NULL, NULL, NULL
    FROM prof WHERE min_num IS NOT NULL AND numeric AND NOT temporal
    UNION ALL
    SELECT p.table_name, p.column_name, '{checks.IN_SET}', 0.95::DOUBLE, NULL, NULL, NULL, NULL, allowed
    FROM prof p JOIN tops t ON p.table_name = t.table_name AND p.column_name = t.column_name
    WHERE distinct_count BETWEEN 1 AND 20 AND NOT temporal AND NOT pk
      AND NOT (min_length = 36 AND max_length = 36) AND NOT low LIKE '%\\_id' ESCAPE '\\'
      AND NOT {inside(naming.SET_KEY_NAMES)} AND NOT {has(naming.SET_KEY_WORDS)} AND NOT {has(naming.SET_PLACE_WORDS)}
      AND NOT ({inside(naming.SET_TEXT_NAMES)} OR low LIKE '%\\_code' ESCAPE '\\' OR {has(naming.SET_TEXT_WORDS)})
      AND NOT ({has(naming.SET_METRIC_WORDS)} OR numeric)
    UNION ALL
    SELECT table_name, column_name, '{checks.LENGTH}', 0.9::DOUBLE, NULL, NULL, min_length, max_length, NULL
    FROM prof WHERE type_class = 'STRING' AND min_length IS NOT NULL"""


def flat(rules):
    return rules.select(
        "table_name",
        F.element_at("target_columns", 1).alias("column_name"),
        "rule_type",
        "confidence",
        "params.min_value",
        "params.max_value",
        "params.min_length",
        "params.max_length",
        F.array_join("params.allowed_values", "|").alias("allowed"),
    )


@query(rules_sql(TABLES, keys=KEYS))
def recommend_basic(spark, sf_dir):
    return flat(recommend.recommend(profile.profile_tables(all_tables(spark, sf_dir), KEYS)))


PEOPLE_SQL = """(SELECT c_name AS email, c_mktsegment AS passport, c_mktsegment AS birthplace, c_mktsegment AS patient,
    c_mktsegment AS note, c_mktsegment AS city, c_mktsegment AS status, left(c_name || repeat('x', 40), 36) AS reference,
    CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS grade, c_name AS serial_no, c_name AS nickname,
    c_name AS dosage_key, c_mktsegment AS claim_code, c_mktsegment AS plate, c_mktsegment AS last_name,
    repeat(c_mktsegment, 12) AS remark, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS token,
    c_acctbal AS total_cost, c_acctbal AS updated_at FROM customer)"""
PEOPLE = {
    "people": {
        c: "number" if c in ("total_cost", "updated_at") else "text"
        for c in (
            "email", "passport", "birthplace", "patient", "note", "city", "status", "reference", "grade",
            "serial_no", "nickname", "dosage_key", "claim_code", "plate", "last_name", "remark", "token",
            "total_cost", "updated_at",
        )
    }
}


@query(rules_sql(PEOPLE, {"people": PEOPLE_SQL}))
def recommend_name_guards(spark, sf_dir):
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    values = {
        "email": name, "serial_no": name, "nickname": name, "dosage_key": name,
        "reference": F.left(F.concat(name, F.lit("x" * 40)), F.lit(36)),
        "grade": F.when(nation != 3, segment),
        "remark": F.repeat(segment, 12),
        "token": F.when(nation >= 5, name),
        "total_cost": F.col("c_acctbal"), "updated_at": F.col("c_acctbal"),
    }
    people = table(spark, sf_dir, "customer").select(
        *[values.get(c, segment).alias(c) for c in PEOPLE["people"]]
    )
    return flat(recommend.recommend(profile.profile(people, "people")))


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, greatest(1, floor(count(*) * 0.8::DOUBLE)) AS min_value,
            floor(count(*) * 1.5::DOUBLE) AS max_value, 0.85::DOUBLE AS confidence FROM {t}"""
        for t in ("orders", "lineitem", "customer")
    )
)
def recommend_row_count(spark, sf_dir):
    chosen = {t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer")}
    return recommend.row_count(profile.profile_tables(chosen, approx=True)).select(
        "table_name", "params.min_value", "params.max_value", "confidence"
    )


@query(
    f"""SELECT 'lineitem' AS table_name, column_name, bin, count FROM ({histogram_sql('lineitem', HISTOGRAM_COLUMNS)})
        UNION ALL SELECT 'returns', column_name, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT) FROM
        (VALUES {', '.join(f"('{c}')" for c in HISTOGRAM_COLUMNS)}) AS v(column_name)"""
)
def recommend_with_histograms(spark, sf_dir):
    """Two tables with the same columns, of which one has histograms."""
    lines = table(spark, sf_dir, "lineitem")
    both = {"lineitem": lines, "returns": lines.where("l_returnflag = 'R'")}
    rules = recommend.between(profile.profile_tables(both, approx=True))
    bins = profile.histogram(lines).withColumn("table_name", F.lit("lineitem"))
    found = recommend.with_histograms(rules, bins)
    bins = F.from_json(F.col("evidence")["distribution"], "array<struct<label:string,count:bigint,percentage:double>>")
    return found.select(
        "table_name", F.element_at("target_columns", 1).alias("column_name"), F.posexplode_outer(bins).alias("bin", "b")
    ).select("table_name", "column_name", "bin", F.col("b.count").alias("count"))


@query(
    f"""
    WITH p AS (SELECT event_type AS t, count(*) AS n, count(DISTINCT props) AS d, min(value) AS lo, max(value) AS hi,
                      min(length(props)) AS l0, max(length(props)) AS l1 FROM events GROUP BY event_type)
    SELECT t AS table_name, c AS column_name, '{checks.NOT_NULL}' AS rule_type, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value,
           NULL::INTEGER AS min_length, NULL::INTEGER AS max_length FROM p, (VALUES ('value'), ('token')) AS v(c)
    UNION ALL SELECT t, 'token', '{checks.UNIQUE}', NULL, NULL, NULL, NULL FROM p WHERE d / n >= 0.99
    UNION ALL SELECT t, 'value', '{checks.BETWEEN}', lo, hi, NULL, NULL FROM p
    UNION ALL SELECT t, 'token', '{checks.LENGTH}', NULL, NULL, CAST(l0 AS INTEGER), CAST(l1 AS INTEGER) FROM p
    """
)
def recommend_from_supplied_profile(spark, sf_dir):
    """Rules from profiles measured elsewhere: here two columns per event type and one unmeasured."""
    rows = F.count(F.lit(1)).alias("row_count")
    nothing = F.lit(0).cast("bigint").alias("null_count")
    events = table(spark, sf_dir, "events")
    name = F.col("event_type").alias("table_name")
    value = events.groupBy(name).agg(
        F.lit("value").alias("column_name"), F.lit("DOUBLE PRECISION").alias("data_type"), rows, nothing,
        F.min("value").alias("min_num"), F.max("value").alias("max_num"),
    )
    token = events.groupBy(name).agg(
        F.lit("token").alias("column_name"), F.lit("VARCHAR(9)").alias("data_type"), rows, nothing,
        F.count_distinct("props").alias("distinct_count"),
        F.min(F.length("props")).alias("min_length"), F.max(F.length("props")).alias("max_length"),
    )
    unmeasured = events.select(name).distinct().select(
        "table_name", F.lit("ghost").alias("column_name"), F.lit("text").alias("data_type")
    )
    given = value.unionByName(token, allowMissingColumns=True).unionByName(unmeasured, allowMissingColumns=True)
    return flat(recommend.recommend(on_driver(profile.supplied(given)))).drop("confidence", "allowed")


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, 0.0::DOUBLE AS min_value, 0.8::DOUBLE AS confidence FROM {t} HAVING min({c}) >= 0"
        for t in ("lineitem", "part", "customer")
        for c, kind in TABLES[t].items()
        if kind in ("int", "number")
    )
)
def recommend_custom(spark, sf_dir):
    """A recommender of one's own beside the basic ones: columns that were never negative."""

    def never_negative(profiled):
        return recommend.as_rules(
            profiled.where("min_num >= 0"), checks.BETWEEN, F.array("column_name"), F.lit(0.8), F.lit("never negative"),
            params_=recommend.params(min_value=F.lit(0.0)),
        )

    chosen = {t: table(spark, sf_dir, t) for t in ("lineitem", "part", "customer")}
    profiled = profile.profile_tables(chosen, approx=True)
    rules = recommend.recommend(profiled, (*recommend.BASIC, never_negative)).where("reason = 'never negative'")
    return rules.select("table_name", F.element_at("target_columns", 1).alias("column_name"), "params.min_value", "confidence")


OWN = {t: TABLES[t] for t in ("orders", "customer")}


@query(
    f"""
    SELECT r.table_name, column_name AS columns, rule_type, rows, rows AS applicable,
           CAST(0 AS BIGINT) AS violations, 1.0::DOUBLE AS pass_rate, 'PASSED' AS status
    FROM ({rules_sql(OWN, keys=KEYS)}) r
    JOIN (SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer) c
      ON r.table_name = c.table_name
    """
)
def check_own_rules(spark, sf_dir):
    """Rules a table suggests hold on the table itself."""
    orders, customer = (
        flows.check_own_rules(table(spark, sf_dir, t), t, primary_keys=KEYS[t])
        for t in ("orders", "customer")
    )
    return orders.unionByName(customer).drop("rule_id", "message")


@query(
    f"""
    SELECT column_name AS columns, rule_type, count(*) AS rows,
      count(*) FILTER (CASE rule_type
        WHEN '{checks.BETWEEN}' THEN CASE column_name
          WHEN 'o_totalprice' THEN o_totalprice NOT BETWEEN r.min_value AND r.max_value
          WHEN 'o_custkey' THEN o_custkey NOT BETWEEN r.min_value AND r.max_value
          WHEN 'o_orderkey' THEN o_orderkey NOT BETWEEN r.min_value AND r.max_value END
        ELSE FALSE END) AS violations
    FROM ({rules_sql({'old_orders': TABLES['orders']}, {'old_orders': "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01')"})}) r, orders
    GROUP BY 1, 2
    """
)
def check_rules_of_older_rows(spark, sf_dir):
    """Rules learned on older rows, tried on the whole table."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where(F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz"))
    rules = recommend.recommend(profile.profile(old, "old_orders"))
    from plumbline.operators import rules as rule_ops

    rows = rule_ops.rule_rows(rules)
    names = {r["rule_id"]: r["target_columns"][0] for r in rows}
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rule_ops.run_rules(orders, rows).select(
        mapping[F.col("rule_id")].alias("columns"), "rule_type", "rows", "violations"
    )


GROUP_TABLES = {"lineitem": TABLES["lineitem"], "labels": TABLES["labels"], "trips": {
    "start_time": "time", "end_time": "time", "order_day": "time", "delivery_day": "time",
    "trip_status": "text", "result": "text", "note": "text"}}
TRIPS_SQL = """(SELECT o_orderdate AS start_time, o_orderdate AS end_time, o_orderdate AS order_day, o_orderdate AS delivery_day,
    o_orderstatus AS trip_status, NULLIF(o_orderpriority, '5-LOW') AS result, NULLIF(o_orderpriority, '1-URGENT') AS note FROM orders)"""


@query(
    f"""
    WITH prof AS (
      SELECT *, lower(column_name) AS low FROM ({profile_sql(GROUP_TABLES, {'trips': TRIPS_SQL})})
      WHERE NOT regexp_matches(lower(column_name), '{'|'.join(naming.IDENTIFIER_WORDS + naming.PII_WORDS)}')
        AND NOT (lower(column_name) LIKE '%\\_id' ESCAPE '\\'))
    SELECT a.table_name, 'CROSS_COLUMN' AS rule_type, a.column_name || ',' || b.column_name AS columns
    FROM prof a JOIN prof b ON a.table_name = b.table_name AND a.type_class = b.type_class AND a.ordinal < b.ordinal
    WHERE a.type_class IN ('INTEGER', 'NUMBER')
    UNION ALL
    SELECT a.table_name, 'TEMPORAL', a.column_name || ',' || b.column_name FROM prof a JOIN prof b ON a.table_name = b.table_name
    WHERE a.type_class = 'DATETIME' AND b.type_class = 'DATETIME'
      AND (a.low LIKE '%start%' AND b.low = replace(a.low, 'start', 'end')
        OR a.low LIKE '%order%' AND b.low = replace(a.low, 'order', 'delivery'))
    UNION ALL
    SELECT s.table_name, 'CONDITIONAL_DEPENDENCY', s.column_name || ',result,note' FROM prof s
    WHERE s.low LIKE '%status%' AND s.distinct_count BETWEEN 2 AND 20 AND s.table_name = 'trips'
    """
)
def mine_column_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    trips = orders.select(
        day.alias("start_time"), day.alias("end_time"), day.alias("order_day"), day.alias("delivery_day"),
        F.col("o_orderstatus").alias("trip_status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("result"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("note"),
    )
    tables = {"lineitem": table(spark, sf_dir, "lineitem"), "labels": table(spark, sf_dir, "labels"), "trips": trips}
    return mine.column_groups(profile.profile_tables(tables)).select(
        "table_name", "rule_type", F.array_join("target_columns", ",").alias("columns")
    )


@query(
    f"""
    SELECT 'ordered' AS a, 'shipped' AS b, CASE WHEN lt = le THEN 'BEFORE' ELSE 'BEFORE_EQUAL' END AS operator,
           le / n AS confidence, n AS support
    FROM (SELECT count(*) FILTER (ordered < shipped) AS lt, count(*) FILTER (ordered <= shipped) AS le, count(shipped) AS n FROM {SHIPPED_SQL})
    WHERE le >= 0.5 * n
    """
)
def mine_time_order(spark, sf_dir):
    found = mine.time_order_rules(shipped(spark, sf_dir), "shipped", [("ordered", "shipped")], 0.5)
    return found.select(
        F.element_at("target_columns", 1).alias("a"),
        F.element_at("target_columns", 2).alias("b"),
        F.element_at("conditions.operator", 1).alias("operator"),
        "confidence",
        F.col("evidence")["support"].cast("bigint").alias("support"),
    )


GAPS_SQL = f"(SELECT date_diff('second', ordered, shipped) AS gap FROM {SHIPPED_SQL})"


BOUNDS_SQL = f"""
    SELECT 'LTE' AS operator, ceil(u / 86400) AS value, count(*) FILTER (gap <= 86400 * ceil(u / 86400)) AS holds, count(*) AS support
    FROM (SELECT quantile_disc(gap, 0.99) AS u FROM {GAPS_SQL} WHERE gap >= 0), {GAPS_SQL} WHERE gap >= 0 GROUP BY u
    UNION ALL
    SELECT 'GTE', floor(u / 86400), count(*) FILTER (gap >= 86400 * floor(u / 86400)), count(*)
    FROM (SELECT quantile_disc(gap, 0.01) AS u FROM {GAPS_SQL} WHERE gap >= 0), {GAPS_SQL} WHERE gap >= 0 GROUP BY u"""


@query(
    f"""SELECT operator, value, 'DAY' AS unit, holds / support AS confidence, support FROM ({BOUNDS_SQL})
        WHERE value >= 2"""
)
def mine_durations(spark, sf_dir):
    found = mine.duration_rules(shipped(spark, sf_dir), "shipped", [("ordered", "shipped")], 0.99, 1_000_000)
    bound = F.col("conditions")[0]
    return found.select(
        bound["operator"].alias("operator"), bound["value"].alias("value"), bound["unit"].alias("unit"), "confidence",
        F.col("evidence")["support"].cast("bigint").alias("support"),
    )


@query(
    f"""SELECT min(gap) AS shortest, max(gap) AS longest, quantile_disc(gap, 0.99) AS usual, quantile_disc(gap, 0.01) AS least,
               count(*) AS support FROM {GAPS_SQL} WHERE gap >= 0"""
)
def mine_duration_support(spark, sf_dir):
    found = mine.duration_support(shipped(spark, sf_dir), [("ordered", "shipped")], 0.99, 1_000_000)
    return found.select("shortest", "longest", "usual", "least", "support")


NUMBERS = [c for c, kind in TABLES["lineitem"].items() if kind in ("int", "number")]
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(
    " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} < {b}) AS less, count(*) FILTER ({a} = {b}) AS equal,
            count(*) FILTER ({a} > {b}) AS greater, count({a} + {b}) AS support FROM lineitem"""
        for a, b in PAIRS
    )
)
def mine_comparison_support(spark, sf_dir):
    return mine.order_support(table(spark, sf_dir, "lineitem"), PAIRS)


@query(
    f"""
    SELECT a, b, operator, confidence FROM (
      SELECT a, b, CASE WHEN eq >= 0.55 * n THEN 'EQ' WHEN lt + eq >= 0.55 * n THEN CASE WHEN eq = 0 THEN 'LT' ELSE 'LTE' END
                        WHEN gt + eq >= 0.55 * n THEN CASE WHEN eq = 0 THEN 'GT' ELSE 'GTE' END END AS operator,
             CASE WHEN eq >= 0.55 * n THEN eq WHEN lt + eq >= 0.55 * n THEN lt + eq ELSE gt + eq END / n AS confidence
      FROM ({' UNION ALL '.join(
          f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} < {b}) AS lt, count(*) FILTER ({a} = {b}) AS eq, count(*) FILTER ({a} > {b}) AS gt, count(*) AS n FROM lineitem"
          for a, b in PAIRS)}))
    WHERE operator IS NOT NULL
    """
)
def mine_comparisons(spark, sf_dir):
    return mine.comparison_rules(table(spark, sf_dir, "lineitem"), "lineitem", PAIRS, 0.55).select(
        F.element_at("target_columns", 1).alias("a"),
        F.element_at("target_columns", 2).alias("b"),
        F.element_at("conditions.operator", 1).alias("operator"),
        "confidence",
    )


TRIPLES = ["total", "price", "fee", "net"]
INVOICE_SQL = """(SELECT l_quantity + l_linenumber AS total, l_quantity AS price, l_linenumber::DOUBLE AS fee,
                  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_quantity * l_linenumber END AS net FROM lineitem)"""


def triple_sql() -> str:
    parts = []
    for t in TRIPLES:
        rest = [c for c in TRIPLES if c != t]
        for i, a in enumerate(rest):
            for b in rest[i + 1 :]:
                for name, sign in (("ADD", "+"), ("MULTIPLY", "*")):
                    parts.append(
                        f"""SELECT '{t}' AS target, '{a}' AS a, '{b}' AS b, '{name}' AS operator,
                        count(*) FILTER ({t} = {a} {sign} {b}) AS holds, count({t} + {a} + {b}) AS support FROM {INVOICE_SQL}"""
                    )
    return " UNION ALL ".join(parts)


def invoices(spark, sf_dir):
    line = F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") + line).alias("total"),
        F.col("l_quantity").alias("price"),
        line.alias("fee"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_quantity") * line).alias("net"),
    )


@query(triple_sql())
def mine_arithmetic_support(spark, sf_dir):
    return mine.arithmetic_support(invoices(spark, sf_dir), TRIPLES)


@query(f"SELECT target || ' = ' || a || ' ' || operator || ' ' || b AS rule, holds / support AS confidence FROM ({triple_sql()}) WHERE holds >= 0.95 * support AND support > 0")
def mine_arithmetic(spark, sf_dir):
    return mine.arithmetic_rules(invoices(spark, sf_dir), "invoices", TRIPLES).select(
        F.col("reason").alias("rule"), "confidence"
    )


# planted equations: target, operands, coefficients with the constant last
AFFINE = [
    ("cents", ["l_extendedprice"], [100.0, 0.0]),
    ("charge", ["l_quantity", "l_linenumber"], [2.5, -3.0, 7.0]),
]
AFFINE_COLUMNS = ["l_quantity", "l_linenumber", "l_extendedprice", "l_tax", "charge", "cents"]
AFFINE_SQL = """(SELECT l_quantity, l_linenumber, l_extendedprice, CASE WHEN l_suppkey % 11 > 0 THEN 100 * l_extendedprice END AS cents,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_orderkey % 40 = 0 THEN 1000 ELSE 2.5 * l_quantity - 3 * l_linenumber + 7 END AS charge FROM lineitem)"""


def affine_sql() -> str:
    parts = []
    for target, operands, (*factors, constant) in AFFINE:
        total = " + ".join([f"{k} * {c}" for k, c in zip(factors, operands)] + [str(constant)])
        parts.append(
            f"""SELECT '{target}' AS target, '{",".join(operands)}' AS operands, '{",".join(map(str, [*factors, constant]))}' AS coefficients,
            count({target}) AS support, count(*) FILTER (abs({target} - ({total})) < 1e-6) AS holds FROM {AFFINE_SQL}"""
        )
    return " UNION ALL ".join(parts)


@query(affine_sql())
def mine_affine(spark, sf_dir):
    """Charges that are sums of multiples, one in forty wrong, and amounts in cents."""
    charge = F.when(F.col("l_orderkey") % 40 == 0, 1000.0).otherwise(F.lit(2.5) * F.col("l_quantity") - F.lit(3) * F.col("l_linenumber") + 7)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_linenumber", "l_extendedprice", "l_tax",
        F.when(F.col("l_suppkey") % 13 != 0, charge).alias("charge"),
        F.when(F.col("l_suppkey") % 11 > 0, F.lit(100) * F.col("l_extendedprice")).alias("cents"),
    )
    found = affine.affine_support(rows, AFFINE_COLUMNS)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("target", text("operands"), text("coefficients"), "support", "holds")


CASES_SQL = """(SELECT o_orderstatus AS status, o_orderpriority AS priority,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN o_orderdate END AS closed_at,
    CASE WHEN o_orderstatus = 'P' THEN 'hold' WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'paid' WHEN o_orderstatus = 'F' THEN 'sent'
         WHEN o_custkey % 3 = 0 THEN 'new' WHEN o_custkey % 3 = 1 THEN 'hold' ELSE 'paid' END AS stage FROM orders)"""


def cases(spark, sf_dir):
    status, customer = F.col("o_orderstatus"), F.col("o_custkey")
    closed = (status == "F") | ((status == "P") & (customer % 2 == 0))
    stage = (
        F.when(status == "P", "hold")
        .when((status == "F") & (customer % 2 == 0), "paid")
        .when(status == "F", "sent")
        .when(customer % 3 == 0, "new")
        .when(customer % 3 == 1, "hold")
        .otherwise("paid")
    )
    return table(spark, sf_dir, "orders").select(
        status.alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(closed, F.col("o_orderdate")).alias("closed_at"),
        stage.alias("stage"),
    )


def support_sql() -> str:
    columns = ["status", "priority", "stage"]
    parts = []
    for a in columns:
        for b in columns:
            if a != b:
                parts.append(f"SELECT '{a}' AS if_column, {a} AS if_value, '{b}' AS then_column, {b} AS then_value, count(*) AS n FROM {CASES_SQL} GROUP BY {a}, {b}")
        parts.append(
            f"""SELECT '{a}', {a}, 'closed_at', CASE WHEN closed_at IS NOT NULL THEN '' END, count(*) FROM {CASES_SQL}
                GROUP BY {a}, closed_at IS NOT NULL"""
        )
    return " UNION ALL ".join(parts)


@query(support_sql())
def mine_conditional_support(spark, sf_dir):
    return mine.conditional_support(cases(spark, sf_dir), ["status", "priority", "stage"], ["closed_at"])


@query(
    f"""
    WITH s AS ({support_sql()}),
    w AS (SELECT if_column, then_column, count(DISTINCT then_value) AS all_values, sum(CASE WHEN then_value IS NULL THEN n ELSE 0 END) AS all_nulls,
                 sum(n) AS all_rows FROM s GROUP BY ALL),
    c AS (SELECT if_column, if_value, then_column, sum(n) AS support, sum(CASE WHEN then_value IS NOT NULL THEN n ELSE 0 END) AS present,
                 count(then_value) AS v, max(CASE WHEN then_value IS NOT NULL THEN n END) AS top FROM s GROUP BY ALL)
    SELECT if_column, if_value, then_column, kind, CAST(holds AS BIGINT) AS holds, CAST(support AS BIGINT) AS support FROM (
      SELECT c.*, CASE WHEN mixed AND support - present >= 0.95 * support THEN 'IS_NULL'
                       WHEN cat AND all_values > 1 AND top >= 0.95 * support THEN 'EQ'
                       WHEN cat AND v < all_values AND present >= 0.95 * support THEN 'IN'
                       WHEN mixed AND present >= 0.95 * support THEN 'IS_NOT_NULL' END AS kind,
             CASE WHEN mixed AND support - present >= 0.95 * support THEN support - present
                  WHEN cat AND all_values > 1 AND top >= 0.95 * support THEN top ELSE present END AS holds
      FROM (SELECT c.*, w.all_values, w.all_nulls > 0 AND w.all_nulls < w.all_rows AS mixed, c.then_column <> 'closed_at' AS cat
            FROM c JOIN w ON c.if_column = w.if_column AND c.then_column = w.then_column) c)
    WHERE kind IS NOT NULL
    """
)
def mine_conditionals(spark, sf_dir):
    found = mine.conditional_rules(
        cases(spark, sf_dir), "cases", ["status", "priority", "stage"], ["closed_at"]
    )
    then = F.col("conditions")[1]
    return found.select(
        F.element_at("target_columns", 1).alias("if_column"),
        F.from_json(F.concat(F.lit("["), F.col("conditions")[0]["right_value"], F.lit("]")), "array<string>")[0].alias("if_value"),
        F.element_at("target_columns", 2).alias("then_column"),
        then["operator"].alias("kind"),
        F.col("evidence")["holds"].cast("bigint").alias("holds"),
        F.col("evidence")["support"].cast("bigint").alias("support"),
    )


FD_COLUMNS = ["nation", "region", "segment", "nation_name"]
FD_SQL = """(SELECT c_nationkey AS nation, n_regionkey AS region, c_mktsegment AS segment, n_name AS nation_name
             FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def located(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_nationkey").alias("nation"),
            F.col("n_regionkey").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation_name"),
        )
    )


def fd_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS n_values, count(*) FILTER (d > 1) AS n_broken
            FROM (SELECT {a}, count(DISTINCT {b}) AS d FROM {FD_SQL} GROUP BY {a})"""
        for a in FD_COLUMNS
        for b in FD_COLUMNS
        if a != b
    )


@query(fd_sql())
def mine_dependency_support(spark, sf_dir):
    return mine.dependency_support(located(spark, sf_dir), FD_COLUMNS)


@query(f"SELECT determinant, dependent FROM ({fd_sql()}) WHERE n_broken = 0 AND n_values > 1")
def mine_dependencies(spark, sf_dir):
    return mine.dependencies(located(spark, sf_dir), FD_COLUMNS).select("determinant", "dependent")
