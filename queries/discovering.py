"""Keys, dependencies and references that the tables have without declaring them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import discover, heavy, patterns
from queries.base import TABLES, all_tables, query, table


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _present(names) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


def sets_sql(source: str, columns: list[str], most: int) -> str:
    """Rows and distinct values of all sets of columns, in the order of the columns."""
    parts = []
    for size in range(1, most + 1):
        for s in combinations(columns, size):
            value = f"CASE WHEN {_present(s)} THEN ROW({', '.join(s)}) END"
            parts.append(f"SELECT {_listed(s)} AS columns, count({value}) AS rows, count(DISTINCT {value}) AS distinct_rows FROM {source}")
    return " UNION ALL ".join(parts)


def keys_sql(source: str, columns: list[str], most: int, share: float) -> str:
    return f"""
    (WITH sets AS (SELECT *, rows - distinct_rows AS repeats, CAST(floor({1 - share:.6f} * (SELECT count(*) FROM {source}) + 1e-9) AS BIGINT) AS allowed
                  FROM ({sets_sql(source, columns, most)})),
    usable AS (SELECT * FROM sets WHERE NOT EXISTS (
      SELECT 1 FROM sets AS single WHERE len(single.columns) = 1 AND list_has_all(sets.columns, single.columns) AND single.rows < 2)),
    found AS (SELECT * FROM usable WHERE repeats <= allowed),
    smaller AS (
      SELECT a.columns, bool_or(b.repeats = 0) AS has_key, count(*) > 0 AS has_near
      FROM found AS a JOIN found AS b ON len(b.columns) < len(a.columns) AND list_has_all(a.columns, b.columns) GROUP BY ALL)
    SELECT found.columns, rows, distinct_rows, repeats, CASE WHEN repeats = 0 THEN 'KEY' ELSE 'NEAR_KEY' END AS kind
    FROM found LEFT JOIN smaller USING (columns)
    WHERE NOT coalesce(has_key, false) AND (repeats = 0 OR NOT coalesce(has_near, false)))
    """


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, array_to_string(columns, ',') AS columns, rows, distinct_rows AS \"distinct\" FROM {keys_sql(t, list(c), 2, 1.0)}"
        for t, c in TABLES.items()
    )
)
def mine_keys(spark, sf_dir):
    found = discover.keys_of_tables(all_tables(spark, sf_dir), max_columns=2)
    return found.select("table_name", F.array_join("columns", ",").alias("columns"), "rows", "distinct")


@query(
    f"""SELECT array_to_string(columns, ',') AS columns, rows, distinct_rows AS "distinct", repeats, kind
        FROM {keys_sql("lineitem", list(TABLES["lineitem"]), 2, 0.95)}"""
)
def mine_near_keys(spark, sf_dir):
    found = discover.keys(table(spark, sf_dir, "lineitem"), max_columns=2, min_confidence=0.95)
    return found.withColumn("columns", F.array_join("columns", ","))


@query(
    f"""SELECT array_to_string(columns, ',') AS columns, distinct_rows / rows AS confidence
        FROM {keys_sql("orders", list(TABLES["orders"]), 3, 0.95)}"""
)
def mine_key_rules(spark, sf_dir):
    rules = discover.key_rules(table(spark, sf_dir, "orders"), "orders", max_columns=3, min_confidence=0.95)
    return rules.select(F.array_join("target_columns", ",").alias("columns"), "confidence")


GRADED = ["flag", "status", "number", "tax", "zone", "desk", "day"]
GRADED_SQL = """(SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS number, CASE WHEN l_suppkey % 9 > 0 THEN l_tax END AS tax,
    l_returnflag || (l_linenumber % 4) AS zone, CASE WHEN l_orderkey % 97 = 0 THEN 'other' ELSE l_linestatus || l_linenumber END AS desk,
    l_shipdate AS day FROM lineitem)"""


def graded(spark, sf_dir):
    """Lines with a zone that flag and number determine, and a desk that status and number nearly do."""
    text = lambda *c: F.concat(*c)
    number = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        number.alias("number"),
        F.when(F.col("l_suppkey") % 9 > 0, F.col("l_tax")).alias("tax"),
        text("l_returnflag", (number % 4).cast("string")).alias("zone"),
        F.when(F.col("l_orderkey") % 97 == 0, "other").otherwise(text("l_linestatus", number.cast("string"))).alias("desk"),
        F.col("l_shipdate").alias("day"),
    )


def dependencies_sql(source: str, columns: list[str], most: int, share: float) -> str:
    parts = []
    for size in range(1, most + 1):
        for x in combinations(columns, size):
            for c in columns:
                if c not in x:
                    keys = ", ".join(x)
                    parts.append(
                        f"""SELECT {_listed(x)} AS x, '{c}' AS c, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS support,
                        CAST(sum(n - most) AS BIGINT) AS removals FROM (SELECT {keys}, sum(n) AS n, max(n) AS most FROM (
                        SELECT {keys}, {c}, count(*) AS n FROM {source} WHERE {_present([*x, c])} GROUP BY ALL) GROUP BY {keys})"""
                    )
    return f"""
    WITH sets AS (SELECT columns AS x, rows - distinct_rows AS repeats, distinct_rows FROM ({sets_sql(source, columns, most)})),
    bound AS (SELECT CAST(floor({1 - share:.6f} * count(*) + 1e-9) AS BIGINT) AS allowed FROM {source}),
    constants AS (SELECT x[1] AS c FROM sets WHERE len(x) = 1 AND distinct_rows < 2),
    usable AS (
      SELECT x FROM sets WHERE NOT EXISTS (SELECT 1 FROM sets AS u, bound WHERE list_has_all(sets.x, u.x) AND u.repeats <= allowed)
        AND NOT EXISTS (SELECT 1 FROM constants WHERE list_contains(sets.x, c))),
    held AS (
      SELECT d.* FROM ({" UNION ALL ".join(parts)}) AS d JOIN usable USING (x), bound
      WHERE coalesce(removals, 0) <= allowed AND d.c NOT IN (SELECT c FROM constants))
    SELECT array_to_string(x, ',') AS determinant, c AS dependent, n_values, support, removals
    FROM held AS h WHERE n_values < support
      AND NOT EXISTS (SELECT 1 FROM held AS s WHERE s.c = h.c AND len(s.x) < len(h.x) AND list_has_all(h.x, s.x))
    """


@query(dependencies_sql(GRADED_SQL, GRADED, 2, 1.0))
def mine_dependencies_composite(spark, sf_dir):
    found = discover.composite_dependencies(graded(spark, sf_dir), GRADED)
    return found.withColumn("determinant", F.array_join("determinant", ","))


@query(dependencies_sql(GRADED_SQL, GRADED, 2, 0.95))
def mine_dependencies_composite_near(spark, sf_dir):
    found = discover.composite_dependencies(graded(spark, sf_dir), GRADED, min_confidence=0.95)
    return found.withColumn("determinant", F.array_join("determinant", ","))


@query(
    f"""SELECT determinant || ',' || dependent AS columns, (support - removals) / support AS confidence
        FROM ({dependencies_sql("orders", list(TABLES["orders"]), 2, 0.7)})"""
)
def mine_dependency_rules_composite(spark, sf_dir):
    rules = discover.composite_dependency_rules(table(spark, sf_dir, "orders"), "orders", min_confidence=0.7)
    return rules.select(F.array_join("target_columns", ",").alias("columns"), "confidence")


KINDS = {"int": "INTEGER", "text": "STRING", "time": "TIME"}


def references_sql(share: float) -> str:
    columns = [(t, c, KINDS[k]) for t, cs in TABLES.items() for c, k in cs.items() if k in KINDS]
    values = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS kind, CAST({c} AS VARCHAR) AS x FROM {t} WHERE {c} IS NOT NULL" for t, c, k in columns
    )
    unique = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count({c}) = count(DISTINCT {c})" for t, c, _ in columns)
    return f"""
    WITH v AS MATERIALIZED ({values}),
    sizes AS (SELECT t, c, kind, count(*) AS n FROM v GROUP BY ALL),
    keys AS (SELECT t, c, kind, n FROM sizes JOIN ({unique}) USING (t, c)),
    shared AS (
      SELECT a.t AS t, a.c AS c, b.t AS u, b.c AS p, count(*) AS n
      FROM v AS a JOIN v AS b ON a.kind = b.kind AND a.x = b.x GROUP BY ALL)
    SELECT s.t AS child_table, s.c AS child_column, k.t AS parent_table, k.c AS parent_column, s.n AS n_values,
           s.n - coalesce(shared.n, 0) AS missing, k.n AS parent_values,
           regexp_replace(s.c, '^[^_]*_', '') = regexp_replace(k.c, '^[^_]*_', '') AS same_name
    FROM sizes AS s JOIN keys AS k ON s.kind = k.kind AND (s.t <> k.t OR s.c <> k.c)
    LEFT JOIN shared ON shared.t = s.t AND shared.c = s.c AND shared.u = k.t AND shared.p = k.c
    WHERE s.n - coalesce(shared.n, 0) <= {1 - share:.6f} * s.n + 1e-9
    """


@query(references_sql(1.0))
def mine_references(spark, sf_dir):
    return discover.references(all_tables(spark, sf_dir))


@query(references_sql(0.5))
def mine_references_near(spark, sf_dir):
    return discover.references(all_tables(spark, sf_dir), min_confidence=0.5)


@query(
    f"""SELECT child_table AS table_name, child_column AS "column", arg_min(parent_table || '.' || parent_column,
          (NOT same_name, -(n_values - missing) / parent_values, parent_table, parent_column)) AS parent
        FROM ({references_sql(1.0)}) GROUP BY ALL"""
)
def mine_reference_constraints(spark, sf_dir):
    found = discover.reference_constraints(discover.references(all_tables(spark, sf_dir)))
    return found.select(
        "table_name", F.col("columns")[0].alias("column"), F.concat_ws(".", "ref_table", F.col("ref_columns")[0]).alias("parent")
    )


@query(
    """SELECT word AS value, count(*) AS "count" FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
       WHERE word IS NOT NULL GROUP BY word ORDER BY count(*) DESC, word LIMIT 20"""
)
def top_words(spark, sf_dir):
    return heavy.heavy_hitters(table(spark, sf_dir, "documents"), F.explode(F.split("text", " ")))


@query(
    """SELECT l_partkey AS value, count(*) AS "count" FROM lineitem WHERE l_partkey IS NOT NULL
       GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 20"""
)
def top_parts(spark, sf_dir):
    return heavy.heavy_hitters(table(spark, sf_dir, "lineitem"), "l_partkey")


def patterns_sql(source: str, columns: list[str], share: float) -> str:
    def replaced(value: str, step: int) -> str:
        for what, by in patterns.STEPS[step]:
            value = f"regexp_replace({value}, '{what}', '{by}', 'g')"
        return value

    first = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN length({c}) <= 64 THEN {replaced(c, 0)} END AS pattern FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )
    return f"""
    WITH s0 AS ({first}),
    s1 AS (SELECT column_name, {replaced("pattern", 1)} AS pattern FROM s0),
    s2 AS (SELECT column_name, {replaced("pattern", 2)} AS pattern FROM s1),
    s3 AS (SELECT column_name, {replaced("pattern", 3)} AS pattern FROM s2),
    steps AS (SELECT 0 AS step, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3),
    n AS (SELECT column_name, step, pattern, count(*) AS n FROM steps GROUP BY ALL),
    best AS (
      SELECT column_name, step, sum(n) AS support, arg_min(pattern, (-n, pattern)) FILTER (pattern IS NOT NULL) AS pattern,
             max(n) FILTER (pattern IS NOT NULL) AS matches FROM n GROUP BY ALL)
    SELECT column_name, CAST(step AS INTEGER) AS step, pattern, matches, CAST(support AS BIGINT) AS support FROM best
    WHERE pattern <> '' AND matches >= {share} * support QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY step) = 1
    """


PATTERN_TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "conversations"]


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, * FROM ({patterns_sql(t, [c for c, k in TABLES[t].items() if k == 'text'], 0.95)})" for t in PATTERN_TABLES
    )
)
def mine_patterns(spark, sf_dir):
    frames = [patterns.value_patterns(table(spark, sf_dir, t)).withColumn("table_name", F.lit(t)) for t in PATTERN_TABLES]
    return reduce(DataFrame.unionByName, frames)


@query(
    f"""SELECT column_name, matches / support AS confidence FROM ({patterns_sql("customer", ["c_name", "c_mktsegment"], 0.1)})"""
)
def mine_pattern_rules(spark, sf_dir):
    rules = patterns.pattern_rules(table(spark, sf_dir, "customer"), "customer", min_confidence=0.1)
    return rules.select(F.col("target_columns")[0].alias("column_name"), "confidence")
