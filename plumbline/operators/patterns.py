"""Regular expressions that the values of a text column follow, as rules for CHK-7.

Values are generalised in steps, each of which maps the patterns of the step before to fewer:

0. each capital letter, small letter and digit becomes its class, so that lengths are kept,
1. runs of a class become one,
2. runs of letters of either case become one,
3. runs of letters and digits become one.

Other characters stand for themselves. The patterns of all columns are counted in one grouping and
then generalised, so that the data is read once. A column's pattern is the commonest one of the first
step at which it covers enough of the rows. Values longer than ``longest`` follow none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators import checks
from plumbline.operators.mine import _mined
from plumbline.operators.predicates import column

# What each step replaces, by the letter that stands for it. No letter but these is left after step 0.
STEPS = [
    [("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "9")],
    [("A+", "A"), ("a+", "a"), ("9+", "9")],
    [("[Aa]+", "L")],
    [("[L9]+", "X")],
]
CLASSES = {"A": "[A-Z]", "a": "[a-z]", "9": "[0-9]", "L": "[A-Za-z]", "X": "[A-Za-z0-9]"}


def _generalised(pattern: Column, step: int) -> Column:
    return reduce(lambda p, by: F.regexp_replace(p, *map(F.lit, by)), STEPS[step], pattern)


def regex_of(pattern: str, step: int) -> str:
    """The regular expression of a pattern, for a whole value."""
    parts = []
    for run in re.finditer(r"(.)\1*", pattern, re.S):
        char, n = run.group(1), len(run.group(0))
        if char not in CLASSES:
            parts.append(re.escape(char) * n)
        elif step:
            parts.append((CLASSES[char] + "+") * n)
        else:
            parts.append(CLASSES[char] + (f"{{{n}}}" if n > 1 else ""))
    return "^" + "".join(parts) + r"\z"


def value_patterns(df: DataFrame, columns: Sequence[str] | None = None, min_confidence: float = 0.95, longest: int = 64) -> DataFrame:
    """(column_name, step, pattern, matches, support) of the text columns that follow one pattern.

    ``support`` are the rows that are not null, ``matches`` those that follow the pattern. The empty
    text is a pattern of its own; a column of empty texts only has none. Of equally common patterns
    the first in the order of its characters counts.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, step int, pattern string, matches bigint, support bigint")
    shape = lambda c: F.when(F.length(c) <= longest, _generalised(c, 0)).otherwise(F.lit(None))
    values = [F.when(column(c).isNotNull(), F.struct(F.lit(c).alias("column_name"), shape(column(c)).alias("pattern"))) for c in names]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*values))).alias("v"))
        .groupBy("v.column_name", "v.pattern")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    steps = [F.struct(F.lit(0).alias("step"), F.col("pattern"))]
    last = F.col("pattern")
    for i in range(1, len(STEPS)):
        last = _generalised(last, i)
        steps.append(F.struct(F.lit(i).alias("step"), last.alias("pattern")))
    by_step = (
        counted.select("column_name", "n", F.explode(F.array(*steps)).alias("p"))
        .groupBy("column_name", "p.step", "p.pattern")
        .agg(F.sum("n").alias("matches"))
        .groupBy("column_name", "step")
        .agg(
            F.sum("matches").alias("support"),
            F.min(F.when(F.col("pattern").isNotNull(), F.struct((-F.col("matches")).alias("order"), "pattern"))).alias("best"),
        )
        .select("column_name", "step", "support", F.col("best.pattern").alias("pattern"), (-F.col("best.order")).alias("matches"))
    )
    enough = by_step.where((F.col("pattern") != "") & (F.col("matches") >= F.col("support") * F.lit(min_confidence)))
    first = F.row_number().over(Window.partitionBy("column_name").orderBy("step"))
    found = enough.withColumn("first", first).where("first = 1")
    return found.select("column_name", "step", "pattern", "matches", "support")


def pattern_rules(df: DataFrame, table_name: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """CHK-7: a rule with a regular expression for each column that follows a pattern."""
    found = value_patterns(df, columns, **options)
    # one row per column: schema-sized
    regexes = {r["column_name"]: regex_of(r["pattern"], r["step"]) for r in found.collect()}
    named = [v for kv in regexes.items() for v in kv] or ["", ""]
    of = lambda c: F.create_map(*map(F.lit, named))[c]
    rules = _mined(
        found, table_name, checks.REGEX, F.array("column_name"), F.array().cast(schemas.RULES["conditions"].dataType),
        F.col("matches"), F.format_string("%s follows %s", "column_name", of(F.col("column_name"))),
    )
    regex = of(F.col("target_columns")[0])
    fields = [(regex if f.name == "regex" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PARAMS.fields]
    return rules.withColumn("params", F.struct(*fields))
