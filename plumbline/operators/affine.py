"""REC-13: columns that are others multiplied and added up, t = k * a + m * b + c.

Coefficients are proposed from a sample of rows and then counted on all rows. Each proposal solves
the equation on few rows drawn from the sample, for all targets at once, so that rows which break
the rule spoil some draws only. Solved coefficients become the nearest short fraction; those that
hold on enough of the sample are counted exactly, in one scan for every 200 counters.

The sample costs no row of the result: it only names coefficients. An equation may be missed where
fewer than LEAST_ROWS rows of the sample hold all of its columns.

Defined cases: null and NaN make an equation unknown; columns with one value, and equations with a
zero coefficient, are left out; of an equation that holds on a pair, no triple is reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks, mine, recommend

SAMPLE = 1024  # rows with the smallest hashes of their values and place
LEAST_ROWS = 8
DRAWS = 32
MARGIN = 0.15  # by which a share of the sample may fall short of the share wanted
LARGEST_DENOMINATOR = 1000
CLOSE = 1e-9  # relative difference that counts as equal

Equation = tuple[str, tuple[str, ...], tuple[float, ...]]


def _fraction(x: float) -> float | None:
    """The nearest short fraction, if it is as good as equal."""
    if not np.isfinite(x):
        return None
    near = float(Fraction(float(x)).limit_denominator(LARGEST_DENOMINATOR))
    return near if abs(near - x) <= 1e-6 * max(1.0, abs(x)) else None


def _equal(t: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Whether t equals the sum of the terms (a row each), up to rounding."""
    return np.abs(t - terms.sum(0)) <= CLOSE * np.maximum(np.abs(t), np.abs(terms).max(0))


def _proposed(sample: np.ndarray, names: Sequence[str], n_terms: int, share: float, known: set[frozenset]) -> list[Equation]:
    """Equations of so many terms that hold on the share of the sampled rows that hold all columns."""
    rng = np.random.default_rng(7)
    given = ~np.isnan(sample)
    found: list[Equation] = []
    for chosen in combinations(range(len(names) - 1), n_terms):
        rows = np.flatnonzero(given[:, chosen].all(1))
        if len(rows) < LEAST_ROWS:
            continue
        ones = np.ones((len(rows), 1))
        left = np.hstack([sample[np.ix_(rows, chosen)], ones])
        targets = [t for t in range(chosen[-1] + 1, len(names))]
        draws = rng.integers(0, len(rows), (DRAWS, n_terms + 1))
        scale = np.abs(left).max(0)
        scale[scale == 0] = 1.0
        systems = left[draws] / scale
        good = np.abs(np.linalg.det(systems)) > 1e-12
        if not good.any():
            continue
        right = sample[np.ix_(rows, targets)]
        solved = np.linalg.solve(systems[good], right[draws[good]]) / scale[:, None]
        for j, t in enumerate(targets):
            columns = {names[c] for c in (*chosen, t)}
            whole = ~np.isnan(right[:, j])
            if whole.sum() < LEAST_ROWS or any(k <= columns for k in known):
                continue
            tried = set()
            for coefficients in solved[:, :, j]:
                short = tuple(_fraction(x) for x in coefficients)
                if None in short or 0.0 in short[:-1] or short in tried:
                    continue
                tried.add(short)
                terms = (left[whole] * np.array(short)).T
                if _equal(right[whole, j], terms).mean() >= share:
                    found.append((names[t], tuple(names[c] for c in chosen), short))
    return found


def _holds(equation: Equation) -> Column:
    target, columns, coefficients = equation
    t = F.col(target).cast("double")
    terms = [F.lit(k) * F.col(c).cast("double") for k, c in zip(coefficients, columns)] + [F.lit(coefficients[-1])]
    total = sum(terms[1:], terms[0])
    largest = F.greatest(F.abs(t), *[F.abs(x) for x in terms])
    return F.abs(t - total) <= F.lit(CLOSE) * largest


def _known(columns: Sequence[str]) -> Column:
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return every


_SUPPORT = schemas.struct(
    target=T.StringType(), operands=T.ArrayType(T.StringType()), coefficients=T.ArrayType(T.DoubleType()),
    support=T.LongType(), holds=T.LongType(),
)


def affine_support(df: DataFrame, columns: Sequence[str], min_confidence: float = 0.95) -> DataFrame:
    """(target, operands, coefficients, support, holds): equations that hold on enough rows.

    The last of the coefficients is the constant. Of the columns of an equation the last in
    ``columns`` is the target. One operand is searched before two.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sampled = numbers.orderBy(F.xxhash64(*columns, F.monotonically_increasing_id())).limit(SAMPLE).toPandas().to_numpy(float).reshape(-1, len(columns))
    sampled[~np.isfinite(sampled)] = np.nan
    varied = [i for i in range(len(columns)) if len(np.unique(sampled[~np.isnan(sampled[:, i]), i])) > 1]
    names, sample = [columns[i] for i in varied], sampled[:, varied]
    kept: list[dict] = []
    known: set[frozenset] = set()
    for n_terms in (1, 2):
        tried = _proposed(sample, names, n_terms, min_confidence - MARGIN, known)
        if not tried:
            continue
        items = []
        for i, e in enumerate(tried):
            every = _known((e[0], *e[1]))
            items.append({"=i": F.lit(i), "support": F.count_if(every), "holds": F.count_if(every & _holds(e))})
        for r in mine._counters(df, items).collect():
            if 0 < r.support and r.holds >= min_confidence * r.support:
                target, operands, coefficients = tried[r.i]
                kept.append(
                    {"target": target, "operands": list(operands), "coefficients": list(coefficients), "support": r.support, "holds": r.holds}
                )
                known.add(frozenset((target, *operands)))
    return local_frame(df.sparkSession, kept, _SUPPORT)


def affine_rules(df: DataFrame, table_name: str, columns: Sequence[str], min_confidence: float = 0.95) -> DataFrame:
    """REC-13: the equations as rules with a SQL expression."""
    found = affine_support(df, columns, min_confidence).withColumn("table_name", F.lit(table_name))
    # operands beside their coefficients, the constant last
    terms = F.concat(
        F.zip_with(
            "operands", F.slice("coefficients", 1, F.size("operands")), lambda c, k: F.concat(k.cast("string"), F.lit("D * `"), c, F.lit("`"))
        ),
        F.array(F.concat(F.element_at("coefficients", -1).cast("string"), F.lit("D"))),
    )
    target = F.concat(F.lit("`"), "target", F.lit("`"))
    total, sizes = F.array_join(terms, " + "), F.array_join(F.transform(terms, lambda x: F.concat(F.lit("abs("), x, F.lit(")"))), ", ")
    sql = F.format_string(f"abs(%s - (%s)) <= {CLOSE!r}D * greatest(abs(%s), %s)", target, total, target, sizes)
    support, holds = F.col("support"), F.col("holds")
    return recommend.as_rules(
        found,
        checks.CUSTOM_SQL,
        F.concat(F.array("target"), F.col("operands")),
        holds / support,
        F.concat_ws(" = ", "target", F.regexp_replace(F.regexp_replace(total, "`", ""), r"(\d)D\b", "$1")),
        engine="ADVANCED",
        params_=recommend.params(sql_expression=sql),
        evidence_=recommend.evidence(support=support, holds=holds),
        validation_status=F.when(support < mine.SMALL_SUPPORT, "WARNING").otherwise("VALID"),
        validation_message=F.when(support < mine.SMALL_SUPPORT, F.format_string("Only %d rows support it.", support)),
    )
