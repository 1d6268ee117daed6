"""Row predicates (COND-*) and the predicates of multi-column rules (RULE-1..3).

A condition is a dict of the same shape as in a rule; each builder returns a boolean Column in
its valid form or, with ``negate=True``, in its violation form. Nulls follow SQL: a comparison
with null is unknown, and an unknown condition is no violation. Arithmetic that overflows is
unknown. With the schema of the table, text compared with another type is read as that type, and
text that cannot be read is unknown.
"""

from __future__ import annotations

import json
import operator as op
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Condition = Mapping[str, Any]


class RuleError(ValueError):
    """A rule or condition that cannot be checked."""


COMPARE = {
    "EQ": op.eq, "NEQ": op.ne, "GT": op.gt, "GTE": op.ge, "LT": op.lt, "LTE": op.le,
}
ORDER = {
    "BEFORE": op.lt, "BEFORE_EQUAL": op.le, "AFTER": op.gt, "AFTER_EQUAL": op.ge,
}
ARITHMETIC = {
    "ADD": F.try_add, "SUBTRACT": F.try_subtract, "MULTIPLY": F.try_multiply, "DIVIDE": F.try_divide,
}
NEGATED = {
    "EQ": "NEQ", "NEQ": "EQ", "GT": "LTE", "LTE": "GT", "GTE": "LT", "LT": "GTE",
    "IS_NULL": "IS_NOT_NULL", "IS_NOT_NULL": "IS_NULL",
    "IN": "NOT_IN", "NOT_IN": "IN",
    "BEFORE": "AFTER_EQUAL", "AFTER_EQUAL": "BEFORE",
    "AFTER": "BEFORE_EQUAL", "BEFORE_EQUAL": "AFTER",
}
DURATION_OPERATORS = ("GT", "GTE", "LT", "LTE")
UNIT_DAYS_HOURS_MINUTES = {"DAY": (1, 0, 0), "HOUR": (0, 1, 0), "MINUTE": (0, 0, 1)}

# The conditions each rule type may hold.
ALLOWED_CONDITIONS = {
    "CROSS_COLUMN": {"COMPARISON", "ARITHMETIC"},
    "CONDITIONAL_DEPENDENCY": {"COMPARISON", "NULL_CHECK", "SET"},
    "TEMPORAL": {"TEMPORAL_ORDER", "DURATION"},
}


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(predicates: Iterable[Column]) -> Column:
    """COND-10: AND, true when empty."""
    found = list(predicates)
    return reduce(op.and_, found) if found else F.lit(True)


def any_of(predicates: Iterable[Column]) -> Column:
    """COND-11: OR, false when empty."""
    found = list(predicates)
    return reduce(op.or_, found) if found else F.lit(False)


def _need(cond: Condition, *keys: str) -> None:
    missing = [k for k in keys if cond.get(k) is None]
    if missing:
        raise RuleError(f"{cond.get('type')} condition lacks {', '.join(missing)}")


def _choice(name: str, allowed: Iterable[str], what: str, negate: bool) -> str:
    if name not in allowed:
        raise RuleError(f"Unsupported {what} operator: {name}")
    return NEGATED[name] if negate else name


def _kind(name: str, schema: T.StructType | None) -> T.DataType | None:
    return schema[name].dataType if schema is not None and name in schema.names else None


def _literal_kind(value: Any) -> T.DataType:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
    return kinds.get(type(value), T.StringType())


def _read_as(value: Column, kind: T.DataType | None, other: T.DataType | None) -> Column:
    """Text as the type it is compared with, numbers as double; any other value as it is."""
    if not isinstance(kind, T.StringType) or other is None or isinstance(other, T.StringType):
        return value
    if isinstance(other, T.NumericType):
        return value.try_cast("double")
    return value.try_cast(other)


def comparison(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-1, 2: column against column or literal."""
    _need(cond, "left", "operator", "right")
    right = cond["right"]
    if not isinstance(right, Mapping) or "type" not in right or "value" not in right:
        raise RuleError("COMPARISON right needs a type and a value")
    name = _choice(cond["operator"], COMPARE, "comparison", negate)
    kinds = {"column": column, "literal": F.lit}
    if right["type"] not in kinds:
        raise RuleError(f"Unsupported operand type: {right['type']}")
    left_kind, value = _kind(cond["left"], schema), right["value"]
    right_kind = _kind(value, schema) if right["type"] == "column" else _literal_kind(value)
    return COMPARE[name](
        _read_as(column(cond["left"]), left_kind, right_kind),
        _read_as(kinds[right["type"]](value), right_kind, left_kind),
    )


def null_check(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-3. Blank text is not null here."""
    _need(cond, "column", "operator")
    name = _choice(cond["operator"], ("IS_NULL", "IS_NOT_NULL"), "null", negate)
    c = column(cond["column"])
    return c.isNull() if name == "IS_NULL" else c.isNotNull()


def membership(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-4: IN and NOT_IN, case-sensitive; an empty list is refused."""
    _need(cond, "left", "operator", "values")
    values = cond["values"]
    if not isinstance(values, (list, tuple)) or not values:
        raise RuleError("SET needs a list of values")
    name = _choice(cond["operator"], ("IN", "NOT_IN"), "set", negate)
    kind = _kind(cond["left"], schema)
    listed = next((k for k in map(_literal_kind, values) if not isinstance(k, T.StringType)), None)
    left = _read_as(column(cond["left"]), kind, listed)
    inside = left.isin(*(_read_as(F.lit(v), _literal_kind(v), listed if isinstance(kind, T.StringType) else kind) for v in values))
    return inside if name == "IN" else ~inside


def arithmetic(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-5: target against operands combined left to right; x / 0 is null.

    An optional ``tolerance`` widens EQ and NEQ for floating point values.
    """
    _need(cond, "target", "comparison_operator", "expression")
    name = _choice(cond["comparison_operator"], COMPARE, "comparison", negate)
    expression = cond["expression"]
    operands = expression.get("operands") or []
    if len(operands) < 2:
        raise RuleError("ARITHMETIC needs two or more operands")
    if expression.get("operator") not in ARITHMETIC:
        raise RuleError(f"Unsupported arithmetic operator: {expression.get('operator')}")
    value = reduce(ARITHMETIC[expression["operator"]], [column(o) for o in operands])
    target = column(cond["target"])
    tolerance = cond.get("tolerance")
    if tolerance and name in ("EQ", "NEQ"):
        gap = F.try_subtract(target, value)
        near = (gap <= F.lit(tolerance)) & (gap >= F.lit(-tolerance))
        return near if name == "EQ" else ~near
    return COMPARE[name](target, value)


def temporal_order(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-6: one date or time column before or after another."""
    _need(cond, "left", "operator", "right")
    name = _choice(cond["operator"], ORDER, "temporal", negate)
    return ORDER[name](column(cond["left"]), column(cond["right"]))


def duration(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-7: end against start plus a number of minutes, hours or days."""
    _need(cond, "start_column", "end_column", "operator", "value", "unit")
    name = _choice(cond["operator"], DURATION_OPERATORS, "duration", negate)
    if cond["unit"] not in UNIT_DAYS_HOURS_MINUTES:
        raise RuleError(f"Unsupported duration unit: {cond['unit']}")
    if not cond["value"] > 0:
        raise RuleError("DURATION needs a positive value")
    shares = UNIT_DAYS_HOURS_MINUTES[cond["unit"]]
    if float(cond["value"]).is_integer():
        days, hours, mins = (F.lit(int(cond["value"]) * s) for s in shares)
        step = F.make_dt_interval(days, hours, mins)
    else:
        seconds = cond["value"] * sum(s * f for s, f in zip(shares, (86400, 3600, 60)))
        step = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return COMPARE[name](column(cond["end_column"]), column(cond["start_column"]) + step)


BUILDERS = {
    "COMPARISON": comparison,
    "NULL_CHECK": null_check,
    "SET": membership,
    "ARITHMETIC": arithmetic,
    "TEMPORAL_ORDER": temporal_order,
    "DURATION": duration,
}


def condition(cond: Condition, negate: bool = False, schema: T.StructType | None = None) -> Column:
    """COND-8: any condition, as it is or negated."""
    if cond.get("type") not in BUILDERS:
        raise RuleError(f"Unsupported condition type: {cond.get('type')}")
    return BUILDERS[cond["type"]](cond, negate, schema)


def _parts(rule_type: str, conditions: Iterable[Condition]):
    found = list(conditions)
    if rule_type not in ALLOWED_CONDITIONS:
        raise RuleError(f"Unsupported rule type: {rule_type}")
    if not found:
        raise RuleError(f"{rule_type} needs at least one condition")
    for c in found:
        if c.get("type") not in ALLOWED_CONDITIONS[rule_type]:
            raise RuleError(f"{rule_type} takes no {c.get('type')} condition")
    if rule_type != "CONDITIONAL_DEPENDENCY":
        return [], found
    if any(c.get("role") not in ("IF", "THEN") for c in found):
        raise RuleError("Every condition of a dependency is either IF or THEN")
    ifs = [c for c in found if c["role"] == "IF"]
    thens = [c for c in found if c["role"] == "THEN"]
    if not ifs or not thens:
        raise RuleError("A dependency needs an IF and a THEN condition")
    return ifs, thens


def violation(
    rule_type: str, conditions: Iterable[Condition], schema: T.StructType | None = None
) -> Column:
    """RULE-1..3: true on rows that break the rule."""
    ifs, thens = _parts(rule_type, conditions)
    broken = any_of(condition(c, True, schema) for c in thens)
    return all_of([condition(c, False, schema) for c in ifs] + [broken]) if ifs else broken


def valid(
    rule_type: str, conditions: Iterable[Condition], schema: T.StructType | None = None
) -> Column:
    """True on rows that keep the rule; neither this nor violation() holds on unknowns."""
    ifs, thens = _parts(rule_type, conditions)
    kept = all_of(condition(c, False, schema) for c in thens)
    return any_of([condition(c, True, schema) for c in ifs] + [kept]) if ifs else kept


def columns_of(conditions: Iterable[Condition]) -> list[str]:
    """Columns a rule reads, in order of appearance."""
    names: list[str] = []
    for c in conditions:
        right = c.get("right")
        if isinstance(right, Mapping):
            right = right["value"] if right.get("type") == "column" else None
        names += [
            c.get("left"), c.get("column"), right, c.get("target"),
            c.get("start_column"), c.get("end_column"),
            *((c.get("expression") or {}).get("operands") or []),
        ]
    return list(dict.fromkeys(n for n in names if n))


# Conditions in the rules DataFrame: one flat struct, literals as JSON text.

_FLAT = (
    "role", "type", "left", "column", "operator", "target", "comparison_operator",
    "start_column", "end_column", "unit",
)


def to_struct(cond: Condition) -> dict[str, Any]:
    """A condition as a row of the rules DataFrame."""
    flat = {k: cond.get(k) for k in _FLAT}
    right, expression = cond.get("right"), cond.get("expression") or {}
    if isinstance(right, Mapping):
        flat["right_type"] = right["type"]
        is_column = right["type"] == "column"
        flat["right_value"] = right["value"] if is_column else json.dumps(right["value"])
    elif right is not None:
        flat["right_type"], flat["right_value"] = "column", right
    else:
        flat["right_type"] = flat["right_value"] = None
    flat["arith_operator"] = expression.get("operator")
    flat["operands"] = list(expression["operands"]) if expression else None
    values = cond.get("values")
    flat["values"] = [json.dumps(v) for v in values] if values is not None else None
    value = cond.get("value", cond.get("tolerance"))
    flat["value"] = float(value) if value is not None else None
    return flat


def from_struct(row: Mapping[str, Any]) -> dict[str, Any]:
    """The condition held by a row of the rules DataFrame."""
    cond = {k: row[k] for k in _FLAT if row[k] is not None}
    if row["right_type"] == "literal":
        cond["right"] = {"type": "literal", "value": json.loads(row["right_value"])}
    elif row["right_type"] == "column" and row["type"] == "TEMPORAL_ORDER":
        cond["right"] = row["right_value"]
    elif row["right_type"] == "column":
        cond["right"] = {"type": "column", "value": row["right_value"]}
    if row["arith_operator"] is not None:
        cond["expression"] = {
            "operator": row["arith_operator"], "operands": list(row["operands"]),
        }
    if row["values"] is not None:
        cond["values"] = [json.loads(v) for v in row["values"]]
    if row["value"] is not None:
        key = "tolerance" if row["type"] == "ARITHMETIC" else "value"
        cond[key] = row["value"]
    return cond
