"""What a column is, judged from its type and its name."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: keyword lists and limits that decide which rules are proposed. ---

STRING_TYPE_WORDS = ["VARCHAR", "CHAR", "TEXT", "STRING"]

TEMPORAL_NAME_WORDS = ["date", "time", "timestamp", "birth", "death", "dob", "_at"]

UNIQUE_METRIC_WORDS = [
    "cost", "expense", "coverage", "income", "amount", "price", "revenue", "fee",
    "lat", "lon", "age", "weight", "height", "value", "count", "dispense", "total",
]
PERSON_NAME_WORDS = [
    "name", "first", "last", "middle", "maiden", "prefix", "suffix", "title",
]
IDENTIFIER_WORDS = [
    "uuid", "ssn", "driver", "license", "passport", "email", "phone", "key", "token",
    "serial",
]
SHORT_ID_LENGTH = 10

SET_KEY_NAMES = [
    "id", "payer", "patient", "provider", "encounter", "claim", "organization",
    "secondary_payer",
]
SET_KEY_WORDS = [
    "uuid", "ssn", "passport", "driver", "first_name", "last_name", "maiden", "address",
]
SET_PLACE_WORDS = ["county", "fips", "city", "zip", "street"]
SET_TEXT_NAMES = ["name", "code", "system", "prefix", "suffix", "transfer_type"]
SET_TEXT_WORDS = [
    "description", "note", "comment", "diagnosis", "reaction", "procedure_code",
    "bodysite", "sop_code", "modality",
]
SET_METRIC_WORDS = [
    "cost", "expense", "coverage", "income", "amount", "lat", "lon", "price",
]
UUID_LENGTH = 36

RECORD_MONEY_WORDS = ["cost", "expenses", "coverage", "income", "lat", "lon"]
RECORD_COUNT_NAME = "dispenses"
RECORD_TIME_WORDS = ["date", "time", "start_at", "stop_at"]
RECORD_SET_SKIP_WORDS = [
    "patient", "encounter", "payer", "ssn", "drivers", "passport", "first_name",
    "last_name", "address", "city",
]

PII_WORDS = ["ssn", "drivers", "passport", "email", "address", "phone", "customer_id"]

UNIQUE_THRESHOLD = 0.99
MAX_SET_SIZE = 20

# --- end of fixed values ---


def has_any(text: Column, words: Iterable[str]) -> Column:
    """True where the text contains one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words))


def name_has(name: Column, words: Iterable[str]) -> Column:
    return has_any(F.lower(name), words)


def is_pii_name(name: Column) -> Column:
    """FN-2: a column whose name says it holds personal data."""
    return name_has(name, PII_WORDS)


def is_id_name(name: Column) -> Column:
    low = F.lower(name)
    return (
        (low == "id")
        | low.endswith("_id")
        | low.startswith("id_")
        | (low.endswith("id") & (F.length(low) <= SHORT_ID_LENGTH))
    )


def type_class(data_type: T.DataType) -> str:
    """PROF-13: normal form of a Spark type."""
    if isinstance(data_type, T.IntegralType):
        return "INTEGER"
    if isinstance(data_type, T.NumericType):
        return "NUMBER"
    if isinstance(data_type, T.DateType):
        return "DATE"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    return "OTHER"


def type_class_of_text(type_text: Column) -> Column:
    """PROF-13 for profiles that come with type names instead of Spark types."""
    t = F.upper(type_text)
    return (
        F.when(t.contains("UUID"), "UUID")
        .when(t.contains("BOOL") | (t == "BIT"), "BOOLEAN")
        .when(has_any(t, STRING_TYPE_WORDS), "STRING")
        .when(t.contains("TIME"), "DATETIME")
        .when(t.contains("DATE") | t.contains("YEAR"), "DATE")
        .when(has_any(t, ["NUMERIC", "DECIMAL", "FLOAT", "DOUBLE", "NUMBER", "REAL"]), "NUMBER")
        .when(t.contains("INT"), "INTEGER")
        .otherwise("OTHER")
    )


def is_numeric_class(cls: Column) -> Column:
    return cls.isin("INTEGER", "NUMBER")


def is_temporal_class(cls: Column) -> Column:
    return cls.isin("DATE", "DATETIME")
