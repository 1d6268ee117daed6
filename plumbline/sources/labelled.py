"""SRC-2..5: labelled records and expected rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators.evaluate import valid_label


def read_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """SRC-2: labelled records, from JSON documents that hold them in ``records``.

    One document is parsed in one task; for large documents see `read_large_records`.
    """
    return (
        spark.read.schema(_document(record))
        .option("multiLine", True)
        .json(path)
        .select(F.inline("records"))
    )


_BAD = "_bad_record"


def _change(brackets: Column) -> Column:
    """How far a run of brackets goes up or down."""
    opened = F.length(F.translate(brackets, "]}", ""))
    return 2 * opened - F.length(brackets)


def _lowest(brackets: Column) -> Column:
    """The lowest level that a run of brackets reaches, from 0 on."""
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("low"))

    def step(held: Column, bracket: Column) -> Column:
        level = held.level + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(level.alias("level"), F.least(held.low, level).alias("low"))

    return F.aggregate(F.regexp_extract_all(brackets, F.lit(r"([\[\]{}])")), start, step, lambda held: held.low)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each closing brace, with the brackets outside of strings.

    ``brackets`` holds those of a piece whose block starts outside a string, and those of one whose
    block starts inside; ``quotes`` counts the quotes of the block up to the piece.
    """
    read = spark.read.option("lineSep", "}").text(path)
    named = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )
    # no escape reaches over a closing brace, so that the quotes of a piece can be told on their own
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    marks = F.regexp_replace(plain, r'[^"\[\]{}]', "")
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length(F.regexp_replace("marks", '[^"]', ""))
    counted = named.withColumn("marks", marks).withColumn(
        "quotes", F.coalesce(F.sum(quotes).over(before), F.lit(0)) + quotes
    )

    def outside(block_inside: int) -> Column:
        inside = (F.col("quotes") - quotes + block_inside) % 2 == 1
        whole = F.concat(F.when(inside, '"').otherwise(""), "marks", F.lit("}"))
        return F.regexp_replace(whole, r'"[^"]*("|$)', "")

    return counted.withColumn("brackets", F.array(outside(0), outside(1))).drop("marks")


def _blocks(leveled: DataFrame) -> DataFrame:
    """For each block of a file: whether it starts in a string, its level, the ends of items before."""
    counted = leveled.groupBy("file", "block").agg(
        F.max("quotes").alias("quotes"),
        *[F.max_by(f"level{side}", "at").alias(f"level{side}") for side in (0, 1)],
    )
    # levels at which pieces end, from which the ends of items follow once the start is known
    ends = [
        leveled.where(F.col("brackets")[side].endswith("}"))
        .groupBy("file", "block", F.col(f"level{side}").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("file", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias(f"ended{side}"))
        for side in (0, 1)
    ]
    for frame in ends:
        counted = counted.join(frame, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    chosen = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    scanned = scanned.select("file", "block", "inside", chosen("level").alias("by"), chosen("ended").alias("ended"))
    scanned = scanned.withColumn("start", F.coalesce(F.sum("by").over(before), F.lit(0)))
    n = F.coalesce(F.try_element_at("ended", 2 - F.col("start")), F.lit(0))
    scanned = scanned.withColumn("n", n)
    return scanned.select("file", "block", "inside", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("items"))


def read_large_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """SRC-2: labelled records from large JSON documents, each read by as many tasks as it has blocks.

    A file holds one document, an object with the array ``records``. Spark reads files in blocks
    cut at closing braces. Whether a brace stands in a string, and how deep, follows from the
    quotes and brackets before it: both are added up within blocks, for a block that starts in a
    string and for one that does not, and then over the few blocks of a file. Only the text of a
    record ever meets in one place.

    Elements of ``records`` that are null or no objects are left out, as is what is no JSON. A value
    of another type than its field is null. A document that breaks off gives the records before,
    and the last as if it ended there, if that is JSON. A compressed file is one block.
    """
    running = Window.partitionBy("file", "block").orderBy("at")
    leveled = _pieces(spark, path).select(
        "*", *[F.sum(_change(F.col("brackets")[side])).over(running).alias(f"level{side}") for side in (0, 1)]
    )
    placed = leveled.join(_blocks(leveled), ["file", "block"])
    brackets = F.col("brackets")[F.col("inside").cast("int")]
    level = F.col("start") + F.when(F.col("inside") == 0, F.col("level0")).otherwise(F.col("level1"))
    placed = placed.select(
        "file", "block", "at", "piece", "items", level.alias("level"),
        (level - _change(brackets) + _lowest(brackets)).alias("low"),
        (brackets.endswith("}") & (level == 2)).alias("ends"),
    )
    item = F.col("items") + F.sum(F.col("ends").cast("int")).over(running) - F.col("ends").cast("int")
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda p: F.concat(p.piece, F.lit("}"))
    )
    items = (
        placed.withColumn("item", item)
        .groupBy("file", "item")
        .agg(F.concat_ws("", text).alias("text"), F.min("low").alias("low"), F.bool_or("ends").alias("whole"))
        .where("whole")
    )
    # an item before which a member of the document begins tells which member that is
    raw = schemas.struct(records=T.ArrayType(T.StringType()))
    parsed = lambda begin: F.from_json(F.concat(F.lit(begin), "text", F.lit("]}")), raw).records
    first = F.col("item") == 0
    opening = F.when(first, parsed("")).otherwise(F.coalesce(parsed('{"":[{}'), parsed('{"":{"":{}')))
    turns = first | (F.col("low") <= 1)
    members = items.where(turns).select("file", "item", (F.size(opening) > 0).alias("opens"))
    after = Window.partitionBy("file").orderBy("item")
    spans = members.withColumn("until", F.lead("item").over(after)).where("opens")
    held = items.join(spans.select("file", F.col("item").alias("since"), "until"), "file").where(
        (F.col("item") >= F.col("since")) & (F.col("until").isNull() | (F.col("item") < F.col("until")))
    )
    text = (
        F.when(F.col("item") == F.col("since"), F.element_at(opening, -1))
        .when(F.col("text").rlike(r"^\s*,\s*\{"), F.regexp_replace("text", r"^\s*,\s*", ""))
        .otherwise(F.element_at(parsed('{"records":[0'), -1))
    )
    labels = schemas.labelled(record)
    found = F.from_json(text, T.StructType([*labels.fields, T.StructField(_BAD, T.StringType())]), {"columnNameOfCorruptRecord": _BAD})
    return held.select(found.alias("r")).where(F.col(f"r.{_BAD}").isNull() | F.get_json_object(f"r.{_BAD}", "$").isNotNull()).select(
        *[F.col("r").getField(f.name).alias(f.name) for f in labels.fields]
    )


def records_in(texts: DataFrame, text: str, record: T.StructType) -> DataFrame:
    """SRC-2: the same from a table with one JSON document per row."""
    parsed = F.from_json(text, _document(record))
    return texts.select(F.inline(parsed["records"]))


def _document(record: T.StructType) -> T.StructType:
    return schemas.struct(records=T.ArrayType(schemas.labelled(record)))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: expected rules, from a JSON document with a map of tables."""
    documents = (
        spark.read.schema(schemas.EXPECTED_DOCUMENT).option("multiLine", True).json(path)
    )
    return expected_rules(documents, F.col("tables"))


def expected_rules(documents: DataFrame, tables: Column) -> DataFrame:
    """SRC-3: one row per expected rule, numbered within its table."""
    per_table = documents.select(F.explode(tables).alias("table_name", "spec"))
    per_rule = per_table.select(
        "table_name", F.posexplode("spec.expected_rules").alias("expected_index", "rule")
    )
    given = F.col("rule.parameters")
    names = {
        "min_value": given.minValue,
        "max_value": given.maxValue,
        "min_length": given.minLength,
        "max_length": given.maxLength,
        "allowed_values": given.allowedValues,
    }
    params = F.struct(
        *[
            names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.PARAMS.fields
        ]
    )
    return per_rule.select(
        "table_name",
        "expected_index",
        "rule.rule_type",
        "rule.target_columns",
        params.alias("params"),
        "rule.category",
        "rule.reason",
    )


def clean_rows(records: DataFrame) -> DataFrame:
    """SRC-4: rows labelled clean, or not labelled."""
    return records.where(valid_label())


def defect_rows(records: DataFrame) -> DataFrame:
    """SRC-4: rows labelled broken."""
    return records.where(~valid_label())


def without_labels(records: DataFrame) -> DataFrame:
    """SRC-5: the record without its label columns."""
    return records.select([c for c in records.columns if not c.startswith("_")])
