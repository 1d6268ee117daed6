"""Large JSON documents, read in blocks."""

import json
import random

import pytest
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.sources import labelled

RECORD = schemas.struct(id=T.LongType(), note=T.StringType(), parts=T.ArrayType(T.LongType()))
ODD = ['}', '{', '"', '\\', '\\"}', '],[', '"records":[{', "", "é}\n", "a,b", "}}}", '\\\\"']


def record(draw: random.Random, i: int) -> dict:
    made = {"id": i, "note": "".join(draw.choices(ODD, k=draw.randint(0, 4))), "parts": [1] * draw.randint(0, 3)}
    if draw.random() < 0.3:
        made["more"] = {"a": [{"b": {}}, {"records": [{"id": -1}]}], "}": draw.choice(ODD)}
    if draw.random() < 0.3:
        made["_is_valid"] = draw.random() < 0.5
    return made


def document(draw: random.Random, n: int) -> dict:
    other = {
        "meta": {"a": {"b": 1}, "c": [{}, {"d": "}"}], "e": 2}, "x": [{"id": -2}, {"id": -3}, 4], "s": "]}", "n": None,
        "deep": {"records": [{"id": -4}, {"id": -5}]}, "list": [[{"id": -6}], 1],
    }
    keys = draw.sample(sorted(other), draw.randint(0, len(other)))
    members = [(k, other[k]) for k in keys] + [("records", [record(draw, i) for i in range(n)])]
    draw.shuffle(members)
    return dict(members)


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(found) -> list[tuple]:
    return sorted(((r.id, r.note, tuple(r.parts or ()), r._is_valid) for r in found.collect()), key=str)


def test_records_of_documents_in_many_blocks(spark, tmp_path, small_blocks):
    draw = random.Random(3)
    wanted = []
    for k in range(24):
        made = document(draw, draw.choice([0, 1, 2, 30]))
        text = json.dumps(made, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        (tmp_path / f"{k}.json").write_text(text + "\n" * (k % 2), encoding="utf-8")
        wanted += [(r["id"], r["note"], tuple(r["parts"]), r.get("_is_valid")) for r in made["records"]]
    found = labelled.read_large_records(spark, str(tmp_path), RECORD)
    assert rows_of(found) == sorted(wanted, key=str)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_same_as_documents_in_one_task(spark, tmp_path, small_blocks):
    (tmp_path / "a.json").write_text(json.dumps({"records": [record(random.Random(i), i) for i in range(50)]}))
    large, whole = (f(spark, str(tmp_path), RECORD) for f in (labelled.read_large_records, labelled.read_records))
    assert large.schema == whole.schema
    assert sorted(map(str, large.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("", []), ("{}", []), ('{"records": []}', []), ('{"records": null}', []), ('{"records": [{}]}', [None]),
        ('{"records": [null, {"id": 1}, 5, {"id": 2}, null]}', [1, 2]), ('{"records": [{"id": 1}, {"id": 2}, {"id"', [1, 2]),
        ('{"records": [{"id": "x"}, {"id": 2}], "z": [{"id": 3}]}', [None, 2]),
    ],
)
def test_odd_documents(spark, tmp_path, text, ids):
    (tmp_path / "a.json").write_text(text)
    found = labelled.read_large_records(spark, str(tmp_path), RECORD)
    assert sorted((r.id for r in found.collect()), key=str) == sorted(ids, key=str)
