"""The labelled benchmark on rows of our own: clean rows, one broken row per fault."""

import json

import pytest
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators import checks, evaluate
from plumbline.plans import flows
from plumbline.sources import labelled, tables

PERSON = schemas.struct(
    id=T.StringType(), birthdate=T.StringType(), gender=T.StringType(), first_name=T.StringType(),
    ethnicity=T.StringType(), race=T.StringType(), income=T.DoubleType(), visits=T.LongType(),
)


def person(i: int, **other) -> dict:
    row = {
        "id": f"{i:08d}-0000-4000-8000-{i:012d}",
        "birthdate": f"19{50 + i}-0{i % 9 + 1}-1{i % 9}",
        "gender": "MF"[i % 2],
        "first_name": ["Ada", "Bo", "Cy", "Dee"][i % 4],
        "ethnicity": ["a", "b"][i % 2],
        "race": ["white", "black", "asian"][i % 3],
        "income": 1000.5 * i,
        "visits": i,
    }
    clean = not other
    labels = {"_is_valid": clean, "_injected_fault": other.pop("fault", None), "_expected_violations": other.pop("expect", [])}
    return row | other | labels


FAULTS = [
    dict(id=None, fault="NULL_PRIMARY_KEY: no id", expect=[f"{checks.NOT_NULL}:id"]),
    dict(id=person(3)["id"], fault="DUPLICATE_PRIMARY_KEY: as row 3", expect=[f"{checks.UNIQUE}:id"]),
    dict(id="short", fault="INVALID_UUID_LENGTH", expect=[f"{checks.LENGTH}:id"]),
    dict(birthdate="  ", fault="BLANK_BIRTHDATE", expect=[f"{checks.NOT_NULL}:birthdate"]),
    dict(gender="X", fault="INVALID_GENDER", expect=[f"{checks.IN_SET}:gender"]),
    dict(income=-5.0, fault="NEGATIVE_INCOME", expect=[f"{checks.BETWEEN}:income"]),
]
EXPECTED = [
    ("columnValuesToBeNotNull", ["id"], {}),
    ("columnValuesToBeUnique", ["ID"], {}),
    ("columnValuesLengthToBeBetween", ["id"], {"minLength": 36, "maxLength": 36}),
    ("columnValuesToBeNotNull", ["birthdate"], {}),
    ("columnValuesToBeInSet", ["gender"], {"allowedValues": ["m", "f"]}),
    ("columnValuesToBeInSet", ["race"], {"allowedValues": ["white", "black", "asian", "native", "other"]}),
    ("columnValuesToBeInSet", ["ethnicity"], {"allowedValues": ["a", "b"]}),
    ("columnValuesToBeBetween", ["income"], {"minValue": 0.0}),
    ("columnValuesLengthToBeBetween", ["gender"], {"minLength": 2}),
]


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("people")
    rows = [person(i) for i in range(1, 25)] + [person(i + 5, **dict(f)) for i, f in enumerate(FAULTS)]
    rows[0].pop("_is_valid")
    (folder / "people.json").write_text(json.dumps({"records": rows}, indent=1))
    rules = [
        {"rule_type": t, "target_columns": c, "parameters": p, "category": "X", "reason": ""} for t, c, p in EXPECTED
    ]
    document = {"tables": {"people": {"table_name": "people", "expected_rules": rules}}}
    (folder / "rules.json").write_text(json.dumps(document, indent=1))
    records = labelled.read_records(spark, str(folder / "people.json"), PERSON)
    return records, labelled.read_expected(spark, str(folder / "rules.json"))


def test_reading_and_splitting(people):
    records, expected = people
    assert records.count() == 30 and expected.count() == len(EXPECTED)
    assert labelled.clean_rows(records).count() == 24 and labelled.defect_rows(records).count() == 6
    assert labelled.without_labels(records).columns == PERSON.fieldNames()
    first = expected.where("expected_index = 2").first()
    assert (first.params.min_length, first.params.max_length) == (36, 36)


def test_benchmark(people):
    records, expected = people
    scores, detection, overall = flows.labelled_benchmark({"people": records}, expected)
    s, d, o = scores.first(), detection.first(), overall.first()
    assert (d.clean_pass_rate, d.detection_rate, d.caught_defects) == (100.0, 100.0, 6)
    # The set of 'ethnicity' is not proposed: its name holds 'city'.
    assert (s.expected, s.found_expected) == (9, 7)
    assert s.recall == round(7 / 9 * 100, 2)
    assert s.precision == round(s.true_positives / s.generated * 100, 2)
    assert s.f1 == round(2 * s.precision * s.recall / (s.precision + s.recall), 2)
    assert o.status == "GOOD" and o.tables == 1
    rules = flows.record_rules(records, "people")
    missing = {(r.rule_type, r.target_columns[0]) for r in evaluate.missing_expected(rules, expected).collect()}
    assert missing == {(checks.IN_SET, "ethnicity"), (checks.LENGTH, "gender")}


def test_scenarios_name_the_first_two_rules_in_column_order(people):
    records, _ = people
    tested = evaluate.tested_rows(records, flows.record_rules(records, "people"))
    found = {r.fault.split(":")[0]: r for r in evaluate.scenarios(tested).collect()}
    assert len(found) == 6 and all(r.is_detected for r in found.values())
    assert found["DUPLICATE_PRIMARY_KEY"].detected_by[0] == f"{checks.UNIQUE}:id"
    assert found["INVALID_UUID_LENGTH"].detected_by == [f"{checks.LENGTH}:id"]
    assert found["INVALID_GENDER"].detected_by == [f"{checks.IN_SET}:gender"]
    assert all(r.found_all for r in evaluate.expected_violations(tested).collect())


def test_names_decide_what_records_hold(spark):
    rows = [("1.5", "3", "2020-01-01", "p1", "x", "v"), ("2.5", "4", "2020-01-02", "p2", "y", "w")]
    df = spark.createDataFrame(rows, "total_cost string, dispenses string, start_at string, patient string, city string, kind string")
    got = {r.column_name: r for r in flows.record_profile(df, "t").collect()}
    assert (got["total_cost"].type_class, got["total_cost"].min_num) == ("NUMBER", 1.5)
    assert (got["dispenses"].type_class, got["dispenses"].max_num) == ("INTEGER", 4.0)
    assert (got["start_at"].type_class, got["start_at"].min_length) == ("DATETIME", None)
    assert got["patient"].top_values == [] and got["city"].top_values == []
    assert len(got["kind"].top_values) == 2


def test_results_are_kept_per_table_and_run(spark, tmp_path, people):
    records, _ = people
    rules = flows.record_rules(records, "people")
    where = str(tmp_path / "runs")
    for run in ("one", "two"):
        tables.save_results(flows.rule_runs({"people": records, "other": records}, rules, run), where)
    kept = tables.read_table(spark, where)
    assert kept.groupBy("run_id").count().count() == 2
    assert {r.table_name for r in kept.select("table_name").distinct().collect()} == {"people"}
    assert set(kept.columns) == set(schemas.RULE_RUNS.fieldNames())


def test_reading_a_view(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert tables.read_table(spark, "three_rows").count() == 3


def test_preview_masks(spark):
    rows = [("123-45-6789", "S99912345", "me@x.org", "no at", "12 Road", "0123456789abc", "short", None)]
    df = spark.createDataFrame(rows, "ssn string, drivers string, email string, work_email string, address string, id string, customer_id string, passport string")
    got = tables.preview(df, 5).first()
    assert list(got) == [
        "***-**-6789", "S9*****45", "me*****@x.org", "no*****@***.com", "*** Đường bảo mật (Masked) ***",
        "01234...9abc", "short...hort", None,
    ]
    assert tables.preview(df, 5, masked=False).first().ssn == "123-45-6789"
