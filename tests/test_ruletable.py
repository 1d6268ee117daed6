"""Rule tables: validation, conflicts, reviews, on small tables and on hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks, evaluate, ruletable


def rule(rule_id, rule_type=checks.BETWEEN, columns=("a",), table="t", **other):
    params = {f.name: None for f in schemas.PARAMS.fields} | other.pop("params", {})
    row = {f.name: None for f in schemas.RULES.fields}
    return row | {
        "rule_id": rule_id, "table_name": table, "rule_type": rule_type, "engine": "BASIC",
        "target_columns": list(columns), "params": params, "conditions": [], "confidence": 0.9,
        "validation_status": "VALID", "status": "DRAFT",
    } | other


def table_of(spark, rows):
    return local_frame(spark, rows, schemas.RULES)


def test_conflicts_are_those_of_all_pairs(spark, few_hot_keys):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        hot = i % 3 == 0
        low = rng.choice([None, rng.randint(0, 30)])
        high = rng.choice([None, (low or 0) + rng.randint(0, 40)])
        group = "hot" if hot else f"c{rng.randint(0, 25)}"
        rows.append(rule(f"r{i}", columns=(group,), params={"min_value": low and float(low), "max_value": high and float(high)}))
    inf = float("inf")
    bounds = {
        r["rule_id"]: (
            r["target_columns"][0],
            -inf if r["params"]["min_value"] is None else r["params"]["min_value"],
            inf if r["params"]["max_value"] is None else r["params"]["max_value"],
        )
        for r in rows
    }
    want = {
        a
        for a, (ga, la, ha) in bounds.items()
        if any(ga == gb and (ha < lb or la > hb) for gb, lb, hb in bounds.values())
    }
    got = {r.rule_id: r.conflicts_with for r in ruletable.conflicts(table_of(spark, rows)).collect()}
    assert set(got) == want and want
    for a, b in got.items():
        (ga, la, ha), (gb, lb, hb) = bounds[a], bounds[b]
        assert ga == gb and (ha < lb or la > hb)


def test_validate_and_messages(spark):
    rules = table_of(
        spark,
        [
            rule("ok", params={"min_value": 0.0, "max_value": 1.0}),
            rule("clash", params={"min_value": 5.0, "max_value": 9.0}),
            rule("ghost", columns=("z", "y"), params={"min_value": 0.0}),
            rule("text", columns=("b",), params={"min_value": 0.0}),
            rule("order", "TEMPORAL", columns=("a", "d")),
        ],
    )
    columns = spark.createDataFrame(
        [("t", "a", "NUMBER"), ("t", "b", "STRING"), ("t", "d", "DATE")], "table_name string, column_name string, type_class string"
    )
    got = {r.rule_id: (r.validation_status, r.validation_message) for r in ruletable.validate(rules, columns).collect()}
    assert got["ok"][0] == got["clash"][0] == "WARNING"
    assert got["ghost"] == ("INVALID", "Unknown target column: y; Unknown target column: z")
    assert got["text"] == ("INVALID", "Column b must be a number or a time")
    assert got["order"] == ("INVALID", "Column a must be a time")


def test_reviews_keep_the_last_edit(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    params = {f.name: None for f in schemas.PARAMS.fields}
    edit = params | {"min_value": 7.0}
    review = lambda i, action, m, p=None: {"rule_id": i, "action": action, "edited_params": p, "comment": None, "reviewed_at": at(m)}
    reviews = local_frame(
        spark,
        [
            review("a", "EDITED", 1, edit), review("a", "ACCEPTED", 2), review("b", "ACCEPTED", 1, edit),
            review("b", "REJECTED", 3), review("c", "EDITED", 1), review("unknown", "ACCEPTED", 1),
        ],
        schemas.REVIEWS,
    )
    rules = table_of(spark, [rule(i, params={"min_value": 1.0}) for i in "abcd"])
    got = {r.rule_id: r for r in ruletable.apply_reviews(rules, reviews).collect()}
    assert {i: r.status for i, r in got.items()} == {"a": "ACCEPTED", "b": "REJECTED", "c": "EDITED", "d": "DRAFT"}
    assert got["a"].edited_params.min_value == 7.0 and got["b"].edited_params is None and got["c"].edited_params is None
    reviewed = ruletable.apply_reviews(rules, reviews)
    assert {r.rule_id for r in ruletable.publishable(reviewed).collect()} == {"a", "c"}
    assert [r.rule_id for r in ruletable.publishable(reviewed, ["c", "d"]).collect()] == ["c"]
    rates = {r.engine: r for r in evaluate.review_rates(reviewed).collect()}
    assert (rates[None].total_reviewed, rates[None].accept_rate) == (3, 1 / 3)


def test_classify_on_a_hot_key(spark, few_hot_keys):
    old = [rule("o1", params={"min_value": 1.0}), rule("o2", columns=("b",)), rule("o3", columns=("b",))]
    new = [rule(f"h{i}", params={"min_value": 1.0}) for i in range(40)]
    new += [rule(f"d{i}", columns=(f"c{i}",)) for i in range(40)]
    new += [rule("near", params={"min_value": 2.0}), rule("same", columns=("b",))]
    got = ruletable.classify(table_of(spark, new), table_of(spark, old))
    assert got.columns == [f.name for f in schemas.RULES.fields] + ["classification"]
    kinds = {r.rule_id: r.classification for r in got.collect()}
    assert len(kinds) == 82
    assert {kinds[f"h{i}"] for i in range(40)} == {"DUPLICATE"} and kinds["same"] == "DUPLICATE"
    assert {kinds[f"d{i}"] for i in range(40)} == {"NEW"} and kinds["near"] == "POSSIBLE_CONFLICT"


def test_matches_on_hot_proposals(spark, few_hot_keys):
    sets = [["a", "b", "c"], ["A", "x"], [], ["b", "c", "d", "e", "f"]]
    proposed = [rule(f"p{i}", checks.IN_SET, ("K",), params={"allowed_values": sets[i % 4]}) for i in range(60)]
    proposed += [rule(f"l{i}", checks.LENGTH, ("k",), params={"min_length": i % 3, "max_length": 5}) for i in range(30)]
    wanted = [
        rule("e0", checks.IN_SET, ("k",), params={"allowed_values": ["C", "D", "E"]}),
        rule("e1", checks.IN_SET, ("k",), params={"allowed_values": ["a", "b", "c", "q"]}),
        rule("e2", checks.LENGTH, ("K",), params={"min_length": 1}),
        rule("e3", checks.LENGTH, ("K",), params={"max_length": 5}),
    ]
    expected = table_of(spark, wanted).withColumn("expected_index", F.substring("rule_id", 2, 9).cast("int"))
    got = {r.rule_id: r.expected_index for r in evaluate.matches(table_of(spark, proposed), expected).collect()}
    want = {}
    for i in range(60):
        mine = {v.lower() for v in sets[i % 4]}
        for j, theirs in ((0, {"c", "d", "e"}), (1, {"a", "b", "c", "q"})):
            if mine and len(mine & theirs) >= 0.7 * min(len(mine), len(theirs)):
                want[f"p{i}"] = j
                break
    want |= {f"l{i}": 2 if i % 3 == 1 else 3 for i in range(30)}
    assert got == want


def test_confidence_and_dedupe(spark):
    rules = table_of(
        spark,
        [rule("a", confidence=0.9), rule("b", confidence=0.95), rule("c", columns=("b", "a")), rule("d", columns=("a", "b"), confidence=0.7)],
    )
    assert [r.rule_id for r in ruletable.by_confidence(rules, "rule_id").collect()] == ["b", "a", "c", "d"]
    assert {r.rule_id for r in ruletable.dedupe_groups(rules, F.desc("confidence")).collect()} == {"b", "c"}
    assert {r.rule_id for r in ruletable.confident(rules).collect()} == {"a", "b", "c"}
    bands = [r[0] for r in rules.select(ruletable.confidence_band(F.col("confidence"))).distinct().collect()]
    assert set(bands) == {"SHOW", "LOW"}
