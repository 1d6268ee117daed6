"""Profiles against plain Python, and rules proposed from them."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks, evaluate, mine, profile, recommend
from plumbline.operators import rules as rule_ops
from plumbline.plans import flows

LONG = ["first " * 40, "second " * 40, "third " * 40]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (
            i,
            ["", None, "x", "y", "x"][i % 5],
            LONG[i % 3],
            f"{'pad ' * 30}{i}",
            i / 4 if i % 7 else None,
            i % 2 == 0,
            [i],
        )
        for i in range(200)
    ]
    schema = "`odd.name` int, `it's` string, story string, page string, amount double, flag boolean, parts array<int>"
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("blank_is_null", [True, False])
def test_counts_and_values(mixed, blank_is_null):
    rows, df = mixed
    got = {r.column_name: r for r in profile.profile(df, "t", blank_is_null=blank_is_null).collect()}
    assert [got[c].ordinal for c in df.columns] == list(range(7))
    for i, c in enumerate(df.columns[:-1]):
        values = [r[i] for r in rows if r[i] is not None and not (blank_is_null and r[i] == "")]
        assert (got[c].null_count, got[c].distinct_count) == (200 - len(values), len(set(values)))
        assert got[c].distinct_ratio_nonnull == len(set(values)) / len(values)
    assert got["parts"].null_count == 0 and got["parts"].distinct_count is None
    texts = Counter(r[1] for r in rows if r[1] is not None and not (blank_is_null and r[1] == ""))
    want = sorted(((-n, v) for v, n in texts.items()))
    assert [(-v["count"], v["value"]) for v in got["it's"].top_values] == want
    assert {v["value"] for v in got["story"].top_values} == set(LONG)
    assert got["page"].top_values == [] and got["page"].distinct_count == 200
    assert (got["amount"].min_num, got["amount"].max_num) == (0.25, 199 / 4)


def test_twenty_and_twenty_one_values(spark):
    df = spark.range(2100).selectExpr("concat('v', id % 20) AS a", "concat('v', id % 21) AS b", "id % 20 AS c")
    for approx in (False, True):
        got = {r.column_name: r for r in profile.profile(df, "t", approx=approx).collect()}
        assert [len(got[c].top_values) for c in "abc"] == [20, 0, 20]
        assert [got[c].distinct_count for c in "abc"] == [20, 21, 20]


def test_empty_and_all_null_tables(spark):
    for df in (spark.createDataFrame([], "a int, b string"), spark.createDataFrame([(None, None)] * 3, "a int, b string")):
        got = profile.profile(df, "t").collect()
        assert [r.distinct_count for r in got] == [0, 0]
        assert [r.min_num for r in got] == [None, None]
        rules = recommend.recommend(profile.profile(df, "t"))
        assert rules.count() == 0


def test_nan_is_no_number(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    row = profile.profile(df, "t").first()
    assert (row.min_num, row.max_num, row.mean, row.null_count, row.distinct_count) == (1.0, 2.0, 1.5, 1, 3)


def test_table_without_columns(spark):
    empty = profile.profile(spark.createDataFrame([], T.StructType()), "t")
    assert empty.count() == 0 and recommend.recommend(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_rules_of_a_table_hold_on_it(spark, seed):
    """Random tables of all types with nulls, NaN and odd characters."""
    rng = random.Random(seed)
    pick = lambda make: None if rng.random() < 0.1 else make()
    words = ["a", "Ä ß", "é" * 70, "it's", "tab\tend", "日本", "x|y", "0", "-1.5", "NaN"]
    size = rng.choice([1, 19, 60])
    rows = [
        (
            i,
            pick(lambda: rng.choice(words)),
            pick(lambda: f"k{rng.randint(0, 10**6)}"),
            pick(lambda: rng.choice([1.5, -0.0, 0.0, float("nan"), 1e300, 3.25])),
            pick(lambda: rng.randint(-(2**62), 2**62)),
            pick(lambda: rng.random() < 0.5),
            pick(lambda: Decimal(rng.randint(-(10**6), 10**6)).scaleb(-2)),
            pick(lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 900))),
        )
        for i in range(size)
    ]
    schema = "row_id bigint, word string, `a key` string, x double, big bigint, flag boolean, price decimal(12,2), day date"
    df = spark.createDataFrame(rows, schema)
    rules = recommend.recommend(profile.profile(df, "t", primary_keys=["row_id"]))
    ran = {r.rule_id: r for r in rule_ops.run_rules(df, rules).collect()}
    assert len(ran) == rules.count() > 8
    for r in rules.collect():
        if r.rule_type != checks.UNIQUE or r.confidence == 1.0:
            assert ran[r.rule_id].violations == 0, r


def test_blanks_are_missing_in_profiles_but_break_sets_and_lengths(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "kind string")
    profiled = profile.profile(df, "t")
    assert profiled.first().null_count == 2
    rules = {r.rule_type: r.asDict(True) for r in recommend.recommend(profiled).collect()}
    assert set(rules) == {checks.IN_SET, checks.LENGTH}
    ran = {r.rule_type: r.violations for r in rule_ops.run_rules(df, rules.values()).collect()}
    assert ran == {checks.IN_SET: 1, checks.LENGTH: 1}


def test_wide_table(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(120)])
    got = {r.column_name: r.distinct_count for r in profile.profile(df, "t").collect()}
    assert got == {f"c{i}": min(50, i + 1) for i in range(120)}


def test_one_value_in_most_rows(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k")
    row = profile.profile(df, "t").first()
    assert row.distinct_count == 20001


def column_profile(name, kind, cls, pk=False, nulls=0, distinct=0, low=None, high=None, lengths=(None, None), tops=()):
    return {
        "table_name": "orders", "ordinal": 0, "column_name": name, "data_type": kind, "type_class": cls,
        "is_primary_key": pk, "is_foreign_key": False, "nullable": nulls > 0 or not pk, "row_count": 1000,
        "null_count": nulls, "null_ratio": nulls / 1000, "distinct_count": distinct,
        "distinct_ratio": distinct / 1000, "distinct_ratio_nonnull": None, "min_num": low, "max_num": high,
        "min_str": None, "max_str": None, "min_length": lengths[0], "max_length": lengths[1], "mean": None,
        "stddev": None, "top_values": [{"value": v, "count": n, "percentage": n / 10} for v, n in tops],
    }


def test_rules_of_a_supplied_profile(spark):
    statuses = [("SHIPPED", 500), ("COMPLETED", 250), ("PENDING", 200), ("CANCELLED", 50)]
    supplied = local_frame(
        spark,
        [
            column_profile("order_id", "VARCHAR(64)", "STRING", True, 0, 1000, lengths=(10, 10)),
            column_profile("total_amount", "NUMERIC(12,2)", "NUMBER", distinct=850, low=100.0, high=50000.0),
            column_profile("order_status", "VARCHAR(20)", "STRING", distinct=4, lengths=(6, 9), tops=statuses),
            column_profile("notes", "TEXT", "STRING", nulls=450, distinct=300),
        ],
        schemas.PROFILE,
    )
    rules = [r.asDict(True) for r in recommend.recommend(supplied).collect()]
    by = lambda kind: {r["target_columns"][0]: r for r in rules if r["rule_type"] == kind}
    assert set(by(checks.NOT_NULL)) == {"order_id", "total_amount", "order_status"}
    assert set(by(checks.UNIQUE)) == {"order_id"}
    between = by(checks.BETWEEN)
    assert set(between) == {"total_amount"}
    assert (between["total_amount"]["params"]["min_value"], between["total_amount"]["params"]["max_value"]) == (100.0, 50000.0)
    assert by(checks.IN_SET)["order_status"]["params"]["allowed_values"] == [v for v, _ in statuses]
    assert set(by(checks.IN_SET)) == {"order_status"}
    lengths = by(checks.LENGTH)
    assert {c: (r["params"]["min_length"], r["params"]["max_length"]) for c, r in lengths.items()} == {"order_id": (10, 10), "order_status": (6, 9)}
    assert by(checks.NOT_NULL)["order_id"]["confidence"] == 1.0
    assert by(checks.NOT_NULL)["total_amount"]["confidence"] == 0.95
    assert not by(checks.ROW_COUNT)
    count = recommend.row_count(supplied).first()
    assert (count.params.min_value, count.params.max_value, count.confidence) == (800.0, 1500.0, 0.85)
    assert len({r["rule_id"] for r in rules}) == len(rules)
    again = {r.rule_id for r in recommend.recommend(supplied).collect()}
    assert again == {r["rule_id"] for r in rules}


def test_profile_supplied_with_gaps(spark):
    rows = [
        ("t", "id", "uuid", True, 100, 0, 100), ("t", "seen_at", "timestamp", False, 98, 2, 50),
        ("t", "bare", "varchar(9)", False, None, None, None),
    ]
    given = spark.createDataFrame(rows, "table_name string, column_name string, data_type string, is_primary_key boolean, row_count bigint, null_count bigint, distinct_count bigint")
    got = {r.column_name: r for r in profile.supplied(given).collect()}
    assert [f.name for f in schemas.PROFILE.fields] == profile.supplied(given).columns
    assert (got["id"].type_class, got["id"].distinct_ratio, got["id"].nullable) == ("UUID", 1.0, False)
    assert (got["bare"].row_count, got["bare"].null_ratio) == (0, 0.0)
    rules = {(r.rule_type, r.target_columns[0]) for r in recommend.recommend(profile.supplied(given)).collect()}
    assert rules == {(checks.NOT_NULL, "id"), (checks.UNIQUE, "id")}


def test_type_names(spark):
    from plumbline.functions import naming

    want = {
        "varchar(20)": "STRING", "bigint": "INTEGER", "double precision": "NUMBER", "date": "DATE",
        "timestamp with time zone": "DATETIME", "boolean": "BOOLEAN", "uuid": "UUID", "text": "STRING",
        "numeric(14,2)": "NUMBER", "bit": "BOOLEAN", "smallint": "INTEGER", "jsonb": "OTHER",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.c for r in df.withColumn("c", naming.type_class_of_text(F.col("t"))).collect()} == want
    assert naming.type_class(T.ArrayType(T.StringType())) == "OTHER"


def test_own_recommender(spark, mixed):
    """Any function from a profile to rules joins in."""

    def never_negative(profiled):
        found = profiled.where("min_num >= 0")
        return recommend.as_rules(
            found, checks.BETWEEN, F.array("column_name"), 0.8, F.lit("never negative"),
            params_=recommend.params(min_value=F.lit(0.0)),
        )

    profiled = profile.profile(mixed[1], "t")
    rules = recommend.recommend(profiled, (*recommend.BASIC, never_negative))
    assert {r.target_columns[0] for r in rules.where("reason = 'never negative'").collect()} == {"odd.name", "amount"}


def test_mined_rules_can_be_run(spark):
    rows = [
        (i, ["open", "done", "held"][i % 3], (i % 10) + 1.0, (i % 4) + 1.0, ((i % 10) + 1.0) * ((i % 4) + 1.0), None if i % 3 == 0 else f"2024-01-{i % 28 + 1:02d}")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "order_no int, status string, units double, each double, net double, closed string")
    df = df.withColumn("start_day", F.to_date(F.lit("2024-01-01"))).withColumn("end_day", F.to_date("closed")).drop("closed")
    profiled = profile.profile(df, "jobs", primary_keys=["order_no"])
    mined = flows.mine_rules(df, "jobs", profiled)
    found = {r.reason: r for r in mined.collect()}
    assert "net = each MULTIPLY units" in found
    assert "IF status = open THEN end_day IS_NULL" in found
    assert "IF status = done THEN end_day IS_NOT_NULL" in found
    assert "start_day BEFORE_EQUAL end_day" in found
    ran = {r.rule_id: r for r in rule_ops.run_rules(df, mined).collect()}
    for r in found.values():
        if r.confidence == 1.0:
            assert ran[r.rule_id].violations == 0
    assert set(ran) == {r.rule_id for r in found.values()}


def test_column_groups_leave_no_column_out(spark):
    cols = [column_profile("job_status", "string", "STRING", distinct=3)]
    cols += [column_profile(f"part{i}", "string", "STRING", nulls=10, distinct=500) for i in range(7)]
    cols += [column_profile("end_date", "date", "DATE", nulls=10, distinct=500)]
    cols += [column_profile("start_date", "date", "DATE", distinct=500), column_profile("email", "string", "STRING", nulls=5)]
    rows = [c | {"ordinal": i} for i, c in enumerate(cols)]
    got = mine.column_groups(local_frame(spark, rows, schemas.PROFILE)).collect()
    conditional = [r.target_columns for r in got if r.rule_type == "CONDITIONAL_DEPENDENCY"]
    assert sorted(map(len, conditional)) == [3, 4, 4]
    assert all(g[0] == "job_status" for g in conditional)
    assert sorted(c for g in conditional for c in g[1:]) == sorted([f"part{i}" for i in range(7)] + ["end_date"])
    assert any(g[1] == "end_date" for g in conditional)
    assert [r.target_columns for r in got if r.rule_type == "TEMPORAL"] == [["start_date", "end_date"]]


def test_dependencies(spark):
    rows = [(i % 12, i % 4, "abc"[i % 3], None if i % 12 == 5 else i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int")
    got = {(r.determinant, r.dependent) for r in mine.dependencies(df, ["a", "b", "c", "d"]).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d")}
    rules = mine.dependency_rules(df, "t", ["a", "b", "c", "d"], 0.0)
    ran = {r.rule_id: r for r in rule_ops.run_rules(df, rules).collect()}
    for r in rules.collect():
        a, b = r.target_columns
        assert (ran[r.rule_id].violations == 0) == ((a, b) in got)
        bad = rule_ops.violating_rows(df, r.asDict(True))
        assert bad.columns == df.columns and bad.count() == ran[r.rule_id].violations


def test_dependencies_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(mine, "AGGREGATES_PER_SCAN", 12)
    df = spark.range(300).select(*[(F.col("id") % m).alias(f"m{m}") for m in (2, 3, 4, 6, 12)])
    got = {(r.determinant, r.dependent) for r in mine.dependencies(df, df.columns).collect()}
    names = {f"m{m}": m for m in (2, 3, 4, 6, 12)}
    assert got == {(a, b) for a, x in names.items() for b, y in names.items() if a != b and x % y == 0}


def test_safety_of_proposed_rules(spark, mixed):
    profiled = profile.profile(mixed[1], "t")
    row = evaluate.safety(recommend.recommend(profiled), profiled).first()
    assert row.is_safe and row.invalid_columns == 0


def test_histogram(spark):
    rows = [(float(i), None if i % 3 else 5, 7) for i in range(101)]
    rows += [(100.0, 6, 7), (float("nan"), None, 7)]
    df = spark.createDataFrame(rows, "a double, `b.c` int, same int")
    got = {(r.column_name, r.bin): r for r in profile.histogram(df).collect()}
    assert [got["a", b]["count"] for b in range(5)] == [20, 20, 20, 20, 22]
    assert [got["a", b].label for b in range(5)] == ["0 - 20", "20 - 40", "40 - 60", "60 - 80", "80 - 100"]
    assert [got["b.c", b]["count"] for b in range(5)] == [34, 0, 0, 0, 1]
    assert got["b.c", 1].label == "5.2 - 5.4"
    assert len(got) == 10 and got["a", 0].percentage == 20 * 100.0 / 103


def test_first_of_a_group_is_cut_before_the_shuffle(spark, sf_dir):
    from queries import QUERIES

    plan = QUERIES["rt_dedupe_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_values_of_columns_with_few_repeats_are_dealt_to_tasks(spark, monkeypatch):
    rows = [(i, f"name {i // 2}", i % 100 if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, name string, few int")
    dealt = []
    counted = profile.value_frequencies
    monkeypatch.setattr(profile, "VALUES_PER_TASK", 1000)
    monkeypatch.setattr(
        profile, "value_frequencies", lambda d, names, *a, **k: dealt.append((sorted(names), k.get("tasks"))) or counted(d, names, *a, **k)
    )
    got = {r.column_name: (r.distinct_count, r.null_count) for r in profile.profile(df, "t").collect()}
    assert got == {"id": (3000, 0), "name": (1500, 0), "few": (100, sum(r[2] is None for r in rows))}
    assert ["few"] in [names for names, tasks in dealt if not tasks]
    assert [(names, tasks >= 4) for names, tasks in dealt if tasks] == [(["id", "name"], True)]
    assert "REPARTITION_BY_NUM" in counted(df, ["name"], tasks=4)._jdf.queryExecution().toString()
