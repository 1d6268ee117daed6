"""Contradicting and implied rules, against brute force over all subsets of small rule sets."""

import random
from itertools import combinations

import pytest

from plumbline import schemas
from plumbline.local import local_frame
from plumbline.operators import checks, rulegraph as G

DAY = 86_400_000_000


def order(i, a, op, b, table="t", confidence=1.0, kind="TEMPORAL_ORDER"):
    cond = {"type": kind, "left": a, "operator": op, "right_type": "column", "right_value": b}
    return {"rule_id": i, "table_name": table, "rule_type": "TEMPORAL", "target_columns": [a, b], "conditions": [cond], "confidence": confidence, "validation_status": "VALID"}


def duration(i, a, b, op, value, unit="DAY", table="t", confidence=1.0):
    cond = {"type": "DURATION", "start_column": a, "end_column": b, "operator": op, "value": value, "unit": unit}
    return {"rule_id": i, "table_name": table, "rule_type": "TEMPORAL", "target_columns": [a, b], "conditions": [cond], "confidence": confidence, "validation_status": "VALID"}


def dependency(i, *columns, table="t", confidence=1.0):
    return {"rule_id": i, "table_name": table, "rule_type": checks.DEPENDENCY, "target_columns": list(columns), "conditions": [], "confidence": confidence}


@pytest.fixture
def frame(spark):
    return lambda rules: local_frame(spark, rules, schemas.RULES).repartition(3)


def found(df):
    return {r.rule_id: set(r.partners) for r in G.contradictions(df).collect()}


def test_orders_that_go_round(frame):
    rules = [order("1", "a", "LT", "b"), order("2", "b", "BEFORE", "c"), order("3", "c", "LTE", "a"), order("4", "a", "LTE", "d"), order("5", "d", "LTE", "a")]
    assert found(frame(rules)) == {"1": {"2", "3"}, "2": {"1", "3"}, "3": {"1", "2"}}


def test_what_can_hold(frame):
    rules = [order("1", "a", "LTE", "b"), order("2", "b", "LTE", "a"), order("3", "a", "EQ", "b"), order("4", "a", "LT", "c"), order("5", "b", "LT", "c", kind="COMPARISON")]
    assert found(frame(rules)) == {} and found(frame([])) == {}


def test_durations(frame):
    rules = [
        duration("1", "a", "b", "LTE", 2.0), duration("2", "b", "c", "LTE", 24.0, "HOUR"), duration("3", "a", "c", "GTE", 3.5),
        duration("4", "a", "c", "LTE", 3.0), duration("5", "x", "y", "GTE", 1.0), duration("6", "x", "y", "LT", 1440.0, "MINUTE"),
        duration("7", "x", "y", "LTE", 1440.0, "MINUTE", table="other"),
    ]
    got = found(frame(rules))
    assert got == {"1": {"2", "3"}, "2": {"1", "3"}, "3": {"4"}, "4": {"3"}, "5": {"6"}, "6": {"5"}}


def test_itself_other_tables_and_other_rules(frame):
    rules = [order("1", "a", "LT", "a"), order("2", "a", "LT", "b"), order("3", "b", "LT", "a", table="u"), order("9", "a", "NEQ", "b")]
    rules[3]["conditions"][0]["role"] = "IF"
    rules += [{"rule_id": "4", "table_name": "t", "rule_type": checks.NOT_NULL, "target_columns": ["a"]}, dependency("5", "a", "b")]
    assert found(frame(rules)) == {"1": set()}
    warned = {r.rule_id: (r.validation_status, r.validation_message) for r in G.warn_of_contradictions(frame(rules)).collect()}
    assert warned["1"] == ("WARNING", "Contradicts itself") and warned["2"] == ("VALID", None) and len(warned) == 6


def holds(rules):
    """Whether some values satisfy all, by relaxing constraints to a fixed point."""
    edges = []
    for r in rules:
        c = r["conditions"][0]
        a, b = c["left"], c["right_value"]
        if c["operator"] in ("LT", "LTE", "EQ"):
            edges.append((b, a, -1 if c["operator"] == "LT" else 0))
        if c["operator"] == "EQ":
            edges.append((a, b, 0))
    at = {x: 0 for e in edges for x in e[:2]}
    for _ in range(len(at) + 1):
        changed = False
        for x, y, w in edges:
            if at[x] + w < at[y]:
                at[y], changed = at[x] + w, True
        if not changed:
            return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_random_rules(frame, seed):
    rng = random.Random(seed)
    rules = []
    for i in range(9):
        a, b = rng.sample("abcd", 2)
        rules.append(order(str(i), a, rng.choice(["LT", "LTE", "EQ"]), b, confidence=rng.choice([1.0, 0.9, None])))
    by_id = {r["rule_id"]: r for r in rules}
    got = found(frame(rules))
    assert bool(got) == (not holds(rules))
    for rule, partners in got.items():
        together = [by_id[i] for i in {rule, *partners}]
        assert not holds(together)
        assert all(holds(list(some)) for some in combinations(together, len(together) - 1))
    smallest = next((n for n in range(1, 10) for some in combinations(rules, n) if not holds(some)), None)
    if smallest:
        least = [s for s in combinations(rules, smallest) if not holds(s)]
        assert {r["rule_id"] for s in least for r in s} <= set(got)
    implied = {r.rule_id: r.implied_by for r in G.implied(frame(rules)).collect()}
    if got:
        assert implied == {}
    else:
        kept = [r for r in rules if r["rule_id"] not in implied]
        against = {"LT": ["LTE"], "LTE": ["LT"], "EQ": ["LT"]}
        for i in implied:  # the rest excludes the opposite of every rule left out
            c = by_id[i]["conditions"][0]
            for op in against[c["operator"]]:
                assert not holds([*kept, order("n", c["right_value"], op, c["left"])])
            if c["operator"] == "EQ":
                assert not holds([*kept, order("n", c["left"], "LT", c["right_value"])])
        for r in kept:  # and none of the rest follows from the others
            c, others = r["conditions"][0], [k for k in kept if k is not r]
            opposite = [order("n", c["right_value"], op, c["left"]) for op in against[c["operator"]]]
            if c["operator"] == "EQ":
                opposite.append(order("n", c["left"], "LT", c["right_value"]))
            assert any(holds([*others, o]) for o in opposite)


def test_implied_durations_and_dependencies(frame):
    rules = [
        duration("1", "a", "b", "LTE", 1.0), duration("2", "b", "c", "LTE", 1.0), duration("3", "a", "c", "LTE", 2.0), duration("4", "a", "c", "LTE", 1.5),
        dependency("d1", "a", "b"), dependency("d2", "b", "c"), dependency("d3", "a", "c", confidence=0.99),
        dependency("d4", "a", "x", "c", confidence=0.5), dependency("d5", "c", "x", "y"), dependency("d6", "y", "a", table="u"),
    ]
    got = {r.rule_id: r.implied_by for r in G.implied(frame(rules)).collect()}
    assert set(got) == {"3", "d3", "d4"} and got["d3"] == ["d1", "d2"] and got["3"] in (["4"], ["1", "2"])
    kept = {r.rule_id for r in G.without_implied(frame(rules)).collect()}
    assert kept | set(got) == {r["rule_id"] for r in rules} and not kept & set(got)


def walked(rules):
    """Partners and slack by trying, for every edge, the walks of tightest edges one by one."""
    edges = []
    for r in rules:
        c = r["conditions"][0]
        if c["type"] == "DURATION":
            edges.append((c["end_column"], c["start_column"], -int(c["value"]) * DAY, r["rule_id"]))
        else:
            edges.append((c["right_value"], c["left"], -1 if c["operator"] == "LT" else 0, r["rule_id"]))
            edges += [(c["left"], c["right_value"], 0, r["rule_id"])] if c["operator"] == "EQ" else []
    tight = {}
    for x, y, w, i in edges:
        tight[x, y] = min((w, i), tight.get((x, y), (w, i)))
    out = {}
    for x, y, w, i in edges:
        walks = [(w, (i,), (x,), y)]
        for n in range(4):
            closed = [k[:3] for k in walks if k[3] == x and k[0] < 0]
            if closed:
                total, path, columns = min(closed)
                if len(set(columns)) == len(columns):
                    out[i] = min((len(path), total, path), out.get(i, (len(path), total, path)))
                break
            walks = [(t + k, (*p, o), (*c, h), z) for t, p, c, h in walks for (a, z), (k, o) in tight.items() if a == h]
    return {i: (sorted(set(path) - {i}), total) for i, (_, total, path) in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_contradictions_of_many_tables_are_those_found_by_walking(frame, seed):
    rng = random.Random(seed)
    by_table = {}
    for t in [*(f"t{i}" for i in range(40)), None]:
        rules = by_table.setdefault(t, [])
        for i in range(rng.randint(1, 8)):
            a, b = rng.choices("abcd", k=2)
            own = {"table": t, "confidence": rng.random()}
            op = rng.choice(["LT", "LTE", "EQ", "GTE"])
            rules.append(duration(f"{t}_{i}", a, b, "GTE", float(rng.randint(0, 2)), **own) if op == "GTE" else order(f"{t}_{i}", a, op, b, **own))
    got = {r.rule_id: (r.partners, r.slack) for r in G.contradictions(frame([r for rs in by_table.values() for r in rs])).collect()}
    want = {}
    for rules in by_table.values():
        want.update(walked(rules))
    assert got == want and len(want) > 20


def test_tables_without_a_cycle_need_no_python(frame, monkeypatch):
    monkeypatch.setattr(G, "returns", lambda edges: 1 / 0)
    rules = [order(f"{t}{i}", a, "LT", b, table=str(t)) for t in range(3) for i, (a, b) in enumerate(["ab", "cb", "ad", "cb"])]
    assert found(frame(rules)) == {}


def test_implied_rules_take_time_in_proportion_to_the_rules(monkeypatch):
    import pyarrow as pa

    calls = []
    plain = G.shortest
    monkeypatch.setattr(G, "shortest", lambda *a: calls.append(1) or plain(*a))
    rng = random.Random(5)
    pairs = [tuple(sorted(rng.sample("abcdef", 2))) for _ in range(20_000)]
    group = pa.table({
        "table_name": ["t"] * len(pairs), "rule_id": [f"r{i:06}" for i in range(len(pairs))], "confidence": [1.0] * len(pairs),
        "x": [p[0] for p in pairs], "y": [p[1] for p in pairs], "w": [rng.randint(0, 3) for _ in pairs],
    })
    gone = G._implied(group)
    assert len(pairs) - 15 <= gone.num_rows < len(pairs) and len(calls) < 1000
