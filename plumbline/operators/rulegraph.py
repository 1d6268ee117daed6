"""Rules of one table taken together: contradictions, and rules that follow from others.

A rule on the order of two columns, or on the time between them, is a difference constraint
``y - x <= w``: an edge from x to y of that weight, in microseconds. A strict order has weight -1,
which is the least difference of two times and tells it from equality for all other values. Edges
that return to their start with a negative total cannot hold together.

Rules with one unconditional condition between two columns take part; others are left alone. For
contradictions the tightest edges of a table are gathered, one for each pair of its columns; for
implied rules all of its rules, in time linear in them.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks

# Executors need no copy of this module for the functions that run there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MICROS = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000}
ORDERS = {
    "LT": ("LT",), "BEFORE": ("LT",), "LTE": ("LTE",), "BEFORE_EQUAL": ("LTE",), "GT": ("GT",), "AFTER": ("GT",),
    "GTE": ("GTE",), "AFTER_EQUAL": ("GTE",), "EQ": ("LTE", "GTE"),
}

Edge = tuple[str, str, int]


def edges(rules: DataFrame) -> DataFrame:
    """(table_name, rule_id, confidence, x, y, w): a row for each constraint y - x <= w of a rule."""
    # An outer explode, as no filter on its result goes below it: a condition that is built from other
    # columns is then built once, not for every mention of a field of it.
    c = F.col("c")
    one = F.explode_outer(F.when(F.size("conditions") == 1, F.col("conditions")))
    single = rules.select("table_name", "rule_id", "confidence", one.alias("c")).where(c["role"].isNull())
    between = F.when(c["type"] == "DURATION", F.struct(c["start_column"].alias("a"), c["end_column"].alias("b"))).when(
        c["type"].isin("COMPARISON", "TEMPORAL_ORDER") & (c["right_type"] == "column"),
        F.struct(c["left"].alias("a"), c["right_value"].alias("b")),
    )
    kinds = F.create_map(*[v for k, o in ORDERS.items() for v in (F.lit(k), F.array(*map(F.lit, o)))])
    micros = F.create_map(*[F.lit(v) for kv in MICROS.items() for v in kv])
    listed = single.select(
        "table_name",
        "rule_id",
        "confidence",
        between.alias("of"),
        F.explode(kinds[c["operator"]]).alias("kind"),
        # b - a is compared with a duration, a with b
        F.when(c["type"] == "DURATION", F.round(c["value"].cast("double") * micros[c["unit"]]).cast("bigint")).alias("v"),
    ).where("of.a is not null and of.b is not null")
    listed = listed.select("table_name", "rule_id", "confidence", "of.a", "of.b", "kind", "v")
    # upper bound on b - a: edge a -> b; lower bound: edge b -> a
    upper = F.when(F.col("v").isNotNull(), F.col("kind").isin("LT", "LTE")).otherwise(F.col("kind").isin("GT", "GTE"))
    bound = F.coalesce(F.when(upper, F.col("v")).otherwise(-F.col("v")), F.lit(0))
    strict = F.col("kind").isin("LT", "GT").cast("bigint")
    return listed.select(
        "table_name",
        "rule_id",
        "confidence",
        F.when(upper, F.col("a")).otherwise(F.col("b")).alias("x"),
        F.when(upper, F.col("b")).otherwise(F.col("a")).alias("y"),
        (bound - strict).alias("w"),
    )


def _components(pairs: Iterable[tuple[str, str]]) -> dict[str, int]:
    """The strongly connected component of each column."""
    out, back = defaultdict(set), defaultdict(set)
    for x, y in pairs:
        out[x].add(y)
        back[y].add(x)

    def reach(start: str, step: dict) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for y in step[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    label: dict[str, int] = {}
    for x in sorted({*out, *back}):
        if x not in label:
            label.update(dict.fromkeys(reach(x, out) & reach(x, back), len(label)))
    return label


def returns(edges: Iterable[tuple[str, str, int, int, str]]) -> dict[tuple[str, str], list[tuple[int, tuple, bool]]]:
    """Ways back, of a table's tightest edges (x, y, w, loosest w between the two, rule).

    For each pair (x, y) that is on a negative cycle, the walks from y to x: total, rules and whether
    no column recurs. They are ordered by their number of edges, each is the smallest of that many by
    total, then by rule ids, and only those are listed whose total is below all before. So a rule
    between x and y contradicts by the first whose total added to its own is negative.
    """
    edges = list(edges)
    label = _components((x, y) for x, y, *_ in edges)
    edges = [e for e in edges if label[e[0]] == label[e[1]]]
    if all(w >= 0 for _, _, w, _, _ in edges):
        return {}
    tight: dict[str, list] = defaultdict(list)
    into: dict[str, list] = defaultdict(list)
    for x, y, w, loosest, rule in edges:
        tight[x].append((y, w, rule))
        into[y].append((x, w, loosest))
    n = len(tight)
    found: dict[tuple[str, str], list] = defaultdict(list)
    for y, asked in into.items():
        at: dict[str, tuple] = {y: (0, (), ())}
        for _ in range(n):
            left = []
            for x, w, loosest in asked:
                known = found.get((x, y))
                if x in at and w + at[x][0] < 0 and (not known or at[x][0] < known[-1][0]):
                    total, path, columns = at[x]
                    found[x, y].append((total, path, len({x, *columns}) == 1 + len(columns)))
                    known = found[x, y]
                if not known or loosest + known[-1][0] >= 0:
                    left.append((x, w, loosest))
            asked = left
            if not asked:
                break
            step: dict[str, tuple] = {}
            for v, (total, path, columns) in at.items():
                for z, weight, other in tight[v]:
                    new = (total + weight, (*path, other), (*columns, v))
                    if z not in step or new[:2] < step[z][:2]:
                        step[z] = new
            at = step
    return found


_RETURNS = "table_name string, x string, y string, ways array<struct<total bigint, path array<string>, simple boolean>>"
_IMPLIED = "table_name string, rule_id string, implied_by array<string>"
_TEXTS = pa.list_(pa.string())
_ARROW = {"table_name": pa.string(), "rule_id": pa.string(), "implied_by": _TEXTS}
_WAY = pa.struct([("total", pa.int64()), ("path", _TEXTS), ("simple", pa.bool_())])
_ARROW_RETURNS = pa.schema([("table_name", pa.string()), ("x", pa.string()), ("y", pa.string()), ("ways", pa.list_(_WAY))])


def _table(rows: list[tuple], *names: str) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table({n: pa.array(list(c), _ARROW[n]) for n, c in zip(names, columns)})


def _returns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``returns`` of many tables, a row each."""
    for batch in batches:
        rows = []
        for table, listed in zip(*(c.to_pylist() for c in batch.columns)):
            for (x, y), ways in returns(tuple(e.values()) for e in listed).items():
                rows.append({"table_name": table, "x": x, "y": y, "ways": [dict(zip(("total", "path", "simple"), w)) for w in ways]})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RETURNS)


def _ways_back(found: DataFrame) -> DataFrame:
    """(table_name, x, y, ways) of the pairs of columns on negative cycles, from the tightest edge
    between two columns each; ties go to the first rule."""
    tight = F.min(F.struct("w", "rule_id"))
    pairs = found.groupBy("table_name", "x", "y").agg(tight.alias("tight"), F.max("w").alias("loosest"))
    edge = F.struct("x", "y", F.col("tight.w").alias("w"), "loosest", F.col("tight.rule_id").alias("rule_id"))
    tables = pairs.groupBy("table_name").agg(F.collect_list(edge).alias("edges"), F.min("tight.w").alias("least"))
    # most tables have no column that one edge enters and another leaves, and need no Python
    cyclic = tables.where(F.arrays_overlap("edges.x", "edges.y") & (F.col("least") < 0))
    return cyclic.select("table_name", "edges").mapInArrow(_returns, _RETURNS)


def contradictions(rules: DataFrame) -> DataFrame:
    """RT-13: rules that cannot hold together with others: table_name, rule_id, partners, slack.

    ``partners`` are the other rules of the smallest contradiction that the rule is part of: the set
    can hold if any one of them is given up. ``slack`` is its (negative) total in microseconds. A
    rule whose smallest contradiction is one of others only is not named; it comes up once that is
    mended. A rule that contradicts itself has no partners.

    The smallest contradiction of a rule begins with it and goes on by the tightest edges, of which
    there is one for each pair of columns. Only these are gathered by table; the ways back found from
    them are joined to the rules.
    """
    found = edges(rules)
    ways = _ways_back(found).withColumnsRenamed({"table_name": "_table", "x": "_x", "y": "_y"})
    own = F.col("table_name").eqNullSafe(F.col("_table")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    first = F.get(F.filter("ways", lambda way: way["total"] + F.col("w") < 0), F.lit(0))
    closed = found.join(ways, own).select("table_name", "rule_id", "w", first.alias("way")).where("way.simple")
    # no part of it would do alone; of the edges of a rule, that with the fewest rules counts
    smallest = F.min(F.struct(F.size("way.path").alias("n"), (F.col("w") + F.col("way.total")).alias("slack"), "way.path"))
    partners = F.array_sort(F.array_except("best.path", F.array("rule_id")))
    return (
        closed.groupBy("table_name", "rule_id")
        .agg(smallest.alias("best"))
        .select("table_name", "rule_id", partners.alias("partners"), "best.slack")
    )


def warn_of_contradictions(rules: DataFrame) -> DataFrame:
    """The rules, with WARNING and the partners for those that contradict others; INVALID stays."""
    found = contradictions(rules).select("rule_id", F.array_join("partners", ", ").alias("_partners"))
    told = F.when(F.col("_partners") == "", "Contradicts itself").otherwise(
        F.concat(F.lit("Cannot hold together with "), F.col("_partners"))
    )
    warned = F.col("_partners").isNotNull() & ~F.col("validation_status").eqNullSafe("INVALID")
    return (
        rules.join(found, "rule_id", "left")
        .withColumn("validation_message", F.when(warned, told).otherwise(F.col("validation_message")))
        .withColumn("validation_status", F.when(warned, "WARNING").otherwise(F.col("validation_status")))
        .select(*rules.columns)
    )


# Implied rules ----------------------------------------------------------------------------


def shortest(start: str, edges_of: dict[str, dict[str, tuple[int, str]]], n: int) -> dict[str, tuple[int, tuple]]:
    """The smallest total of walks of n edges at most from a column to every other, and their rules."""
    best = {start: (0, ())}
    front = dict(best)
    for _ in range(n):
        step: dict[str, tuple] = {}
        for v, (total, path) in front.items():
            for z, (w, rule) in edges_of.get(v, {}).items():
                new = (total + w, (*path, rule))
                if (z not in best or new[0] < best[z][0]) and (z not in step or new < step[z]):
                    step[z] = new
        best.update(step)
        front = step
        if not step:
            break
    return best


def _order_of_tests(confidence: dict[str, float | None]) -> list[str]:
    """The least confident first, and of equals the last by id."""
    known = {i: -1.0 if c is None or c != c else c for i, c in confidence.items()}
    return sorted(sorted(known, reverse=True), key=known.get)


class _Kept:
    """The edges of the rules still kept, and the tightest of them between two columns."""

    def __init__(self, by_rule: dict[str, list[Edge]]):
        listed: dict[tuple[str, str], set] = defaultdict(set)
        for rule, own in by_rule.items():
            for x, y, w in own:
                listed[x, y].add((w, rule))
        # the loosest first, so that the tightest can be taken from the end
        self.listed = {pair: sorted(own, reverse=True) for pair, own in listed.items()}
        self.rules = set(by_rule)
        self.n = len({c for pair in listed for c in pair})
        self.tightest: dict[str, dict[str, tuple[int, str]]] = defaultdict(dict)
        for (x, y), own in self.listed.items():
            self.tightest[x][y] = own[-1]
        self.found: dict[str, dict] = {}  # shortest walks, until the tightest edges change

    def shortest(self, start: str, without: str, pairs: Iterable[tuple[str, str]]) -> dict[str, tuple[int, tuple]]:
        """The shortest walks that do without a rule, which has edges between the pairs given."""
        graph = None
        for x, y in pairs:
            if self.tightest[x].get(y, (0, None))[1] == without:
                if graph is None:
                    graph = {k: dict(v) for k, v in self.tightest.items()}
                other = next((e for e in reversed(self.listed[x, y]) if e[1] != without and e[1] in self.rules), None)
                if other is None:
                    del graph[x][y]
                else:
                    graph[x][y] = other
        if graph is not None:
            return shortest(start, graph, self.n)
        if start not in self.found:
            self.found[start] = shortest(start, self.tightest, self.n)
        return self.found[start]

    def drop(self, rule: str, pairs: Iterable[tuple[str, str]]) -> None:
        self.rules.remove(rule)
        for x, y in pairs:
            own = self.listed[x, y]
            if own and own[-1][1] == rule:
                while own and own[-1][1] not in self.rules:
                    own.pop()
                self.found.clear()
                if own:
                    self.tightest[x][y] = own[-1]
                else:
                    del self.tightest[x][y]


def _implied(group: pa.Table) -> pa.Table:
    """Rules are tested from the least confident on; one that follows from those still kept goes."""
    by_rule: dict[str, list[Edge]] = defaultdict(list)
    confidence: dict[str, float | None] = {}
    for r in group.select(["rule_id", "x", "y", "w", "confidence"]).to_batches():
        for rule, x, y, w, sure in zip(*(c.to_pylist() for c in r.columns)):
            by_rule[rule].append((x, y, w))
            confidence[rule] = sure
    kept = _Kept(by_rule)
    table = group.column("table_name")[0].as_py()
    out = []
    for rule in _order_of_tests(confidence):
        witness: set[str] = set()
        pairs = {(x, y) for x, y, _ in by_rule[rule]}
        for x, y, w in by_rule[rule]:
            found = kept.shortest(x, rule, pairs).get(y)
            if found is None or found[0] > w:
                break
            witness.update(found[1])
        else:
            kept.drop(rule, pairs)
            out.append((table, rule, sorted(witness)))
    return _table(out, "table_name", "rule_id", "implied_by")


def _implied_dependencies(group: pa.Table) -> pa.Table:
    """Dependencies that the closure of the determinant under those still kept gives as well."""
    rules = group.to_pylist()
    kept = {r["rule_id"]: (frozenset(r["columns"][:-1]), r["columns"][-1]) for r in rules}
    out = []
    for rule in _order_of_tests({r["rule_id"]: r["confidence"] for r in rules}):
        determinant, dependent = kept[rule]
        closure, used, grown = set(determinant), [], True
        while grown and dependent not in closure:
            grown = False
            for other, (x, c) in sorted(kept.items()):
                if other != rule and x <= closure and c not in closure:
                    closure.add(c)
                    used.append(other)
                    grown = True
        if dependent in closure:
            # only those that the dependent needs
            need, witness = {dependent}, []
            for other in reversed(used):
                if kept[other][1] in need:
                    need |= kept[other][0]
                    witness.append(other)
            del kept[rule]
            out.append((rules[0]["table_name"], rule, sorted(witness)))
    return _table(out, "table_name", "rule_id", "implied_by")


def implied(rules: DataFrame) -> DataFrame:
    """RT-9: rules on order, durations and dependencies that follow from the other rules of their
    table: table_name, rule_id, implied_by.

    The rest implies the whole: rules are taken out one by one, the least confident first and of
    equals the last by id, each because rules that were kept until then imply it; these may be taken
    out later for others that do. Tables whose order rules contradict each other lose none of them.
    """
    ordered = edges(rules)
    odd = contradictions(rules).select("table_name").distinct()
    sound = ordered.join(odd, ordered["table_name"].eqNullSafe(odd["table_name"]), "left_anti")
    orders = sound.groupBy("table_name").applyInArrow(_implied, _IMPLIED)
    found = rules.where((F.col("rule_type") == checks.DEPENDENCY) & (F.size("target_columns") > 1))
    found = found.select("table_name", "rule_id", "confidence", F.col("target_columns").alias("columns"))
    return orders.unionByName(found.groupBy("table_name").applyInArrow(_implied_dependencies, _IMPLIED))


def without_implied(rules: DataFrame) -> DataFrame:
    """RT-9: the rules that remain."""
    return rules.join(implied(rules).select("rule_id"), "rule_id", "left_anti").select(*rules.columns)
