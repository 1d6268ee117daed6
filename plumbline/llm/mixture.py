"""Mixing sources to target weights by the cube method of balanced sampling.

Each source gets a target number of words; each of its documents is taken the whole part of
target / size of the source times, and once more with the fraction as its probability. The cube
method rounds the fractions: it moves them along directions in which neither the number of
documents nor the number of words taken changes, until each is 0 or 1. In the flight phase, one
document after another moves, and all others of its group move the least that makes up for it.
Long documents go first, so that the two or so that are left are short. The landing phase takes
those of them that bring the words nearest to the target. Where a document goes is drawn once by
its fraction; as bounds are met on the way, the chances of the last and shortest few of a group
may end a tenth off their fractions, while long documents keep theirs.

Sources are dealt into groups of about 4096 documents that fly apart; what is left of them flies
again, level by level, until each source is one group. Reruns agree: chance comes from hashes.

Words: maximal runs of characters other than space and \\x09-\\x0D.

Defined cases: null and empty texts have the size 0 and take nothing, but count as documents. A
null source is a source of its own, the last. Repeated rows each take their own part. Sources
without words have the target 0. Further columns are ignored by `mixture` and kept by `mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrows import beside, checkpointed, free_name, quoted, told_apart

WEIGHTS = (1, 2, 3)
MOST = 3  # times that a source, and so a document, may be taken
GROUP_ROWS = 4096
_NEAR = 1e-9
_LANDING = 8  # documents of which all choices are compared


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size), a row per source with its weight and target.

    Sources in the order of their code points, null last, weigh the given weights, repeating. All
    sizes are shared by weight; a target stops at `most` times its source's size, and what it
    leaves is shared again.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = ordered.rdd.zipWithIndex().map(lambda r: (*r[0], weights[r[1] % n]))
    weighed = checkpointed(spark.createDataFrame(ranked, "source string, source_size bigint, weight bigint"))
    share = 0.0
    full = F.lit(False)
    stopped = -1
    while True:
        own = F.when(~full, F.col("weight"))
        left = F.when(~full, F.col("source_size") * 0).otherwise(F.col("source_size") * most)
        row = weighed.agg(F.sum("source_size"), F.sum(left), F.sum(own), F.count(F.when(full, 1))).first()
        if not row[0] or not row[2] or row[3] == stopped:
            break
        stopped = row[3]
        share = (row[0] - row[1]) / row[2]
        full = F.col("weight") * share > F.col("source_size") * most
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(float(share)))
    return weighed.select("source", "source_size", "weight", full.alias("full"), target.alias("target"))


def _step(chance: np.ndarray, way: np.ndarray, forward: bool) -> np.ndarray:
    """Chances moved along or against a direction until one is 0 or 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room_up = np.where(way > 0, (1 - chance) / way, np.where(way < 0, -chance / way, np.inf))
        room_down = np.where(way > 0, chance / way, np.where(way < 0, (chance - 1) / way, np.inf))
    step = room_up.min() if forward else -room_down.min()
    moved = chance + step * way
    at = int((room_up if forward else room_down).argmin())
    moved[at] = float((way[at] > 0) == forward)
    return np.where(moved < _NEAR, 0.0, np.where(moved > 1 - _NEAR, 1.0, moved))


def flight(size: np.ndarray, chance: np.ndarray, draw: np.ndarray, land: bool) -> np.ndarray:
    """Chances of documents, longest first, moved to 0 or 1: all but a few, or all when they land.

    The numbers in `draw`, one for each document, seed the random moves. Every move of the flight keeps the sum of chances and the sum of chance * size.
    """
    chance = np.where(chance < _NEAR, 0.0, np.where(chance > 1 - _NEAR, 1.0, chance))
    chances = np.random.default_rng((draw * (1 << 40)).astype(np.uint64))
    stuck = []
    moving, forward = -1, False
    while True:
        held = np.flatnonzero((chance > 0) & (chance < 1))
        held = held[~np.isin(held, stuck)] if stuck else held
        if len(held) < 2:
            break
        first, rest = held[0], held[1:]
        if first != moving:  # where it goes is drawn once, so that a long document gets there
            moving, forward = first, chances.random() < chance[first]
        gap = size[rest] - size[rest].mean()
        spread = float(gap @ gap)
        own = float(size[first] - size[rest].mean())
        if spread > 0 and len(rest) > 1:
            way = np.concatenate(([1.0], -(1.0 / len(rest) + own * gap / spread)))
        elif own == 0:
            way = np.concatenate(([1.0], np.full(len(rest), -1.0 / len(rest))))
        else:  # nothing among the rest makes up for its words
            stuck.append(first)
            continue
        chance[held] = _step(chance[held], way, forward)
    if land:
        held = np.flatnonzero((chance > 0) & (chance < 1))
        while len(held) > _LANDING:
            pair = held[:2]
            chance[pair] = _step(chance[pair], np.array([1.0, -1.0]), chances.random() < chance[pair[0]])
            held = held[(chance[held] > 0) & (chance[held] < 1)]
        ways = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
        off = ways - chance[held]
        chance[held] = ways[np.lexsort((abs(off.sum(axis=1)), abs(off @ size[held])))[0]]
    return chance


def _flown(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("draw", "ascending"), ("id", "ascending")])
    draw = table.column("draw").to_numpy()
    land = table.column("groups")[0].as_py() == 1
    chance = flight(table.column("size").to_numpy().astype(float), table.column("chance").to_numpy(), draw, land)
    return table.set_column(table.column_names.index("chance"), "chance", pa.array(chance, pa.float64()))


def _taken(rows: DataFrame, weights: tuple[int, ...], most: int, seed: int, group_rows: int) -> DataFrame:
    """Rows (id, mark, source, size) with source_size, target and copies."""
    rows = rows.withColumn("key", F.xxhash64(*told_apart(F.col("source"))))
    rows = checkpointed(rows)
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = sizes.count()
    aims = targets(sizes, weights, most)
    aims = aims.withColumn("key", F.xxhash64(*told_apart(F.col("source")))).drop("source", "weight")
    ratio = F.when(F.col("full"), F.lit(float(most))).when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    ).otherwise(F.lit(0.0))
    whole = F.floor(ratio + _NEAR)
    draw = F.pmod(F.xxhash64("id", "size", "mark", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    state = beside(rows, checkpointed(aims), "key", n).select(
        "id", "mark", "key", "size", "source_size", "target",
        whole.alias("whole"),
        F.greatest(ratio - whole, F.lit(0.0)).alias("chance"),
        draw.alias("draw"),
    )
    state = checkpointed(state.select("*", F.lit(0).cast("bigint").alias("groups")))
    done = []
    level = 0
    while True:
        open_rows = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(state.where(~open_rows))
        flying = state.where(open_rows)
        groups = checkpointed(
            flying.groupBy("key").agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("bigint").alias("groups"))
        )
        if groups.isEmpty():
            break
        group = F.pmod(F.xxhash64("id", "size", "mark", F.lit(seed + 1 + level)), F.col("groups")).alias("group")
        flying = beside(flying.drop("groups"), groups, "key", n).withColumn("group", group)
        kind = flying.schema
        state = checkpointed(flying.groupBy("key", "group").applyInArrow(_flown, kind).drop("group"))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.col("chance")).cast("bigint")
    return out.select("id", "mark", "size", "source_size", "target", copies.alias("copies"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """A row per document: id, size, source_size, target (of its source), copies, taken (words)."""
    rows = docs.select(
        F.col(quoted(id)).alias("id"),
        F.xxhash64(*told_apart(F.col(quoted(text)), F.col(quoted(source)))).alias("mark"),
        F.col(quoted(source)).cast("string").alias("source"),
        words_of(F.col(quoted(text))).alias("size"),
    )
    out = _taken(rows, weights, most, seed, group_rows)
    return out.select(
        F.col("id").alias(id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    group_rows: int = GROUP_ROWS,
    copies: str = "copies",
) -> DataFrame:
    """The documents that are taken, with all their columns and how often each is taken.

    Rows are found again by id and a hash of the text; equal rows are told apart by their number.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, inner))
    rows = docs.toDF(*inner)
    mark = F.xxhash64(*told_apart(F.col(of[text]), F.col(of[source]))).alias("mark")
    taken = _taken(
        rows.select(
            F.col(of[id]).alias("id"), mark, F.col(of[source]).cast("string").alias("source"), words_of(F.col(of[text])).alias("size")
        ),
        weights, most, seed, group_rows,
    )
    number = lambda order: F.row_number().over(Window.partitionBy("key", "mark").orderBy(order)).alias("number")
    key = lambda column: F.xxhash64(*told_apart(F.col(column))).alias("key")
    taken = taken.select(key("id"), "mark", "copies").select("key", "mark", "copies", number("copies"))
    rows = rows.select("*", key(of[id]), mark).select("*", number("key"))
    joined = rows.join(taken, ["key", "mark", "number"]).where("copies > 0")
    return joined.select(*inner, "copies").toDF(*docs.columns, free_name(docs.columns, copies))
