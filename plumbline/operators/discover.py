"""Structure that tables have without having declared it: keys, dependencies, references.

Searches go level by level over sets of columns, as a set can only be of interest if none of its
subsets is already enough. Every level has two steps.

1. One scan samples the groups of all its sets. A group, the rows with one value of the set, is in
   the sample if the hash of its value is among the SAMPLE smallest; so all its rows are, wherever
   they stand, and what the group shows is exact: how many rows it has, and which other columns differ
   within it. A repeat refutes a key, and a difference a dependency, for certain; where some are
   allowed, the estimate must be DEVIATIONS standard errors too high. Nothing is shuffled but the
   samples, which are merged in two steps.
2. The sets left are counted exactly, on 128-bit hashes of their values. Tasks drop what repeats in a
   chunk of rows and deal the rest to buckets by hash, as blocks of many hashes; a bucket is of bounded
   size, and its distinct hashes are counted by sorting. Of dependencies, the rows to remove within
   each chunk are added up first: together they are at most those of the table, so that the sum
   refutes for certain, and only pairs that it leaves are grouped.

What is reported is exact. Only results per set, which are schema-sized, come to the driver.

A null is no value: a set of columns is looked at on the rows where all of them are present. Columns
with a value in fewer than two rows, and of types that have no equality, are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain, combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.local import local_frame, side_by_side
from plumbline.operators import checks
from plumbline.operators.mine import _mined
from plumbline.operators.predicates import column

# Executors need no copy of this module for the functions that run there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 1024  # groups of each set of columns
DEVIATIONS = 6
SAMPLE_BYTES = 64 << 20  # of all sets of a scan, in each task
MERGED_AT_ONCE = 256
SETS_PER_PASS = 32
SAMPLED_ROWS = 1 << 15  # looked at together
CHUNK_ROWS = 1 << 18  # whose repeats are dropped before they are dealt out
CELLS = 1 << 21  # of pairs of values that are counted in an array
CODES = 1 << 40
BUCKET_ROWS = 1 << 20
# Entries of a theta sketch, as a power of two; its standard error is 1 / sqrt of them.
SKETCH_LOG = 12

Columns = frozenset

KEYS = schemas.struct(columns=T.ArrayType(schemas.S), rows=schemas.L, distinct=schemas.L, repeats=schemas.L, kind=schemas.S)
DEPENDENCIES = schemas.struct(
    determinant=T.ArrayType(schemas.S), dependent=schemas.S, n_values=schemas.L, support=schemas.L, removals=schemas.L
)


def _has_equality(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has_equality(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_has_equality(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType, T.NullType))


def _hashes(names: Sequence[str], wanted: Iterable[str]) -> list[Column]:
    """Two hashes of the values of each column, null for columns that are not wanted."""
    wanted = set(wanted)
    value = lambda c, *first: F.when(column(c).isNotNull(), F.xxhash64(*first, column(c)))
    one = lambda i, c: value(c).alias(f"c{i}") if c in wanted else F.lit(None).cast("bigint").alias(f"c{i}")
    two = lambda i, c: value(c, F.lit("second")).alias(f"d{i}") if c in wanted else F.lit(None).cast("bigint").alias(f"d{i}")
    return [one(i, c) for i, c in enumerate(names)] + [two(i, c) for i, c in enumerate(names)]


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple[np.ndarray, np.ndarray | None]]]:
    """Batches put together to so many rows: the values of each column, and where it has one, None for everywhere."""
    held, rows = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += len(batch)
        if rows and (batch is None or rows >= size):
            columns = pa.Table.from_batches(held).columns
            yield [
                (c.fill_null(0).to_numpy(), c.is_valid().to_numpy().astype(bool)) if c.null_count else (c.to_numpy(), None)
                for c in columns
            ]
            held, rows = [], 0


def _words(columns: Sequence[tuple[np.ndarray, np.ndarray | None]]) -> list[np.ndarray]:
    """The hashes of columns, each times a number of its own: the hash of a set is the sum of its columns'."""
    weights = np.random.default_rng(1).integers(0, 1 << 63, len(columns), np.uint64) * np.uint64(2) + np.uint64(1)
    return [v.view(np.uint64) * w for (v, _), w in zip(columns, weights)]


def _present(columns: Sequence[tuple[np.ndarray, np.ndarray | None]], own: Iterable[int]) -> np.ndarray | None:
    """Rows in which all these columns have a value, None for all rows."""
    valid = [columns[c][1] for c in own if columns[c][1] is not None]
    return reduce(np.logical_and, valid) if valid else None


def _chosen(values: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
    return values if rows is None else values[rows]


class _Sample:
    """The groups of a set of columns whose hashes are smallest, with their rows and, for each column
    of the table, the smallest and largest hash of its values."""

    def __init__(self, rows: int, hashes: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.hashes, self.n, self.low, self.high = rows, hashes, n, low, high

    def with_(self, rows: int, hashes: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Sample:
        """Rows or groups added; one at the SAMPLE-th hash or above is no longer in the sample."""
        rows += self.rows
        if len(self.hashes) >= SAMPLE:
            near = hashes <= self.hashes[-1]
            hashes, n, low, high = hashes[near], n[near], low[near], high[near]
            if not len(hashes):
                return _Sample(rows, self.hashes, self.n, self.low, self.high)
        hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else [])
        if len(start) > SAMPLE:
            order, hashes, start = order[: start[SAMPLE]], hashes[: start[SAMPLE]], start[:SAMPLE]
        if not len(start):
            return _Sample(rows, hashes, self.n, self.low, self.high)
        n, low, high = (np.concatenate((a, b))[order] for a, b in ((self.n, n), (self.low, low), (self.high, high)))
        return _Sample(
            rows, hashes[start], np.add.reduceat(n, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        )

    def with_rows(
        self, hashes: np.ndarray, columns: Sequence[tuple[np.ndarray, np.ndarray | None]], own: Sequence[int]
    ) -> _Sample:
        """Rows added, of the hashes of this set and the columns of the table."""
        present = _present(columns, own)
        rows = len(hashes) if present is None else int(np.count_nonzero(present))
        if len(self.hashes) >= SAMPLE:
            near = hashes <= self.hashes[-1]
            at = np.flatnonzero(near if present is None else near & present)
        else:
            at = np.arange(len(hashes)) if present is None else np.flatnonzero(present)
        hashes = hashes[at]
        if len(self.hashes) and len(at):
            group = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            old = self.hashes[group] == hashes
            self._widen(group[old], at[old], columns, own)
            at, hashes = at[~old], hashes[~old]
        distinct = np.unique(hashes)
        if len(distinct) > SAMPLE:
            near = hashes <= distinct[SAMPLE - 1]
            at, hashes = at[near], hashes[near]
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        side = lambda none: np.stack(
            [v[at] if valid is None else np.where(valid[at], v[at], none) for v, valid in columns], axis=1
        )
        return self.with_(rows, hashes, np.ones(len(at), np.int64), side(most), side(least))

    def _widen(
        self, group: np.ndarray, at: np.ndarray, columns: Sequence[tuple[np.ndarray, np.ndarray | None]], own: Sequence[int]
    ) -> None:
        """Rows of known groups added. Of a column that differs in a group, two of its values are enough."""
        self.n += np.bincount(group, minlength=len(self.n))
        same = self.low >= self.high
        same[:, list(own)] = False
        live = same.any(axis=1)[group]
        group, at = group[live], at[live]
        for c in np.flatnonzero(same.any(axis=0)):
            v, valid = columns[c]
            open_ = same[group, c] if valid is None else same[group, c] & valid[at]
            g, x = group[open_], v[at[open_]]
            low, high = self.low[:, c], self.high[:, c]
            first = (low > high)[g]
            low[g[first]] = x[first]
            high[g[first]] = low[g[first]]
            differs = x != low[g]
            g = g[differs]
            high[g] = x[differs]
            low[g], high[g] = np.minimum(low[g], high[g]), np.maximum(low[g], high[g])

    def row(self, number: int) -> dict:
        return {"set": number, "rows": self.rows, **{k: getattr(self, k).tobytes() for k in ("hashes", "n", "low", "high")}}

    @staticmethod
    def empty(width: int) -> _Sample:
        none = np.zeros((0, width), np.int64)
        return _Sample(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), none, none)

    @staticmethod
    def of(row: dict, width: int) -> _Sample:
        ints = {k: np.frombuffer(row[k], np.int64) for k in ("n", "low", "high")}
        hashes = np.frombuffer(row["hashes"], np.uint64)
        return _Sample(row["rows"], hashes, ints["n"], ints["low"].reshape(-1, width), ints["high"].reshape(-1, width))


_SAMPLED = "part int, set int, rows bigint, hashes binary, n binary, low binary, high binary"
_SUMMARY = "set int, rows bigint, groups bigint, share double, repeated bigint, repeats bigint, broken array<bigint>"


def _sampled(sets: Sequence[Sequence[int]], width: int):
    """The samples of a task, for rows of the hashes of all columns."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Sample.empty(width) for _ in sets]
        for columns in _chunks(batches, SAMPLED_ROWS):
            words = _words(columns)
            for i, s in enumerate(sets):
                found[i] = found[i].with_rows(reduce(np.add, [words[c] for c in s]), columns, s)
        part = TaskContext.get().partitionId() // MERGED_AT_ONCE
        rows = [{"part": part, **f.row(i)} for i, f in enumerate(found)]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SAMPLED)

    return sampled


_ARROW_SAMPLED = pa.schema(
    [("part", pa.int32()), ("set", pa.int32()), ("rows", pa.int64())] + [(k, pa.binary()) for k in ("hashes", "n", "low", "high")]
)


def _merge(table: pa.Table, width: int) -> _Sample:
    merged = _Sample.empty(width)
    for batch in table.to_batches():
        for i in range(len(batch)):
            s = _Sample.of(batch.slice(i, 1).to_pylist()[0], width)
            merged = merged.with_(s.rows, s.hashes, s.n, s.low, s.high)
    return merged


def _merged(width: int):
    def merged(table: pa.Table) -> pa.Table:
        row = _merge(table, width).row(table.column("set")[0].as_py())
        return pa.Table.from_pylist([{"part": 0, **row}], schema=_ARROW_SAMPLED)

    return merged


def _summed_up(width: int):
    def summed_up(table: pa.Table) -> pa.Table:
        s = _merge(table, width)
        # the share of all groups that the sample stands for: those below its last hash
        whole = len(s.hashes) < SAMPLE
        share = 1.0 if whole else float(s.hashes[-1]) / 2.0**64
        return pa.table(
            {
                "set": pa.array([table.column("set")[0].as_py()], pa.int32()),
                "rows": pa.array([s.rows], pa.int64()),
                "groups": pa.array([len(s.hashes)], pa.int64()),
                "share": pa.array([share], pa.float64()),
                "repeated": pa.array([int((s.n > 1).sum())], pa.int64()),
                "repeats": pa.array([int(s.n.sum()) - len(s.n)], pa.int64()),
                "broken": pa.array([(s.low < s.high).sum(axis=0).tolist()], pa.list_(pa.int64())),
            }
        )

    return summed_up


_BLOCKS = "set int, bucket int, block binary"
_ARROW_BLOCKS = pa.schema([("set", pa.int32()), ("bucket", pa.int32()), ("block", pa.binary())])


def _buckets(rows: int) -> int:
    """Bits of a hash that tell its bucket; from billions of rows on, buckets grow instead of blocks getting small."""
    return min(12, (rows // BUCKET_ROWS).bit_length())


def _blocks(number: int, bits: int, rows: np.ndarray) -> pa.RecordBatch:
    """Columns of numbers, in the order of the first of them, cut where its first bits change."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    edges = np.append(np.searchsorted(rows[0], starts), rows.shape[1])
    used = np.flatnonzero(edges[1:] > edges[:-1])
    blocks = [rows[:, edges[b] : edges[b + 1]].tobytes() for b in used]
    columns = [pa.array([number] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_BLOCKS)


def _unblocked(table: pa.Table, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.uint64).reshape(width, -1) for b in table.column("block").to_pylist()], axis=1)


def _in_order(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of hashes, and where in it a new pair starts."""
    order = np.argsort(x, kind="stable")
    new, other = (np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool) for h in (x[order], y[order]))
    if (other & ~new).any():
        # different values of one first hash: they need not stand together yet
        order = np.lexsort((y, x))
        new, other = (np.append(True, h[1:] != h[:-1]) for h in (x[order], y[order]))
    return order, np.flatnonzero(new | other)


def _distinct_dealt(sets: Sequence[Sequence[int]], bits: Sequence[int], width: int):
    """The distinct hashes of sets in each chunk of rows, dealt to buckets."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _chunks(batches, CHUNK_ROWS):
            words = _words(columns)
            for i, s in enumerate(sets):
                present = _present(columns, s)
                x, y = (_chosen(reduce(np.add, [words[c + k] for c in s]), present) for k in (0, width))
                order, start = _in_order(x, y)
                order = order[start]
                yield _blocks(i, bits[i], np.stack((x[order], y[order])))

    return dealt


def _distinct_counted(table: pa.Table) -> pa.Table:
    x, y = _unblocked(table, 2)
    counted = {"set": table.column("set")[:1].cast(pa.int32()), "distinct": pa.array([len(_in_order(x, y)[1])], pa.int64())}
    return pa.table(counted)


def _at_least(seen: int, share: float) -> float:
    """So many of something there are at least in all groups, if so many were seen in the sample."""
    return seen if share == 1 else max(0.0, seen - DEVIATIONS * (seen + 1) ** 0.5) / share


@dataclass
class _Support:
    """What is known of a set: its rows, distinct values and repeats; for each other column, in how
    many groups it differs at least. Counts are exact if ``exact``."""

    rows: int
    distinct: float
    exact: bool
    least_repeats: float = 0.0
    broken: dict[str, float] = field(default_factory=dict)
    differs: frozenset[str] = frozenset()


class _Lattice:
    """What is known of sets of columns of one table, sampled and exact, each found once."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None):
        names = df.columns if columns is None else list(columns)
        self.df = df
        self.names = [c for c in names if _has_equality(df.schema[c].dataType)]
        self.known: dict[Columns, _Support] = {}
        self.total = df.count()
        self.sample([Columns([c]) for c in self.names])
        self.columns = [c for c in self.names if self.known[Columns([c])].rows > 1]

    def sample(self, sets: Iterable[Columns]) -> None:
        """One scan for all sets that are not known yet, or several where there are very many."""
        todo = [s for s in dict.fromkeys(sets) if s not in self.known]
        width = len(self.names)
        step = max(1, SAMPLE_BYTES // (SAMPLE * 16 * (width + 1)))
        hashes = _hashes(self.names, self.names)[:width]
        for start in range(0, len(todo), step):
            part = todo[start : start + step]
            places = [[i for i, c in enumerate(self.names) if c in s] for s in part]
            found = (
                self.df.select(*hashes)
                .mapInArrow(_sampled(places, width), _SAMPLED)
                .groupBy("set", "part")
                .applyInArrow(_merged(width), _SAMPLED)
                .groupBy("set")
                .applyInArrow(_summed_up(width), _SUMMARY)
            )
            for s in part:
                self.known[s] = _Support(0, 0, True)
            for r in found.collect():
                own, share = part[r["set"]], r["share"]
                broken = dict(zip(self.names, r["broken"]))
                self.known[own] = _Support(
                    r["rows"],
                    r["groups"] / share,
                    share == 1,
                    r["repeats"] if share == 1 else _at_least(r["repeated"], share),
                    {c: _at_least(n, share) for c, n in broken.items()},
                    frozenset(c for c, n in {**broken, **({None: r["repeated"]} if r["repeated"] else {})}.items() if n),
                )

    def count(self, sets: Iterable[Columns]) -> None:
        """Exact counts, one grouping for every SETS_PER_PASS sets. The rows are known from the sample."""
        todo = [s for s in dict.fromkeys(sets) if not self.known[s].exact]
        width = len(self.names)
        for start in range(0, len(todo), SETS_PER_PASS):
            part = todo[start : start + SETS_PER_PASS]
            places = [[i for i, c in enumerate(self.names) if c in s] for s in part]
            bits = [_buckets(self.known[s].rows) for s in part]
            counted = (
                self.df.select(*_hashes(self.names, Columns().union(*part)))
                .mapInArrow(_distinct_dealt(places, bits, width), _BLOCKS)
                .groupBy("set", "bucket")
                .applyInArrow(_distinct_counted, "set int, distinct bigint")
                .groupBy("set")
                .agg(F.sum("distinct").alias("distinct"))
            )
            found = {r["set"]: r["distinct"] for r in counted.collect()}
            for i, s in enumerate(part):
                rows, distinct = self.known[s].rows, found.get(i, 0)
                self.known[s] = replace(self.known[s], distinct=distinct, exact=True, least_repeats=rows - distinct)

    def keys_among(self, sets: Iterable[Columns], allowed: Callable[[Columns], int]) -> set[Columns]:
        """Those with at most so many repeats, all of which are then known exactly."""
        sets = [s for s in sets if self.most_distinct(s) >= self.least_rows(s) - allowed(s)]
        self.sample(sets)
        self.count(s for s in sets if not self.refuted(s, None, allowed(s)))
        return {s for s in sets if self.known[s].exact and self.known[s].rows - self.known[s].distinct <= allowed(s)}

    def refuted(self, s: Columns, dependent: str | None, allowed: int) -> bool:
        """Whether the sample excludes a key, or a dependency, with so many rows to remove at most."""
        known = self.known[s]
        if not allowed:
            return dependent in known.differs
        return (known.least_repeats if dependent is None else known.broken[dependent]) > allowed

    def most_distinct(self, s: Columns) -> float:
        """What the distinct values of the single columns allow."""
        margin = DEVIATIONS / SAMPLE**0.5
        return prod(k.distinct * (1 if k.exact else 1 + margin) for k in (self.known[Columns([c])] for c in s))

    def least_rows(self, s: Columns) -> int:
        return self.total - sum(self.total - self.known[Columns([c])].rows for c in s)


def _level(columns: Sequence[str], size: int, enough: Iterable[Columns]) -> list[Columns]:
    """Sets of so many columns that hold none of the given sets."""
    enough = list(enough)
    return [s for s in map(Columns, combinations(columns, size)) if not any(e <= s for e in enough)]


# Keys -------------------------------------------------------------------------------------


def keys(
    df: DataFrame, columns: Sequence[str] | None = None, max_columns: int = 3, min_confidence: float = 1.0
) -> DataFrame:
    """Minimal unique column combinations of up to ``max_columns`` columns.

    A row per set: ``KEY`` where no value repeats; with ``min_confidence`` below 1 also minimal
    sets, ``NEAR_KEY``, of which at most that share of all rows repeats an earlier row's value.
    """
    lattice = _Lattice(df, columns)
    allowed = int((1 - min_confidence) * lattice.total + 1e-9)
    exact: list[Columns] = []
    near: list[Columns] = []
    for size in range(1, max_columns + 1):
        # of a set that holds a near key, only whether it is a key is of interest
        found = lattice.keys_among(_level(lattice.columns, size, exact), lambda s: 0 if any(n < s for n in near) else allowed)
        for s in sorted(found, key=sorted):
            if lattice.known[s].rows == lattice.known[s].distinct:
                exact.append(s)
            elif not any(n < s for n in near):
                near.append(s)
    near = [s for s in near if not any(e < s for e in exact)]
    rows = [(s, kind) for kind, sets in (("KEY", exact), ("NEAR_KEY", near)) for s in sets]
    known = lattice.known
    return local_frame(
        df.sparkSession,
        (
            {
                "columns": [c for c in df.columns if c in s],
                "rows": known[s].rows,
                "distinct": int(known[s].distinct),
                "repeats": known[s].rows - int(known[s].distinct),
                "kind": kind,
            }
            for s, kind in rows
        ),
        KEYS,
    )


def keys_of_tables(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """``keys`` of several tables, searched side by side."""
    found = side_by_side(lambda t: keys(t[1], **options).withColumn("table_name", F.lit(t[0])), tables.items())
    return reduce(DataFrame.unionByName, found)


def key_rules(df: DataFrame, table_name: str, **options) -> DataFrame:
    """Uniqueness rules of the keys found; a near key is a rule with violations."""
    found = keys(df, **options).withColumn("support", F.col("rows"))
    return _mined(
        found, table_name, checks.UNIQUE, F.col("columns"), F.array().cast(schemas.RULES["conditions"].dataType),
        F.col("distinct"), F.format_string("%s identifies a row", F.array_join("columns", ", ")),
    )


# Dependencies -----------------------------------------------------------------------------


def _coded(columns: Sequence[tuple[np.ndarray, np.ndarray | None]], width: int) -> list[tuple[np.ndarray, int]]:
    """The values of each column as small numbers, and how many there are."""
    out = []
    for (x, _), (y, _) in zip(columns[:width], columns[width:]):
        coded = pa.array(x).dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        second = np.zeros(n, np.int64)
        second[codes] = y
        if (second[codes] != y).any():
            order, start = _in_order(x.view(np.uint64), y.view(np.uint64))
            codes[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            n = len(start)
        out.append((codes, n))
    return out


def _cells(
    codes: Sequence[tuple[np.ndarray, int]], x: Sequence[int], c: int, present: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of a determinant's value and a dependent one in a chunk: the place of a row that has
    it, and how many have; and where the pairs of each determinant's value start."""
    cell, n = _chosen(codes[x[0]][0], present), codes[x[0]][1]
    for i in (*x[1:], c):
        if n > CODES:
            distinct, cell = np.unique(cell, return_inverse=True)
            n = len(distinct)
        own, m = codes[i]
        cell, n = cell * m + _chosen(own, present), n * m
    if n <= CELLS:
        counts = np.bincount(cell, minlength=n)
        used = np.flatnonzero(counts)
        row = np.zeros(n, np.int64)
        row[cell] = np.arange(len(cell))
        row, counts = row[used], counts[used]
    else:
        used, row, counts = np.unique(cell, return_index=True, return_counts=True)
    value = used // codes[c][1]
    return row, counts, np.flatnonzero(np.append(True, value[1:] != value[:-1]) if len(value) else [])


def _pairs_in_chunks(pairs: Sequence[tuple[Sequence[int], int]], width: int, batches: Iterable[pa.RecordBatch]):
    """The cells of every pair in every chunk, with the hashes of the columns."""
    for columns in _chunks(batches, CHUNK_ROWS):
        words, codes = _words(columns), _coded(columns, width)
        for i, (x, c) in enumerate(pairs):
            present = _present(columns, [*x, c])
            yield i, words, present, _cells(codes, x, c, present)


def _removals_of_chunks(pairs: Sequence[tuple[Sequence[int], int]], width: int):
    """The rows to remove in each chunk of a task, added up."""

    def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [0] * len(pairs)
        for i, _, _, (_, counts, start) in _pairs_in_chunks(pairs, width, batches):
            if len(start):
                least[i] += int(counts.sum() - np.maximum.reduceat(counts, start).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pairs)), pa.int32()), pa.array(least, pa.int64())], names=["pair", "least"]
        )

    return removals


def _pairs_dealt(pairs: Sequence[tuple[Sequence[int], int]], bits: int, width: int):
    """The cells of pairs in each chunk, dealt to buckets by both values: their hashes, the determinant's and counts."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, words, present, (row, counts, _) in _pairs_in_chunks(pairs, width, batches):
            x, c = pairs[i]
            row = row if present is None else np.flatnonzero(present)[row]
            own = [reduce(np.add, [words[k + j][row] for j in x]) for k in (0, width)]
            both = [h + words[k + c][row] for h, k in zip(own, (0, width))]
            cells = np.stack((*both, *own, counts.astype(np.uint64)))
            yield _blocks(i, bits, cells[:, np.argsort(both[0], kind="stable")])

    return dealt


def _values_dealt(bits: int):
    """Of each determinant's value in a bucket of pairs, the rows and those of the commonest dependent, dealt by value."""

    def dealt(table: pa.Table) -> pa.Table:
        *both, x, y, n = _unblocked(table, 5)
        order, start = _in_order(*both)
        n, x, y = np.add.reduceat(n[order], start), x[order][start], y[order][start]
        order, start = _in_order(x, y)
        n = n[order]
        rows = np.stack((x[order][start], y[order][start], np.add.reduceat(n, start), np.maximum.reduceat(n, start)))
        return pa.Table.from_batches([_blocks(table.column("set")[0].as_py(), bits, rows)])

    return dealt


def _values_summed_up(table: pa.Table) -> pa.Table:
    x, y, n, most = _unblocked(table, 4)
    order, start = _in_order(x, y)
    rows, most = int(n.sum()), int(np.maximum.reduceat(most[order], start).sum())
    found = {"n_values": len(start), "rows": rows, "removals": rows - most}
    return pa.table({"set": table.column("set")[:1].cast(pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in found.items()}})


def _removals(
    df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[Columns, str]], total: int, allowed: int
) -> dict[tuple[Columns, str], tuple[int, int, int]]:
    """Values of the determinant, rows, and rows to remove so that each value has one dependent.

    Only of pairs with at most ``allowed`` rows to remove in all chunks of rows together; others have
    more in the table. The commonest dependent of each value stays. One grouping for every
    SETS_PER_PASS pairs: by determinant and dependent first, so that a hot value is reduced to its
    distinct dependents.
    """
    width, bits = len(names), _buckets(total)
    place = {c: i for i, c in enumerate(names)}
    placed = lambda part: [([place[c] for c in names if c in x], place[c]) for x, c in part]
    hashed = lambda part: df.select(*_hashes(names, Columns().union(*(x | {c} for x, c in part))))
    if pairs:
        chunks = hashed(pairs).mapInArrow(_removals_of_chunks(placed(pairs), width), "pair int, least bigint")
        least = {r["pair"]: r["least"] for r in chunks.groupBy("pair").agg(F.sum("least").alias("least")).collect()}
        pairs = [p for i, p in enumerate(pairs) if least.get(i, 0) <= allowed]
    out = {}
    for start in range(0, len(pairs), SETS_PER_PASS):
        part = pairs[start : start + SETS_PER_PASS]
        counted = (
            hashed(part)
            .mapInArrow(_pairs_dealt(placed(part), bits, width), _BLOCKS)
            .groupBy("set", "bucket")
            .applyInArrow(_values_dealt(bits), _BLOCKS)
            .groupBy("set", "bucket")
            .applyInArrow(_values_summed_up, "set int, n_values bigint, rows bigint, removals bigint")
            .groupBy("set")
            .agg(*(F.sum(c).alias(c) for c in ("n_values", "rows", "removals")))
        )
        found = {r["set"]: r for r in counted.collect()}
        for i, p in enumerate(part):
            r = found.get(i)
            out[p] = (r["n_values"], r["rows"], r["removals"]) if r else (0, 0, 0)
    return out


def composite_dependencies(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_determinants: int = 2,
    min_confidence: float = 1.0,
) -> DataFrame:
    """REC-15, several columns: minimal dependencies {a, b, ...} -> c.

    A dependency holds if removing at most 1 - ``min_confidence`` of all rows of the table
    leaves one dependent for each value of the determinant; both it and uniqueness can only
    become truer as columns are added, which is what the search prunes by. It is minimal if no
    part of the determinant has the dependent already. Left out are what holds for want of
    repeats: determinants that are (nearly) keys, and those that are so where the dependent is
    present; and columns with one value.

    Before any grouping, the samples exclude many pairs: a group in which the dependent differs
    costs at least one row. Chunks of rows exclude others, by the rows to remove in each.
    """
    lattice = _Lattice(df, columns)
    allowed = int((1 - min_confidence) * lattice.total + 1e-9)
    single = lambda c: lattice.known[Columns([c])]
    names = [c for c in lattice.columns if single(c).distinct > 1]
    unique: list[Columns] = []
    held: dict[str, list[Columns]] = {c: [] for c in names}
    rows = []
    for size in range(1, max_determinants + 1):
        unique += lattice.keys_among(_level(names, size, unique), lambda s: allowed)
        sets = _level(names, size, unique)
        lattice.sample(sets)
        left = [
            (x, c)
            for x in sets
            for c in names
            if c not in x and not any(h <= x for h in held[c]) and not lattice.refuted(x, c, allowed)
        ]
        for (x, c), (n_values, support, removals) in _removals(df, lattice.names, left, lattice.total, allowed).items():
            if removals <= allowed:
                held[c].append(x)
                if n_values < support:
                    rows.append((x, c, n_values, support, removals))
    return local_frame(
        df.sparkSession,
        (
            {
                "determinant": [n for n in df.columns if n in x],
                "dependent": c,
                "n_values": n_values,
                "support": support,
                "removals": removals,
            }
            for x, c, n_values, support, removals in rows
        ),
        DEPENDENCIES,
    )


def composite_dependency_rules(df: DataFrame, table_name: str, **options) -> DataFrame:
    """REC-15: FUNCTIONAL_DEPENDENCY rules; confidence is the share of rows that can stay."""
    return _mined(
        composite_dependencies(df, **options),
        table_name,
        checks.DEPENDENCY,
        F.concat("determinant", F.array("dependent")),
        F.array().cast(schemas.RULES["conditions"].dataType),
        F.col("support") - F.col("removals"),
        F.format_string("%s determine %s", F.array_join("determinant", ", "), "dependent"),
    )


# References -------------------------------------------------------------------------------


def _reference_class(data_type: T.DataType) -> str | None:
    """Columns refer to columns of the same class; fractions and nested values to none."""
    if isinstance(data_type, T.IntegralType):
        return "INTEGER"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return type(data_type).__name__
    return None


def _reference_value(name: str, kind: str) -> Column:
    c = column(name)
    return c.cast("bigint") if kind == "INTEGER" else c.cast("string") if kind == "STRING" else c


REFERENCES = schemas.struct(
    child_table=schemas.S, child_column=schemas.S, parent_table=schemas.S, parent_column=schemas.S,
    n_values=schemas.L, missing=schemas.L, parent_values=schemas.L, same_name=schemas.B,
)


def references(tables: Mapping[str, DataFrame], min_confidence: float = 1.0) -> DataFrame:
    """REC-9, CHK-13: columns whose values are among those of a key column of any table.

    1. One scan per table makes a theta sketch, the smallest hashes, of every column.
    2. Pairs of columns of one class go on unless the sketches exclude them: a hash of the child
       below both thresholds that the parent lacks proves a missing value, so that no inclusion is
       lost. With ``min_confidence`` below 1, the estimated share must be DEVIATIONS standard
       errors too low. Parents whose values are far fewer than their rows are no keys.
    3. The distinct values of the columns left are joined once, for all pairs together, and parents
       that turn out to have repeats are dropped.

    ``n_values`` are the child's distinct values, ``missing`` those the parent lacks, at most
    1 - ``min_confidence`` of them. ``same_name``: the names agree after a prefix up to ``_``.
    """
    at = [
        (t, c, kind)
        for t, df in tables.items()
        for c in df.columns
        if (kind := _reference_class(df.schema[c].dataType)) is not None
    ]
    spark = next(iter(tables.values())).sparkSession
    empty = local_frame(spark, [], REFERENCES)
    if not at:
        return empty
    number = {(t, c): i for i, (t, c, _) in enumerate(at)}

    def sketched(name: str) -> list[dict]:
        own = [(c, k) for t, c, k in at if t == name]
        if not own:
            return []
        aggregates = []
        for i, (c, kind) in enumerate(own):
            value = F.when(column(c).isNotNull(), F.xxhash64(_reference_value(c, kind)))
            aggregates += [F.count(value).alias(f"n{i}"), F.theta_sketch_agg(value, SKETCH_LOG).alias(f"s{i}")]
        row = tables[name].agg(*aggregates).first()
        return [
            {"id": number[name, c], "kind": kind, "rows": row[f"n{i}"], "sketch": bytes(row[f"s{i}"])}
            for i, (c, kind) in enumerate(own)
            if row[f"n{i}"]
        ]

    sketches = [s for part in side_by_side(sketched, tables) for s in part]
    schema = schemas.struct(id=schemas.I, kind=schemas.S, rows=schemas.L, sketch=T.BinaryType())
    local = local_frame(spark, sketches, schema)
    side = lambda p: local.select(F.col("kind"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "rows", "sketch")))
    error = DEVIATIONS / (1 << SKETCH_LOG) ** 0.5
    size = lambda s: F.theta_sketch_estimate(s)
    lacking = size(F.theta_difference("c_sketch", "p_sketch"))
    # exact counts come later; the estimates of small sketches are exact as well
    maybe = lacking == 0 if min_confidence >= 1 else lacking <= size("c_sketch") * (1 - min_confidence + error) + 1
    pairs = (
        side("c")
        .join(side("p"), "kind")
        .where(F.col("c_id") != F.col("p_id"))
        .where(size("p_sketch") * (1 + error) >= F.col("p_rows"))
        .where(maybe)
        .select("c_id", "p_id")
        .collect()
    )
    if not pairs:
        return empty
    parents: dict[int, list[int]] = {}
    for r in pairs:
        parents.setdefault(r["c_id"], []).append(r["p_id"])
    used = {i for r in pairs for i in r}

    def values_of(name: str, ids: set[int]) -> DataFrame | None:
        own = [(i, c, k) for i, (t, c, k) in enumerate(at) if t == name and i in ids]
        if not own:
            return None
        rows = [
            F.when(
                column(c).isNotNull(),
                F.struct(
                    F.lit(i).alias("id"),
                    F.xxhash64(_reference_value(c, k)).alias("x"),
                    F.xxhash64(F.lit("second"), _reference_value(c, k)).alias("y"),
                ),
            )
            for i, c, k in own
        ]
        counted = tables[name].select(F.explode(F.array_compact(F.array(*rows))).alias("v")).select("v.*")
        return counted.groupBy("id", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    values = reduce(DataFrame.union, [v for t in tables if (v := values_of(t, used)) is not None]).persist()
    try:
        sizes = values.groupBy("id").agg(F.count(F.lit(1)).alias("n_values"), F.max("n").alias("most")).collect()
        n_values = {r["id"]: r["n_values"] for r in sizes}
        unique = {r["id"] for r in sizes if r["most"] == 1}
        parents = {c: own for c, ps in parents.items() if (own := [p for p in ps if p in unique])}
        if not parents:
            return empty
        whose = F.create_map(*(F.lit(v) if isinstance(v, int) else F.array(*map(F.lit, v)) for kv in parents.items() for v in kv))
        # a value meets the list of key columns that have it, which is as short as there are columns
        had = values.where(F.col("id").isin(sorted({p for ps in parents.values() for p in ps})))
        had = had.groupBy("x", "y").agg(F.collect_set("id").alias("had"))
        asked = values.where(F.col("id").isin(sorted(parents))).join(had, ["x", "y"], "left")
        missing = (
            asked.select("id", "had", F.explode(whose[F.col("id")]).alias("parent"))
            .groupBy("id", "parent")
            .agg(F.count_if(~F.coalesce(F.array_contains("had", F.col("parent")), F.lit(False))).alias("missing"))
            .collect()
        )
    finally:
        values.unpersist()
    bare = lambda name: name.split("_", 1)[-1].lower()
    rows = []
    for child, parent, lack in missing:
        if lack <= (1 - min_confidence) * n_values[child] + 1e-9:
            (t, c, _), (u, p, _) = at[child], at[parent]
            rows.append(
                {
                    "child_table": t, "child_column": c, "parent_table": u, "parent_column": p,
                    "n_values": n_values[child], "missing": lack, "parent_values": n_values[parent],
                    "same_name": bare(c) == bare(p),
                }
            )
    return local_frame(spark, rows, REFERENCES)


def reference_constraints(found: DataFrame) -> DataFrame:
    """Foreign keys as constraints, for ``flows.check_constraints``: of the parents of a column, one
    of the same name, else the one whose values the column covers best; ties by name."""
    order = F.struct(
        ~F.col("same_name"), -(F.col("n_values") - F.col("missing")) / F.col("parent_values"), "parent_table", "parent_column"
    )
    best = found.groupBy("child_table", "child_column").agg(F.min_by(F.struct("parent_table", "parent_column"), order).alias("p"))
    given = {
        "constraint_name": F.concat_ws("_", F.lit("fk"), "child_table", "child_column"),
        "constraint_type": F.lit("FOREIGN_KEY"),
        "table_name": F.col("child_table"),
        "columns": F.array("child_column"),
        "ref_table": F.col("p.parent_table"),
        "ref_columns": F.array("p.parent_column"),
    }
    return best.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in schemas.CONSTRAINTS.fields])
