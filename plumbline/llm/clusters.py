"""Centroid clustering of integer vectors with an incremental matrix of dot products.

1. Every kept vector is persisted once with its integers and its exact dot product with every
   centroid. The distance to a centroid is |x|**2 - 2 x.c + |c|**2, so that the nearest one follows
   from the dot products alone.
2. After each round the sums of every cluster give new centroids. Of these only the components that
   changed are sent to the tasks, and every dot product is updated by x[changed] . change; vectors are
   never multiplied with whole centroids again. The updated matrix is persisted, and the nearest
   centroid is taken again from it.

Everything is integer arithmetic. Vectors whose components are all below 2**27 in size are handled
in 64 bits, which no dot product of theirs can leave; all others, and all vectors while a centroid is
that wide, in Python's integers, without persisted dot products. Sums are carried in limbs of 32
bits, so that they are exact at any number of rows.

To the driver come the first centroids and, each round, the sums of each centroid: as many rows as
centroids x components x limbs, whatever the table. Nothing is shuffled but partial sums.

Kept are vectors with exactly `size` components, none null, NaN or infinite. Defined cases: null
vectors and those of other lengths give no row; fewer kept vectors than centroids give as many
centroids as there are vectors, and none gives no rows. Repeated rows count as often as they stand.
Vectors with a null id are clustered as any other; the hash of their id is that of `<seed>:`. Equal
hashes are told apart by the vectors themselves. A distance or an inertia beyond 64 bits is null.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrows import checkpointed, quoted

SCALE = 64
NARROW = 1 << 27
LIMB = 32
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_STATE = "id bigint, x binary, wide string, dots binary"
_SUMS = "cluster int, component int, limb int, total bigint"


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers, exact: 64-bit integers where all are narrow."""
    if not len(values) or np.abs(values).max() < NARROW / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([_floor(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def _floor(x: float) -> int:
    top, bottom = x.as_integer_ratio()
    return top * SCALE // bottom


def narrow(values: np.ndarray) -> np.ndarray:
    """Which rows have only components below NARROW in size."""
    return np.array([all(-NARROW < v < NARROW for v in row) for row in values.tolist()], dtype=bool)


def _bytes(rows: np.ndarray) -> list[bytes]:
    """Rows of integers in the narrowest of 2, 4 and 8 bytes that holds the batch."""
    most = int(np.abs(rows).max()) if rows.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return [r.tobytes() for r in rows.astype(kind)]


def _ints(column: pa.Array, n: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), n), dtype=np.int64)
    by_size = defaultdict(list)
    for i, r in enumerate(rows):
        by_size[len(r)].append(i)
    for size, at in by_size.items():
        raw = np.frombuffer(b"".join(rows[i] for i in at), dtype=f"<i{size // n}")
        out[at] = raw.reshape(len(at), n)
    return out


class Centroids:
    """The centroids of a round, and the components that changed since the round before."""

    def __init__(self, values: list[list[int]], before: Centroids | None = None):
        self.values = values
        self.exact = np.array(values, dtype=object)
        self.narrow = narrow(self.exact)
        self.norms = [sum(v * v for v in row) for row in values]
        # for each centroid: (components, changes), or None where its dot products begin anew
        self.changes = []
        for k, row in enumerate(values):
            if not self.narrow[k]:
                self.changes.append((np.zeros(0, int), np.zeros(0, np.int64)))
            elif before is None or not before.narrow[k]:
                self.changes.append(None)
            else:
                old = before.values[k]
                at = [i for i, v in enumerate(row) if v != old[i]]
                self.changes.append((np.array(at, int), np.array([row[i] - old[i] for i in at], np.int64)))

    def updated(self, x: np.ndarray, dots: np.ndarray) -> np.ndarray:
        """Dot products of narrow vectors with the narrow centroids; for wide ones, of no meaning."""
        dots = dots.copy()
        for k, change in enumerate(self.changes):
            if change is None:
                dots[:, k] = x @ np.array(self.values[k], dtype=np.int64)
            elif len(change[0]):
                dots[:, k] += x[:, change[0]] @ change[1]
        return dots

    def nearest(self, x: np.ndarray, dots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, ties to the smaller number, and its distance."""
        if dots is None or not self.narrow.all():
            x = x.astype(object)
            dots = x @ self.exact.T
            norms = np.array(self.norms, dtype=object)
        else:
            norms = np.array(self.norms, dtype=np.int64)
        far = norms - 2 * dots
        cluster = far.argmin(axis=1)
        return cluster, (x * x).sum(axis=1) + far[np.arange(len(x)), cluster]


def limbs(value: int) -> list[tuple[int, int]]:
    """(number, limb): value = sum of limb << (LIMB * number); all limbs but the last are non-negative."""
    out = []
    while not -(1 << (LIMB - 1)) <= value < 1 << (LIMB - 1):
        out.append((len(out), value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return [*out, (len(out), value)]


def _parts(batch: pa.RecordBatch, size: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Places, vectors and dot products: of the narrow rows of a batch, then of the wide ones."""
    wide = batch.column("wide").is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(~wide)
    if len(at):
        rows = batch.take(pa.array(at))
        yield at, _ints(rows.column("x"), size), _ints(rows.column("dots"), n)
    at = np.flatnonzero(wide)
    if len(at):
        texts = batch.column("wide").take(pa.array(at)).to_pylist()
        yield at, np.array([[int(v) for v in t.split(",")] for t in texts], dtype=object), None


def _state(ids: pa.Array, x: np.ndarray, dots: np.ndarray | None) -> pa.RecordBatch:
    none = [None] * len(ids)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(none if dots is None else _bytes(x), pa.binary()),
            pa.array([",".join(map(str, r)) for r in x.tolist()] if dots is None else none, pa.string()),
            pa.array(none if dots is None else _bytes(dots), pa.binary()),
        ],
        names=["id", "x", "wide", "dots"],
    )


def _started(centroids: Centroids, size: int):
    """The first dot products of vectors (id, vector)."""

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = integers(values)
            small = np.ones(len(x), bool) if x.dtype != object else narrow(x)
            for at, is_narrow in ((np.flatnonzero(small), True), (np.flatnonzero(~small), False)):
                if len(at):
                    rows = x[at].astype(np.int64) if is_narrow else x[at]
                    dots = np.zeros((len(at), len(centroids.values)), np.int64)
                    yield _state(batch.column("id").take(pa.array(at)), rows, centroids.updated(rows, dots) if is_narrow else None)

    return started


def _updated(centroids: Centroids, size: int):
    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, dots in _parts(batch, size, len(centroids.values)):
                ids = batch.column("id").take(pa.array(at))
                yield _state(ids, x, None if dots is None else centroids.updated(x, dots))

    return updated


def _summed(centroids: Centroids, size: int):
    """The sums of the vectors nearest to each centroid, by component, and how many they are, as
    component -1."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for _, x, dots in _parts(batch, size, len(centroids.values)):
                cluster, _ = centroids.nearest(x, dots)
                for k in np.unique(cluster).tolist():
                    own = x[cluster == k]
                    totals[k, -1] += len(own)
                    for j, total in enumerate(own.sum(axis=0).tolist()):
                        totals[k, j] += total
        rows = [(k, j, i, limb) for (k, j), total in totals.items() for i, limb in limbs(total)]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "component", "limb", "total"]
        )

    return summed


def _assigned(centroids: Centroids, size: int):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, dots in _parts(batch, size, len(centroids.values)):
                if dots is not None:
                    dots = centroids.updated(x, dots)
                cluster, far = centroids.nearest(x, dots)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(at)),
                        pa.array(cluster, pa.int32()),
                        pa.array([d if d <= _MOST else None for d in far.tolist()], pa.int64()),
                    ],
                    names=["id", "cluster", "distance"],
                )

    return assigned


def _moved(state: DataFrame, centroids: Centroids, size: int) -> Centroids:
    """Centroids of the sums of their clusters; those of empty clusters stay."""
    sums = state.mapInArrow(_summed(centroids, size), _SUMS)
    sums = sums.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals: dict[tuple[int, int], int] = defaultdict(int)
    for cluster, component, limb, total in sums.collect():
        totals[cluster, component] += int(total) << (LIMB * limb)
    values = [
        [totals[k, j] // totals[k, -1] for j in range(size)] if totals[k, -1] else row
        for k, row in enumerate(centroids.values)
    ]
    return Centroids(values, centroids)


def kept_vectors(vectors: DataFrame, size: int, id: str, vector: str) -> DataFrame:
    """(id, vector) of the vectors with `size` components, all of them finite numbers."""
    of = F.col(quoted(vector)).cast("array<double>")
    rows = vectors.select(F.col(quoted(id)).cast("bigint").alias("id"), of.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where((F.size("vector") == size) & finite)


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    seed: int = 1,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """A row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors with the smallest SHA-256 of `<seed>:<id>`.
    """
    kept = kept_vectors(vectors, size, id, vector)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.withColumn("hash", hashed).orderBy("hash", "vector").limit(k).collect()
    values = [[_floor(v) for v in row["vector"]] for row in first]
    out = "id bigint, cluster int, distance bigint"
    if values:
        centroids = Centroids(values)
        state = kept.mapInArrow(_started(centroids, size), _STATE)
        for turn in range(rounds):
            state = checkpointed(state if turn == 0 else state.mapInArrow(_updated(centroids, size), _STATE))
            centroids = _moved(state, centroids, size)
        if rounds:
            assigned = state.mapInArrow(_assigned(centroids, size), out)
        else:
            unchanged = Centroids(values, centroids)
            assigned = state.mapInArrow(_assigned(unchanged, size), out)
        values = centroids.values
        assigned = checkpointed(assigned)
    else:
        assigned = vectors.sparkSession.createDataFrame([], out)

    # a row per centroid
    wide = lambda c: F.when(F.count("*") == F.count(c), F.sum(F.col(c).cast("decimal(38,0)")))
    by_cluster = assigned.groupBy("cluster").agg(wide("distance").alias("own"), F.count("*").alias("n")).collect()
    all_known = all(r["own"] is not None for r in by_cluster)
    fits = lambda v: v if v is not None and _LEAST <= v <= _MOST else None
    total = fits(sum(int(r["own"]) for r in by_cluster)) if all_known else None
    rows = [
        (
            r["cluster"],
            fits(None if r["own"] is None else int(r["own"])),
            total,
            hashlib.sha256(",".join(map(str, values[r["cluster"]])).encode()).hexdigest(),
        )
        for r in by_cluster
    ]
    sides = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(sides), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
