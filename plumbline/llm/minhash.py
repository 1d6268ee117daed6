"""Near-duplicate documents with b-bit MinHash.

1. Each document gets its distinct shingles, 128 minima of these under as many hash functions,
   keys of 25 bands of 5 minima each, and the low 4 bits of each minimum, packed in bit planes.
2. Documents with the same set are one class, named by the smallest id.
3. In each bucket of a band, the smallest class is compared with all others. A pair goes on when
   the share of equal low bits, counted on the planes and corrected for chance, does not exclude
   the threshold; pairs are then confirmed on their full sets of shingles.
4. Links give components. In buckets whose classes are not all in one component, classes of
   different components are compared on their full sets, in one task where the bucket is small,
   else in blocks of which each pair is a task. It returns only links that join components, so
   that no pairs are listed, however many near copies a bucket holds. Pairs within a component
   need no comparison.

Two documents at a similarity of 0.85 share no bucket with a probability of 4e-7, and are put
aside by their low bits, six standard deviations off, with one of about 1e-9; above 0.85 both fall.

Words: A-Z lower-cased, then maximal runs of characters other than space and \\x09-\\x0D. A shingle
is 5 consecutive words, or all words of a text that has fewer.

Defined cases: texts without words, and null, have no shingles and are linked with nothing. Rows
with a null id are linked with nothing, have no component and stay. Rows with the same id are one document, so they
stay or go together. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import checkpointed, lists, quoted, shards, texts_of
from plumbline.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 25, 5
MINIMA = 128
BITS = 4
DEVIATIONS = 6
BLOCK_SHINGLES = 4 << 20  # in a task that compares classes of one bucket
COMMON = 16  # classes of a bucket beyond which a shingle is kept in a bit map

# Odd multipliers, one for each hash function.
_FACTORS = W.mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_ADDED = W.mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) << np.uint64(32))


def shingles(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and how many each text has."""
    found = W.split(texts, lower=True)
    word = found.hashes()
    hashes, whole = W.windows(word, found.first, size)
    owner = found.owner()
    parts, owners = [hashes[whole]], [owner[whole]]
    for few in range(1, size):
        short = np.flatnonzero(found.counts == few)
        if len(short):
            own, _ = W.windows(word, found.first, few)
            parts.append(W.mixed(own[found.first[short]] + np.uint64(few)))
            owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minima of the hashes of each text that has any: a row per text, a column per function."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), MINIMA), dtype=np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] + _ADDED[k], starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    key = np.zeros((len(low), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = W.mixed(key + low[:, r : BANDS * ROWS : ROWS])
    return key


def planes(low: np.ndarray) -> np.ndarray:
    """The low bits of minima as BITS planes of MINIMA bits each, packed."""
    return np.concatenate(
        [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)], axis=1
    )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: equal low bits, corrected for equality by chance."""
    odd = a ^ b
    unequal = odd.reshape(*odd.shape[:-1], BITS, MINIMA // 8)
    unequal = np.bitwise_or.reduce(unequal, axis=-2)
    share = 1 - np.bitwise_count(unequal).sum(axis=-1) / MINIMA
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Below this, an estimate excludes the threshold."""
    chance = 2.0**-BITS
    share = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (share * (1 - share) / MINIMA) ** 0.5 / (1 - chance)


_SIGNED = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))]
)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for table in shards(batches, "text"):
        texts = texts_of(table.column("text"))
        ids = table.column("id").combine_chunks()
        for begin, end in W.pieces(texts):
            hashes, counts = shingles(texts[begin:end], size)
            has = counts > 0
            digest = [None] * len(counts)
            bits: list[bytes | None] = [None] * len(counts)
            keys = np.zeros(0, np.uint64)
            if has.any():
                starts = (np.cumsum(counts) - counts)[has]
                sums = np.stack([np.add.reduceat(W.mixed(hashes + np.uint64(s)), starts) for s in (1, 2)], axis=1)
                low = minima(hashes, counts)
                packed, keys = planes(low), band_keys(low)
                for at, d, b in zip(np.flatnonzero(has), sums, packed):
                    digest[at], bits[at] = d.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(begin, end - begin),
                    pa.array(counts, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(bits, pa.binary()),
                    lists(keys.view(np.int64).ravel(), np.where(has, BANDS, 0), pa.int64()),
                ],
                schema=_SIGNED,
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for table in shards(batches, "text"):
        texts = texts_of(table.column("text"))
        ids = table.column("id").combine_chunks()
        for begin, end in W.pieces(texts):
            hashes, counts = shingles(texts[begin:end], size)
            stop = np.cumsum(counts)
            sets = [hashes[b - n : b].tobytes() for b, n in zip(stop, counts)]
            yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(sets, pa.binary())], names=["id", "set"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs that the low bits do not exclude."""
    for batch in batches:
        if len(batch):
            near = estimate(_matrix(batch.column("bits_a")), _matrix(batch.column("bits_b"))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            both.sort(kind="stable")  # two ascending runs
            shared = int((both[1:] == both[:-1]).sum())
            near.append(100 * shared >= percent * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _joining(table: pa.Table, percent: int) -> pa.Table:
    """Links between the components of a bucket that join them, on full sets.

    The shingles two classes share are counted exactly: those that many classes of the bucket have
    on bit maps, the others from their short lists of classes.
    """
    rep = table.column("rep").to_numpy()
    part = table.column("label").to_numpy().copy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
    n = np.array([len(s) for s in sets])
    m = len(rep)
    owner = np.repeat(np.arange(m), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > COMMON)
    bits = np.zeros((m, len(common)), dtype=bool)
    many = count[place] > COMMON
    bits[owner[many], np.searchsorted(common, place[many])] = True
    bits = np.packbits(bits, axis=1)
    few = np.flatnonzero(~many & (count[place] > 1))
    few = few[np.argsort(place[few], kind="stable")]
    keys = []
    for step in range(1, COMMON):
        a, b = few[:-step], few[step:]
        same = place[a] == place[b]
        keys.append(owner[a[same]] * m + owner[b[same]])
    pair, shared = np.unique(np.concatenate(keys), return_counts=True)
    bounds = np.searchsorted(pair, np.arange(m + 1) * m)
    links = []
    for i in range(m - 1):
        other = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if not len(other):
            continue
        both = np.zeros(m, dtype=np.int64)
        own = slice(bounds[i], bounds[i + 1])
        both[pair[own] - i * m] = shared[own]
        both = both[other] + np.bitwise_count(bits[other] & bits[i]).sum(axis=1)
        for j in other[100 * both >= percent * (n[i] + n[other] - both)]:
            if part[j] != part[i]:
                links.append((rep[i], rep[j]))
                part[part == part[j]] = part[i]
    return pa.table(
        {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    size: int = SHINGLE,
    id: str = "doc_id",
    text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept. Ids are integers."""
    least = least_estimate(percent / 100)
    rows = docs.select(F.col(quoted(id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    signed = checkpointed(
        rows.mapInArrow(
            lambda batches: _signed(batches, size),
            "id bigint, n bigint, digest binary, bits binary, bands array<bigint>",
        )
    )
    classes = checkpointed(
        signed.where("n > 0 and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    )
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = checkpointed(banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # members of buckets other than the class that all are compared with
    members = checkpointed(banded.join(buckets, "key").where("rep <> pivot"))
    signatures = classes.select("rep", "bits", "n")

    def sets_of(ends: DataFrame) -> DataFrame:
        """The full sets of the classes in a column id."""
        own = rows.join(ends.distinct(), "id", "left_semi")
        return checkpointed(own.mapInArrow(lambda b: _sets(b, size), "id bigint, set binary"))

    pairs = (
        members.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        .distinct()
        .join(signatures.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a")), "a")
        .join(signatures.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b")), "b")
        .select("a", "b", "bits_a", "bits_b")
    )
    pairs = checkpointed(pairs.mapInArrow(lambda b: _likely(b, least), "a bigint, b bigint"))
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    pairs = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .select("a", "b", "set_a", "set_b")
    )
    links = checkpointed(pairs.mapInArrow(lambda b: _confirmed(b, percent), "a bigint, b bigint"))
    labels = components(links)

    placed = checkpointed(
        members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(signatures.select("rep", "n"), "rep")
        .select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
    )
    blocks = F.ceil(2 * F.sum("n") / F.lit(block_shingles)).cast("int")
    unjoined = checkpointed(
        placed.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.when(F.sum("n") > block_shingles, blocks).otherwise(1).alias("blocks"))
        .where("low < high")
        .select("key", "blocks")
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(unjoined, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or own <> other")
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "label")
    )
    dealt = checkpointed(dealt)
    sets = sets_of(dealt.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    joining = (
        dealt.join(sets, "rep")
        .groupBy("key", "x", "y")
        .applyInArrow(lambda t: _joining(t.select(["rep", "label", "set"]), percent), "a bigint, b bigint")
    )
    joining = checkpointed(joining.distinct())
    if not joining.isEmpty():
        labels = components(links.union(joining))
    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = checkpointed(named.select("digest", F.coalesce("component", "rep").alias("component")))
    out = signed.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that `near_duplicates` keeps: one of each group.

    At a similarity of 0.8, two documents share no bucket with a probability of 5e-5.
    """
    gone = near_duplicates(docs, percent, size, id, text).where(~F.col("kept")).select(id).distinct()
    return docs.join(gone, id, "left_anti")
