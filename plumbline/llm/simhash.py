"""Near-duplicate documents by SimHash fingerprints and BK-trees.

1. A fingerprint has 64 bits. A bit is 1 if it is set in over half of the XXH64 hashes of the
   document's shingles, repeats included. Documents with one fingerprint are one class.
2. The 64 bits are cut into radius + 1 ranges. Two fingerprints that differ in at most `radius` bits
   agree in one of these ranges at least. All fingerprints that agree in a range are a shard.
3. Each shard has a BK-tree: its root is the first fingerprint, and the children of a node are keyed
   by their Hamming distance to it. A query at distance d from a node goes on only along edges with
   keys from d - radius to d + radius, so that no fingerprint within the radius is missed.
4. The tree of a shard goes to every task that has queries for it. Small shards share a task; a shard
   above `TREE_NODES` fingerprints is dealt into blocks, each with a tree of its own, and every pair of
   blocks is a task. A tree of all fingerprints, sent to all tasks, would make the work quadratic.
5. A task returns, of the links it finds, only as many as join its fingerprints to components, so
   that no pairs are listed. Spark then joins components over all shards.

All trees of a task are built and searched together, level by level, on arrays.

Words: A-Z lower-cased, then maximal runs of characters other than space and \\x09-\\x0D. A shingle
is 3 consecutive words joined by a space, or the whole sequence of a text that has fewer.

Defined cases: null texts and texts without words have fingerprint 0 and are linked like any other.
Rows with a null id have a fingerprint and link others, but name no component: their component is
the smallest id reachable, or null if there is none. Each row gives one row, repeated ids included;
further columns are ignored. A text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import checkpointed, quoted, shards, texts_of
from plumbline.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
TREE_NODES = 1 << 16
TASK_ROWS = 1 << 18
FRONTIER = 1 << 20  # pairs of a query and a node looked at together
CHUNK = 1 << 16  # hashes whose bits are counted together
HOT_CLASSES = 1000  # at most so many classes hold over a thousandth of the rows each


def fingerprints(texts: list[bytes | None], size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    found = W.split(texts, lower=True)
    n = len(found.start)
    # the words joined by single spaces, so that a shingle is one slice
    length = found.end - found.start
    last = np.cumsum(length + 1) - 1
    begin = last - length
    data = found.data.copy()
    data[found.end] = 0x20
    joined = data[W.spans(found.start, found.end + 1, len(data))].tobytes()
    stop = found.first[1:]
    owner = found.owner()
    end = np.minimum(np.arange(n) + size, stop[owner]) - 1
    # a shingle from each word that has enough after it, or from the first word of a short text
    counts = found.counts
    starts = np.flatnonzero((np.arange(n) + size <= stop[owner]) | ((counts[owner] < size) & (np.arange(n) == found.first[:-1][owner])))
    digest = xxhash.xxh64_intdigest
    begins, ends = begin[starts].tolist(), last[end[starts]].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends)), dtype=np.uint64, count=len(starts))
    total = np.bincount(owner[starts], minlength=len(counts))
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    of = owner[starts]
    for a in range(0, len(hashes), CHUNK):
        part = of[a : a + CHUNK]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        bits = np.unpackbits(hashes[a : a + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class Trees:
    """BK-trees of fingerprints by unit; equal fingerprints of a unit must not be given twice."""

    def __init__(self, unit: np.ndarray, prints: np.ndarray):
        order = np.lexsort((prints, unit))
        self.unit, self.prints = unit[order], prints[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = self.unit[1:] != self.unit[:-1]
        self.roots = np.flatnonzero(first)
        self.root_units = self.unit[self.roots]
        rest = np.flatnonzero(~first)
        at = self.roots[np.cumsum(first) - 1][rest]
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            slot = at * 65 + np.bitwise_count(self.prints[rest] ^ self.prints[at]).astype(np.int64)
            by = np.argsort(slot, kind="stable")
            slot, rest = slot[by], rest[by]
            new = np.ones(len(slot), dtype=bool)
            new[1:] = slot[1:] != slot[:-1]
            keys.append(slot[new])
            children.append(rest[new])
            at = rest[new][np.cumsum(new) - 1][~new]
            rest = rest[~new]
        keys, children = np.concatenate(keys), np.concatenate(children)
        by = np.argsort(keys)
        self.keys, self.children = keys[by], children[by]

    def within(self, unit: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) at most `radius` apart, part by part."""
        root = np.searchsorted(self.root_units, unit)
        has = np.flatnonzero(self.root_units[np.minimum(root, len(self.root_units) - 1)] == unit) if len(self.roots) else []
        stack = [(has, self.roots[root[has]])] if len(has) else []
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right")
            n = high - low
            if n.any():
                start = np.repeat(low - (np.cumsum(n) - n), n)
                stack.append((np.repeat(query, n), self.children[start + np.arange(len(start))]))


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest of n places that each is joined with by the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(label, high, low)
            while True:
                again = label[label]
                if (again == label).all():
                    break
                label = again
    return label


def _links(radius: int):
    def links(table: pa.Table) -> pa.Table:
        """Links that join the fingerprints of the units of a task. A row is a fingerprint of block
        `own`; units are named by a number and a pair of blocks, x <= y."""
        unit, own, x = (table.column(c).to_numpy() for c in ("unit", "own", "x"))
        prints = table.column("print").to_numpy().view(np.uint64)
        tree = own == x
        trees = Trees(unit[tree], prints[tree])
        # places: the nodes of the trees, then the fingerprints of other blocks, which only ask
        ask_unit, ask = np.concatenate((trees.unit, unit[~tree])), np.concatenate((trees.prints, prints[~tree]))
        label = joined(len(ask), trees.within(ask_unit, ask, radius))
        moved = np.flatnonzero(label != np.arange(len(ask)))
        return pa.table(
            {
                "a": pa.array(ask[moved].view(np.int64), pa.int64()),
                "b": pa.array(ask[label[moved]].view(np.int64), pa.int64()),
            }
        )

    return links


def near_links(classes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of a column `print` that are at most `radius`
    bits apart, directly or through others."""
    if radius < 1:
        return classes.sparkSession.createDataFrame([], "a bigint, b bigint")
    parts = radius + 1
    cut = [64 * i // parts for i in range(parts + 1)]
    ranges: list[Column] = [
        F.struct(
            F.lit(i).alias("part"),
            F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
        )
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))
    ]
    members = classes.select("print", F.explode(F.array(*ranges)).alias("shard")).select("print", "shard.part", "shard.value")
    sizes = checkpointed(members.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int")
    total = sizes.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = (
        members.join(sizes.withColumn("blocks", blocks), ["part", "value"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
        .select(F.xxhash64("part", "value", "x", "y").alias("unit"), "own", "x", "print")
    )
    tasks = total // TASK_ROWS + 1
    return (
        dealt.withColumn("task", F.pmod("unit", F.lit(tasks)))
        .groupBy("task")
        .applyInArrow(_links(radius), "a bigint, b bigint")
        .distinct()
    )


def _printed(size: int):
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, "text"):
            texts = texts_of(table.column("text"))
            ids = table.column("id").combine_chunks()
            for begin, end in W.pieces(texts):
                prints = fingerprints(texts[begin:end], size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(prints.view(np.int64), pa.int64())], names=["id", "print"]
                )

    return printed


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    size: int = SHINGLE,
    id: str = "doc_id",
    text: str = "text",
    tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """A row per document: id, fingerprint in hexadecimal digits, component_id. Ids are integers."""
    rows = docs.select(F.col(quoted(id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    printed = checkpointed(rows.mapInArrow(_printed(size), "id bigint, print bigint"))
    classes = checkpointed(printed.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    labels = components(checkpointed(near_links(classes, radius, tree_nodes)))
    of = F.coalesce("component", "print").alias("component")
    classes = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "least", "n", of)
    classes = checkpointed(classes)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(classes.join(least, "component").select("print", "n", "component_id"))
    # the few classes that hold over a thousandth of all rows are broadcast, so that none is a hot key
    rows_of_hot = named.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_CLASSES > rows_of_hot
    hot = named.where(is_hot).select("print", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    split = printed.join(F.broadcast(hot), "print", "left")
    cold = split.where("hot is null").join(named.where(~is_hot).select("print", "component_id"), "print")
    out = split.where("hot").select("id", "print", F.col("hot_id").alias("component_id")).union(cold.select("id", "print", "component_id"))
    return out.select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
