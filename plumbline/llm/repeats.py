"""Substring deduplication with Rabin-Karp hashes of every window of words.

Documents are dealt into blocks by ranges of their ids, so that an earlier block holds only
smaller ids. Each block hashes all its windows and sends each distinct hash once, packed by the
leading bits of the hash. Spark gathers the blocks of each such bucket; a hash that an earlier
block holds too goes back to the later one. There, every word of a window that came back, or that
started in a document of the block with a smaller id, is removed; such words form maximal
intervals.

A window that is in a third of all documents is sent once per block, not once per document. Blocks
and buckets grow in number with the input, not in size. Texts are shuffled once.

Windows are equal when their 64-bit hashes are: for n windows in all, a window is removed by
mistake with a probability below n / 2**64.

Words: maximal runs of characters other than space and \\x09-\\x0D, unchanged.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing. Rows
with the same id never remove words from each other. Rows with a null id come after all others;
among themselves they remove nothing. Each row gives one row; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import lists, quoted, text_bytes, texts_of

BLOCK_BYTES = 8 << 20
BUCKET_WINDOWS = 1 << 20
BYTES_PER_WORD = 6
LAST = np.iinfo(np.int64).max

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def packed(ordered: np.ndarray) -> bytes:
    """Ascending integers as their differences, each in as many bytes as the largest needs."""
    gaps = np.diff(ordered, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    few = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(few), 8), dtype=np.uint8)
    wide[:, :width] = few
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _rows(hashes: np.ndarray, bits: int):
    """Ascending hashes by bucket: bucket numbers and packed rests."""
    rest = np.uint64(64 - bits)
    bucket = hashes >> rest
    cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
    for begin, end in zip(cut, [*cut[1:], len(hashes)]):
        yield int(bucket[begin]), packed(hashes[begin:end] & np.uint64((1 << int(rest)) - 1))


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(int(LAST)).to_numpy()


def _sent(table: pa.Table, size: int, bits: int) -> pa.Table:
    """The distinct window hashes of a block, a row per bucket."""
    hashes, whole = W.split(texts_of(table.column("text"))).windows(size)
    rows = list(_rows(np.unique(hashes[whole]), bits))
    block = table.column("block")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in rows], pa.int64()),
            "block": pa.array([block] * len(rows), pa.int64()),
            "hashes": pa.array([h for _, h in rows], pa.binary()),
        }
    )


def _returned(table: pa.Table) -> pa.Table:
    """For each block, the hashes of a bucket that an earlier block holds as well."""
    table = table.sort_by("block")
    blocks = table.column("block").to_numpy()
    parts = [unpacked(h) for h in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    again = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    again.sort()  # by block, and within it by hash
    bucket = table.column("bucket")[0].as_py()
    bounds = np.searchsorted(part[again], np.arange(len(parts) + 1))
    rows = [(int(blocks[i]), packed(hashes[again[a:b]])) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    return pa.table(
        {
            "block": pa.array([b for b, _ in rows], pa.int64()),
            "bucket": pa.array([bucket] * len(rows), pa.int64()),
            "hashes": pa.array([h for _, h in rows], pa.binary()),
        }
    )


def kept_texts(found: W.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    data = found.data.copy()
    start, end, owner = found.start[kept], found.end[kept], found.owner()[kept]
    data[end] = 0x20
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    out = data[W.spans(start, end + ~last, len(data))]
    size = np.bincount(owner, weights=end + ~last - start, minlength=len(found.first) - 1)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out))
    return text.cast(pa.string())


def _removed(docs: pa.Table, back: pa.Table, size: int, bits: int) -> pa.Table:
    """The documents of a block without the words of windows that stand in earlier documents."""
    ids = _ids(docs.column("id"))
    order = np.argsort(ids, kind="stable")
    docs, ids = docs.take(pa.array(order)), ids[order]
    found = W.split(texts_of(docs.column("text")))
    hashes, whole = found.windows(size)
    start = np.flatnonzero(whole)
    hashes, id_at = hashes[start], ids[found.owner()[start]]
    # the smallest id of each hash in the block: the first, as ids ascend
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    again = id_at > id_at[first][group] if len(start) else np.zeros(0, bool)
    if len(back):
        rest = np.uint64(64 - bits)
        seen = [
            unpacked(h) | (np.uint64(b) << rest)
            for b, h in zip(back.column("bucket").to_pylist(), back.column("hashes").to_pylist())
        ]
        again |= np.isin(hashes, np.concatenate(seen))
    start = start[again]
    removed = W.spans(start, start + size, len(found.start))
    # maximal intervals, in words of their texts; they end where a text ends
    edge = np.flatnonzero(removed & ~_follows(removed, found))
    stop = np.flatnonzero(removed & ~_precedes(removed, found)) + 1
    owner = found.owner()
    shift = found.first[:-1][owner[edge]] if len(edge) else edge
    part = pa.StructArray.from_arrays(
        [pa.array((edge - shift).astype(np.int32)), pa.array((stop - shift).astype(np.int32))], fields=list(_SPAN)
    )
    return pa.table(
        {
            "id": docs.column("id"),
            "n_words": pa.array(found.counts, pa.int64()),
            "n_removed": pa.array(np.bincount(owner[removed], minlength=len(ids)), pa.int64()),
            "removed": lists(part, np.bincount(owner[edge], minlength=len(ids)), _SPAN),
            "kept": kept_texts(found, ~removed),
        }
    )


def _follows(removed: np.ndarray, found: W.Words) -> np.ndarray:
    """Whether the word before, of the same text, is removed."""
    out = np.zeros(len(removed), dtype=bool)
    out[1:] = removed[:-1]
    out[found.first[:-1][found.counts > 0]] = False
    return out


def _precedes(removed: np.ndarray, found: W.Words) -> np.ndarray:
    """Whether the word after, of the same text, is removed."""
    out = np.zeros(len(removed), dtype=bool)
    out[:-1] = removed[1:]
    out[found.first[1:][found.counts > 0] - 1] = False
    return out


def deduplicate(
    docs: DataFrame,
    size: int = 13,
    id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket_windows: int = BUCKET_WINDOWS,
) -> DataFrame:
    """A row per document: id, n_words, n_removed, removed (intervals of words), kept (text).

    The driver holds one id per block, eight bytes for each 8 MB of text. The id is an integer.
    """
    rows = docs.select(F.col(quoted(id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    total = text_bytes(rows, "text")
    blocks = max(1, -(-total // block_bytes))
    bits = max(8, math.ceil(math.log2(max(1, total / BYTES_PER_WORD / bucket_windows))))
    if blocks > 1:
        grid = [i / blocks for i in range(1, blocks)]
        bounds = rows.agg(F.percentile_approx("id", grid, max(10_000, 20 * blocks))).first()[0]
        bounds = rows.sparkSession.sparkContext.broadcast(np.array(sorted(set(bounds or []))))

        @F.pandas_udf("bigint")
        def block_of(ids):
            return pd.Series(np.searchsorted(bounds.value, ids.to_numpy()).astype(np.int64))

        rows = rows.withColumn("block", block_of(F.coalesce("id", F.lit(int(LAST)))))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("bigint"))
    rows = rows.select("block", "id", "text")
    sent = rows.groupBy("block").applyInArrow(
        lambda t: _sent(t, size, bits), "bucket bigint, block bigint, hashes binary"
    )
    back = sent.groupBy("bucket").applyInArrow(_returned, "block bigint, bucket bigint, hashes binary")
    out = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        lambda d, b: _removed(d, b, size, bits),
        "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string",
    )
    return out.withColumnRenamed("id", id)
