"""Small helpers between DataFrames and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that a Python worker gathers before it works on them, in bytes of their texts.
SHARD_BYTES = 16 << 20


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts in UTF-8."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int = SHARD_BYTES) -> Iterator[pa.Table]:
    """The batches of a task put together, and cut, so that each table has about `limit` bytes of text.

    A text is never cut; a longer one makes a table of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_binary()))
        total = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(total):
            before = total[begin - 1] if begin else 0
            end = int(np.searchsorted(total, before + limit - size, side="left")) + 1
            held.append(batch.slice(begin, end - begin))
            size += int(total[min(end, len(total)) - 1] - before)
            begin = end
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lists(values: np.ndarray | Sequence, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists: list i holds the next counts[i] values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there.

    The folder is that of spark.checkpoint.dir; where it is unset, as in tests, a folder below the
    warehouse is used.
    """
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def set_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, as Spark has it, from spark.checkpoint.dir or by default."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


# Rows of a small table that may be broadcast: of about 200 bytes each, or of two numbers.
BROADCAST_ROWS = 20_000
BROADCAST_NUMBERS = 500_000
SALTS = 32


def beside(rows: DataFrame, side: DataFrame, key: str, n: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a table of `n` rows that has each key once.

    Broadcast while that is small; beyond, every hot key is spread over SALTS tasks, by a hash of
    the row, so that a row computed again after a lost executor goes the same way.
    """
    if n <= limit:
        return rows.join(F.broadcast(side), key, "left")
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = F.xxhash64(*told_apart(*[F.col(quoted(c)) for c in rows.columns if hashable(rows.schema[c].dataType)]))
    rows = rows.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int"))
    return rows.join(salted, [key, "salt"], "left").drop("salt")


def hashable(kind: T.DataType) -> bool:
    """Whether values of the type can be told apart as strings."""
    return isinstance(kind, T.AtomicType)


def told_apart(*columns: Column) -> list[Column]:
    """Columns that tell null from every value, for hashes."""
    return [c for column in columns for c in (column.isNull(), column.cast("string"))]


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The rows with two hashes, k1 and k2, that name a document by its id and text."""
    k1, k2 = F.xxhash64(*told_apart(F.col(id))), F.xxhash64(F.col(text))
    return docs.withColumn("k1", k1).withColumn("k2", k2)


def free_name(taken: Sequence[str], wish: str) -> str:
    """A column name that is not taken, whatever the case of letters."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
