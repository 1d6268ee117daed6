"""Token counts from flat token files: ids of one width, one after another, without an index.

Each document ends with an end-of-document id. Files are read in blocks of equal size, each by
itself; a block finds all end ids at once. A prefix scan over the summaries of the blocks of a file
tells each block how many documents ended before it and where the last one did, so that documents
which span blocks are stitched together. Only summaries take part in the scan, a row per block.

`write` makes such files from documents. A task writes a file of its own name on each attempt and
returns what it holds, so files of lost attempts are never read.

Defined cases: null and empty texts have no tokens, and end at once. What stands behind the last
end id of a file is a document that has not ended. Empty files have no documents. Bytes that do
not fill an id at the end of a file raise an error. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.arrows import checkpointed, quoted, set_checkpoint_dir, texts_of

BLOCK_BYTES = 16 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: how texts are cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """A byte-pair vocabulary."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def width_of(end_id: int) -> str:
    """The narrowest type of ids up to the end-of-document id."""
    return "<u2" if end_id < 1 << 16 else "<u4"


def _opened(path: str):
    """The file system of a path as Spark writes it, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _written(batches: Iterator[pa.RecordBatch], folder: str, vocabulary) -> Iterator[pa.RecordBatch]:
    import tiktoken

    known = vocabulary.value
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
    end_id = len(known)
    kind = width_of(end_id)
    end = np.array([end_id], kind).tobytes()
    system, place = _opened(folder)
    name = f"tokens-{uuid.uuid4().hex}.bin"
    ordinal = 0
    with system.open_output_stream(f"{place}/{name}") as out:
        for batch in batches:
            for text in texts_of(batch.column("text")):
                if text:
                    out.write(np.array(encoding.encode_ordinary(text.decode()), dtype=kind).tobytes())
                out.write(end)
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n), pa.int64())],
                names=["id", "file", "ordinal"],
            )
            ordinal += n


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents as token files below a shared folder; where each went: id, file, ordinal."""
    spark = docs.sparkSession
    system, place = _opened(folder)
    system.create_dir(place, recursive=True)
    known = spark.sparkContext.broadcast(ranks(vocabulary))
    rows = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(lambda b: _written(b, folder, known), f"id {kind}, file string, ordinal bigint")
    return checkpointed(placed).withColumnRenamed("id", id)


def _scanned(batches: Iterator[pa.RecordBatch], end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """For each block, its ids and the places of the end ids in it."""
    for batch in batches:
        for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size"))):
            system, place = _opened(path)
            with system.open_input_file(place) as file:
                data = np.frombuffer(file.read_at(size, offset), dtype=kind)
            ends = np.flatnonzero(data == end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([offset], pa.int64()), pa.array([len(data)], pa.int64()),
                 pa.array([ends], pa.list_(pa.int64()))],
                names=["path", "offset", "n", "ends"],
            )


def scan(spark: SparkSession, folder: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document of the token files of a folder: file, ordinal, start, n_tokens, ended.

    Ordinal and start count documents and ids from the beginning of the file.
    """
    kind = width_of(end_id)
    width = np.dtype(kind).itemsize
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("ids are cut in "), F.col("path"))).cast("bigint")
    )
    offsets = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes).cast("bigint"))
    blocks = (
        files.withColumn("length", whole)
        .where("length > 0")
        .select("path", "length", F.explode(offsets).alias("offset"))
        .select("path", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).cast("bigint").alias("size"))
        .repartition("path", "offset")
    )
    found = blocks.mapInArrow(
        lambda b: _scanned(b, end_id, kind), "path string, offset bigint, n bigint, ends array<bigint>"
    )
    found = checkpointed(found.withColumn("at", (F.col("offset") / width).cast("bigint")).drop("offset"))
    # the prefix scan: what came before each block of a file
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("path").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    summary = found.select("path", "at", F.size("ends").cast("bigint").alias("count"), (F.col("at") + F.try_element_at("ends", F.lit(-1))).alias("last"))
    before = checkpointed(
        summary.select(
            "path", "at",
            F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("documents"),
            F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("open"),
            F.count("at").over(later).alias("blocks_after"),
        )
    )
    stitched = found.join(before, ["path", "at"])
    stops = F.transform("ends", lambda e: e + F.col("at"))
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + F.col("at") + 1))
    # behind the last end id of the file, a document that has not ended
    rest = F.when((F.col("blocks_after") == 0) & (F.element_at("starts", -1) < F.col("at") + F.col("n")), F.array(F.col("at") + F.col("n")))
    stitched = stitched.select("path", "at", "n", "documents", "blocks_after", stops.alias("stops"), starts.alias("starts"))
    zipped = F.arrays_zip(
        F.slice("starts", 1, F.size("stops") + F.size(F.coalesce("rest", F.array().cast("array<bigint>")))).alias("start"),
        F.concat("stops", F.coalesce("rest", F.array().cast("array<bigint>"))).alias("stop"),
    )
    rows = stitched.withColumn("rest", rest).select(
        "path", "documents", F.size("stops").alias("ended"), F.posexplode(zipped).alias("k", "d")
    )
    return rows.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        (F.col("documents") + F.col("k")).alias("ordinal"),
        F.col("d.start").alias("start"),
        (F.col("d.stop") - F.col("d.start")).alias("n_tokens"),
        (F.col("k") < F.col("ended")).alias("ended"),
    )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: id, n_tokens; by way of token files in the shared checkpoint folder.

    The files, two bytes for each token, stay there as long as the result may be read.
    """
    spark = docs.sparkSession
    folder = f"{set_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    placed = write(docs, folder, vocabulary, id, text)
    counted = scan(spark, folder, len(ranks(vocabulary)), block_bytes)
    return placed.join(counted, ["file", "ordinal"]).select(id, "n_tokens")
