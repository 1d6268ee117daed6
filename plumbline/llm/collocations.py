"""Phrases of a corpus by SETM: sorted relations of occurrences, merged, counted, filtered, extended.

1. The occurrences of all words are persisted once, sorted by piece and position, in blocks of
   about `BLOCK_BYTES` of text and one language. A block holds its distinct words, and for every
   occurrence the number of its word and whether a piece begins there.
2. Extension: an occurrence of a phrase is merged with the occurrence of a word at the next position
   of the same piece. Both relations are sorted alike, so that this is one pass over a block.
3. Group-count: every block sends its distinct phrases with their counts, packed by leading bits of
   their hashes. Spark gathers the blocks of each such bucket, where the counts are added.
4. Semi-join: a bucket returns to each block one bit for every phrase it sent: whether the phrase is
   frequent. These bits are persisted; only occurrences of frequent phrases are extended next.
5. Phrases of the greatest length, and the frequent shorter ones, are added up as rows. Scores come
   from joins of the frequent phrases with the counts of their parts.

A phrase that makes up a third of the corpus is sent once per block, not once per occurrence. Blocks
and buckets grow in number with the input, not in size. Words are told apart by 64-bit hashes, and
so are phrases while they are filtered; two different ones are taken for equal with a probability
below n / 2**64 for each, n being all of them.

Texts: A-Z lower-cased, split at `[.,;:!?\\x0A-\\x0D]` into pieces and these at spaces and tabs into
words. Defined cases: null and empty texts have no words; a null language is `und`. Every row
counts, repeated ones too; ids and further columns are ignored. A language without candidates, and
an empty table, give no rows. A text is never cut: one longer than a block makes blocks of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import checkpointed, quoted, shards, texts_of
from plumbline.llm.repeats import packed, unpacked

BLOCK_BYTES = 16 << 20
BUCKET_PHRASES = 1 << 20
SCALE = 1_000_000  # of scores
TOP_ROWS = 50_000  # candidates that a task ranks at first

_BREAKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORDS = ~(_BREAKS | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8)))
_MUL = np.uint64(0x9E3779B97F4A7C15)

_OCCURRENCES = (
    "block bigint, lang string, n bigint, codes binary, names array<string>, counts binary, places binary, begins binary"
)
_SENT = "bucket bigint, block bigint, keys binary, counts binary"
_RETURNED = "block bigint, level int, bucket bigint, frequent binary, own binary, totals binary"


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers, each in as many bytes as the largest needs, after one byte for these."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes) -> np.ndarray:
    width = data[0]
    few = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(few), 8), dtype=np.uint8)
    wide[:, :width] = few
    return wide.view("<i8").ravel()


def words_of(texts: list[bytes | None]) -> tuple[W.Words, np.ndarray]:
    """All words, and whether a piece begins with each."""
    found = W.split(texts, _WORDS, lower=True)
    breaks = np.flatnonzero(_BREAKS[found.data])
    piece = np.searchsorted(breaks, found.start)
    return found, np.diff(piece, prepend=-1) != 0


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for table in shards(batches, "text", BLOCK_BYTES):
        langs = table.column("lang").combine_chunks()
        for lang in pa.compute.unique(langs).to_pylist():
            texts = texts_of(table.filter(pa.compute.equal(langs, lang)).column("text"))
            seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
            hashes, begins, names = [], [], {}
            for a, b in W.pieces(texts):
                found, begin = words_of(texts[a:b])
                code = W.mixed(found.hashes() ^ seed)
                distinct, first = np.unique(code, return_index=True)
                text = found.data.tobytes()
                for c, s, e in zip(distinct.tolist(), found.start[first].tolist(), found.end[first].tolist()):
                    if c not in names:
                        names[c] = text[s:e].decode()
                hashes.append(code)
                begins.append(begin)
            codes, place, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([lang]),
                    pa.array([len(place)], pa.int64()),
                    pa.array([codes.tobytes()], pa.binary()),
                    pa.array([[names[c] for c in codes.tolist()]], pa.list_(pa.string())),
                    pa.array([_narrow(counts)], pa.binary()),
                    pa.array([_narrow(place)], pa.binary()),
                    pa.array([np.packbits(np.concatenate(begins)).tobytes()], pa.binary()),
                ],
                names=["block", "lang", "n", "codes", "names", "counts", "places", "begins"],
            )
            number += 1


class _Block:
    """The occurrences of a block, and those of its phrases of a growing length."""

    def __init__(self, row: dict):
        self.codes = np.frombuffer(row["codes"], dtype=np.uint64)
        self.place = _wide(row["places"])
        begins = np.unpackbits(np.frombuffer(row["begins"], np.uint8), count=len(self.place)).astype(bool)
        # whether a word of the same piece follows
        self.goes_on = np.zeros(len(self.place), dtype=bool)
        self.goes_on[:-1] = ~begins[1:]
        self.length = 1
        self.at = np.arange(len(self.place))  # where phrases begin
        self.group = self.place  # the number of the phrase, among distinct ones of the block
        self.hash = self.codes  # of each distinct phrase
        self.first = None  # an occurrence of each distinct phrase

    def extend(self) -> None:
        """Merges phrases with the words that follow them, by piece and position."""
        more = self.goes_on[self.at + self.length - 1]
        self.at = self.at[more]
        nxt = self.place[self.at + self.length]
        pair = self.group[more] * len(self.codes) + nxt
        distinct, first, group, self.count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        key = W.mixed(self.hash[distinct // max(len(self.codes), 1)] * _MUL + self.codes[distinct % max(len(self.codes), 1)])
        # in the order of hashes, as they are sent
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.hash, self.count, self.first = key[order], self.count[order], self.at[first[order]]
        self.group = rank[group]
        self.length += 1

    def keep(self, frequent: np.ndarray) -> None:
        """Occurrences of frequent phrases only."""
        kept = frequent[self.group]
        self.at, self.group = self.at[kept], self.group[kept]

    def words(self, phrases: np.ndarray) -> np.ndarray:
        """The words of distinct phrases: a row for each."""
        return self.codes[self.place[self.first[phrases][:, None] + np.arange(self.length)]]


def _cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that ascending hashes fall in, and where each begins and ends."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[cut], np.append(cut, len(hashes))


def _sent(block: int, of: _Block, bits: int) -> pa.RecordBatch:
    buckets, cut = _cuts(of.hash, bits)
    rest = np.uint64((1 << (64 - bits)) - 1)
    parts = list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets, pa.int64()),
            pa.array([block] * len(parts), pa.int64()),
            pa.array([packed(of.hash[a:b] & rest) for a, b in parts], pa.binary()),
            pa.array([_narrow(of.count[a:b]) for a, b in parts], pa.binary()),
        ],
        names=["bucket", "block", "keys", "counts"],
    )


def _pairs(bits: int):
    """The distinct pairs of words of each block, with their counts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                block.extend()
                yield _sent(row["block"], block, bits)

    return pairs


def _returned(level: int, least: int):
    return lambda table: _added(table, level, least)


def _added(table: pa.Table, level: int, least: int) -> pa.Table:
    """To each block, which of its phrases are frequent, and the totals of those it names to others.

    Of the blocks that hold a phrase, the one with the smallest number names it.
    """
    table = table.sort_by("block")
    parts = [unpacked(k) for k in table.column("keys").to_pylist()]
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keys = np.concatenate(parts)
    counts = np.concatenate([_wide(c) for c in table.column("counts").to_pylist()])
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, group, counts)
    frequent = total[group] >= least
    own = frequent & (np.arange(len(keys)) == first[group])
    bound = np.searchsorted(part, np.arange(len(parts) + 1))
    ranges = list(zip(bound[:-1], bound[1:]))
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "block": table.column("block"),
            "level": pa.array([level] * len(parts), pa.int32()),
            "bucket": pa.array([bucket] * len(parts), pa.int64()),
            "frequent": pa.array([np.packbits(frequent[a:b]).tobytes() for a, b in ranges], pa.binary()),
            "own": pa.array([np.packbits(own[a:b]).tobytes() for a, b in ranges], pa.binary()),
            "totals": pa.array([_narrow(total[group[a:b][own[a:b]]]) for a, b in ranges], pa.binary()),
        }
    )


def _replayed(row: dict, back: list[dict], bits: dict[int, int]) -> tuple[_Block, list[tuple[np.ndarray, np.ndarray]]]:
    """The block with occurrences of phrases that were frequent so far, extended once more; and the
    phrases of the last length that this block names, with their totals."""
    block, named = _Block(row), []
    for level in sorted(bits):
        block.extend()
        buckets, cut = _cuts(block.hash, bits[level])
        size = dict(zip(buckets.tolist(), np.diff(cut).tolist()))
        rows = {b["bucket"]: b for b in back if b["level"] == level}
        mask = lambda key: np.concatenate(
            [np.zeros(0, bool)]
            + [np.unpackbits(np.frombuffer(rows[b][key], np.uint8), count=n).astype(bool) for b, n in size.items()]
        )
        block.keep(mask("frequent"))
        if level == max(bits):
            totals = np.concatenate([np.zeros(0, np.int64)] + [_wide(rows[b]["totals"]) for b in size])
            named.append((block.words(np.flatnonzero(mask("own"))), totals))
    block.extend()
    return block, named


def _rows(lang: str, words: np.ndarray, counts: np.ndarray) -> pa.Table:
    n = len(words)
    offsets = np.arange(n + 1, dtype=np.int32) * (words.shape[1] if n else 0)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64).ravel(), pa.int64()))
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "words": lists, "a": pa.array(counts, pa.int64())})


def _named_and_last(bits: dict[int, int], last: bool):
    """Frequent phrases of the last counted length, and all that are longer by a word if these are
    the last ones."""

    def named_and_last(own: pa.Table, back: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block, named = _replayed(row, back.to_pylist(), bits)
        parts = [_rows(row["lang"], w, t) for w, t in named]
        if last:
            parts.append(_rows(row["lang"], block.words(np.arange(len(block.hash))), block.count))
        return pa.concat_tables(parts)

    return named_and_last


def _next_sent(bits: dict[int, int], next_bits: int):
    def next_sent(own: pa.Table, back: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block, _ = _replayed(row, back.to_pylist(), bits)
        return pa.Table.from_batches([_sent(row["block"], block, next_bits)])

    return next_sent


def _last_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            block.extend()
            yield from _rows(row["lang"], block.words(np.arange(len(block.hash))), block.count).to_batches()


def frequent_phrases(
    docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Words (lang, code, word, f, n) and phrases (lang, words, a) of `longest` words at most that
    occur `least` times or more in their language; n counts all words of the language."""
    rows = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text)).alias("text"))
    occurrences = checkpointed(rows.where("text is not null").mapInArrow(_occurrences, _OCCURRENCES))
    blocks = occurrences.select("block", "lang", "codes", "places", "begins")

    all_words = (
        occurrences.select("lang", "codes", "names", "counts")
        .mapInArrow(_counted_words, "lang string, code bigint, word string, f bigint")
        .groupBy("lang", "code", "word")
        .agg(F.sum("f").alias("f"))
        .where(F.col("f") >= least)
    )
    sizes = occurrences.groupBy("lang").agg(F.sum("n").alias("n"))
    words = checkpointed(all_words.join(sizes, "lang"))

    total = occurrences.agg(F.sum("n")).first()[0] or 0
    bits = {}
    back = None
    phrases = []
    schema = "lang string, words array<bigint>, a bigint"
    for level in range(2, longest):
        # buckets of about BUCKET_PHRASES phrases, if all phrases differ
        own_bits = max(1, int(np.ceil(np.log2(max(1, total / BUCKET_PHRASES)))))
        if back is None:
            sent = blocks.mapInArrow(_pairs(own_bits), _SENT)
        else:
            sent = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_next_sent(bits, own_bits), _SENT)
        found = checkpointed(sent.groupBy("bucket").applyInArrow(_returned(level, least), _RETURNED))
        bits = {**bits, level: own_bits}
        back = found if back is None else back.union(found)
        named = _named_and_last(bits, last=level + 1 == longest)
        phrases.append(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(named, schema))
    if longest == 2:
        phrases.append(blocks.mapInArrow(_last_pairs, schema))
    out = phrases[0]
    for more in phrases[1:]:
        out = out.union(more)
    counted = out.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, checkpointed(counted)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = np.frombuffer(row["codes"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * len(codes), pa.string()),
                    pa.array(codes, pa.int64()),
                    pa.array(row["names"], pa.string()),
                    pa.array(_wide(row["counts"]), pa.int64()),
                ],
                names=["lang", "code", "word", "f"],
            )


def collocations(
    docs: DataFrame,
    least: int = 10,
    longest: int = 3,
    covered: int = 50,
    top: int = 2000,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its weakest cut in two parts, floor(SCALE * a * a / (l * r)).
    Phrases inside a longer candidate that has at least `covered` percent of their count are left
    out. Order: score and count descending, then the phrase in the order of its bytes.
    """
    words, phrases = frequent_phrases(docs, least, longest, text, lang)
    counts = words.select("lang", F.array("code").alias("words"), F.col("f").alias("a")).union(phrases)
    size = F.size("words")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.slice("words", 1, F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("words").alias(side), F.col("a").alias(name))
        cuts = cuts.join(part, ["lang", side])
    cuts = cuts.select(
        "lang", "words", "a", "k", "l", "r", exact("a").alias("a_"), (exact("l") * exact("r")).cast("decimal(38,0)").alias("lr_")
    )
    product = f"cast(cast(a_ * a_ as decimal(38,0)) * {SCALE} as decimal(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"{product} div lr_"))
    scored = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = (
        phrases.where(size > 2)
        .select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
        .select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
        .select("lang", F.slice("words", F.col("i"), F.col("m")).alias("words"), "a")
        .groupBy("lang", "words")
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inner, ["lang", "words"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < exact("a") * covered)
    )
    spelt = (
        kept.select("lang", "words", "a", "cut", F.posexplode("words").alias("i", "code"))
        .join(words.select("lang", "code", "word", "n"), ["lang", "code"])
        .groupBy("lang", "words", "a", "cut", "n")
        .agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelt"))
    )
    named = checkpointed(
        spelt.select(
            "lang",
            F.array_join(F.col("spelt.word"), " ").alias("phrase"),
            "a",
            F.col("cut.l").alias("l"),
            F.col("cut.r").alias("r"),
            "n",
            F.col("cut.score").cast("bigint").alias("score"),
        )
    )
    # ranked in parts first, so that no task sorts all candidates of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = named.count() // TOP_ROWS + 1
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    named = named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = named.where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
