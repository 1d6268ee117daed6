"""Benchmark decontamination with suffix arrays.

Each shard of training texts gets a suffix array over its words; every suffix of every benchmark
item is searched in it by bisection. A window is `size` consecutive words of an item, or the whole
of an item that has fewer; words of a document inside an occurrence of a window are hit.

Documents never move between tasks: a shard is what a task reads, about 16 MB of text at a time.
Benchmark items go to all tasks in blocks of at most BLOCK_BYTES; for each further block, the
documents go through a further pass of the same kind, in the same stage.

The longest match of a document is the longest run of words that some item holds verbatim, of at
least `size` words or a whole item; of equal ones the first in the text, and of items that hold it
the first by name. It is found by bisection in the ordered suffixes of the items, the lengths of
matches by hashes of stretches, so that a long match costs no more than the logarithm of its words.

Words: A-Z lower-cased, then maximal runs of a-z, 0-9 and characters beyond ASCII.

Defined cases: a null or empty text has no words and no hits. Items without words match nothing.
The hits of items with a null id count, but such items are not listed. Repeated documents each
get a row; repeated items count once. Further columns are ignored by `contamination` and kept by
`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import lists, quoted, shards, text_bytes, texts_of

BLOCK_BYTES = 16 << 20

HITS = (
    "n_words long, spans array<struct<start:int,end:int>>, items array<string>, "
    "longest_words int, longest_item string, longest_start int"
)


MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of tokens in the order of the `depth` tokens from there on, by doubling of prefixes."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and n and rank.max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank, kind="stable")


def powers(base: int, n: int) -> np.ndarray:
    """Powers of a number from 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Line:
    """Tokens, and sums of prefixes that give the hash of any stretch of them."""

    tokens: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray) -> Line:
        terms = W.mixed(tokens.astype(np.int64).view(np.uint64)) * powers(MULTIPLIER, len(tokens))
        return Line(tokens, np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))))


def agreeing(one: Line, at, other: Line, place, most: int, inverse: np.ndarray) -> np.ndarray:
    """How many tokens agree from `at` in one line and from `place` in another, up to 2 * most - 1.

    The length grows by halving steps as long as the hashes of the stretches agree, so that a match
    of n words costs log n comparisons.
    """
    length = np.zeros(len(at), dtype=np.int64)
    room = np.minimum(len(one.tokens) - at, len(other.tokens) - place)
    step = 1 << max(most, 1).bit_length() - 1
    while step:
        tried = np.minimum(length + step, room)
        mine = (one.sums[at + tried] - one.sums[at]) * inverse[at]
        theirs = (other.sums[place + tried] - other.sums[place]) * inverse[place]
        length = np.where((mine == theirs) & (length + step <= room), tried, length)
        step //= 2
    return length


def bisect(line: Line, order, probe: Line, at, low, high, cut, inverse, upper: bool) -> np.ndarray:
    """How many suffixes of a line, of those from low to high in order, stand before each suffix of
    the probe cut to `cut` tokens; with `upper`, those that begin with it count too."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    most = int(cut.max()) if len(cut) else 1
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        middle = (low[todo] + high[todo]) // 2
        place, begin = order[middle], at[todo]
        same = agreeing(line, place, probe, begin, most, inverse)
        whole = same >= cut[todo]
        # a line ends in a token that no probe has, so one token differs within both
        same = np.where(whole, 0, same)
        before = np.where(whole, upper, line.tokens[place + same] < probe.tokens[begin + same])
        low[todo[before]] = middle[before] + 1
        high[todo[~before]] = middle[~before]


@dataclass
class Tests:
    """Suffixes of benchmark items in order, and their distinct windows as ranges of that order."""

    vocabulary: np.ndarray  # sorted hashes of words; token i is vocabulary[i - 1]
    line: Line  # all items, a zero after each
    order: np.ndarray  # places of all suffixes
    item: np.ndarray  # item of each suffix, in order
    low: np.ndarray  # of each distinct window, the first suffix that begins with it
    high: np.ndarray  # and the one after the last
    size: np.ndarray  # words of each distinct window
    owner_first: np.ndarray  # of each distinct window, where its items begin in owners
    owners: np.ndarray
    full: int  # the first windows have all words; the others are whole items of fewer
    names: list[str | None]  # sorted, none last; items are numbers of names
    longest: int  # words of the longest item

    @property
    def least(self) -> int:
        return int(self.size.min())


def suffixes(names: list[str | None], texts: list[bytes | None], size: int) -> Tests | None:
    """All windows of some items; None when no item has a word.

    Memory is proportional to the words of the items, however uneven their lengths.
    """
    found = W.split(texts, W.LETTERS_DIGITS, lower=True)
    n = len(found.start)
    if not n:
        return None
    distinct = sorted(set(names), key=lambda name: (name is None, name or ""))
    number = {name: i for i, name in enumerate(distinct)}
    vocabulary, token = np.unique(found.hashes(), return_inverse=True)
    counts, owner = found.counts, found.owner()
    longest = int(counts.max())
    # a zero after each item ends every comparison there
    tokens = np.zeros(n + len(counts), dtype=np.int32)
    where = np.arange(n) + owner
    tokens[where] = token + 1
    line = Line.of(tokens)
    inverse = powers(pow(MULTIPLIER, -1, 1 << 64), len(tokens) + 1)
    left = np.zeros(len(tokens), dtype=np.int64)
    left[where] = (found.first[1:][owner] - np.arange(n)).astype(np.int64)
    order = suffix_array(tokens, longest + 1)
    order = order[tokens[order] > 0]
    item_of = np.zeros(len(tokens), dtype=np.int32)
    item_of[where] = np.array([number[name] for name in names], dtype=np.int32)[owner]
    item = item_of[order]
    # suffixes that begin with one full window stand together
    full = np.flatnonzero(left[order] >= size)
    begin = order[full]
    key = (line.sums[begin + size] - line.sums[begin]) * inverse[begin]
    new = np.ones(len(full), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    low, of_full = full[new], np.cumsum(new) - 1
    high = full[np.append(np.flatnonzero(new)[1:], len(full)) - 1] + 1 if len(full) else full
    # items of fewer words are windows as they are
    short = np.flatnonzero((counts > 0) & (counts < size))
    place, cut = (found.first[:-1] + np.arange(len(counts)))[short], counts[short]
    ends = np.zeros(len(short), np.int64), np.full(len(short), len(order))
    short_low = bisect(line, order, line, place, *ends, cut, inverse, upper=False)
    short_high = bisect(line, order, line, place, *ends, cut, inverse, upper=True)
    (_, one, of_short) = np.unique(short_low * size + cut, return_index=True, return_inverse=True)
    pairs = np.unique(
        np.concatenate((of_full, of_short.ravel() + len(low))).astype(np.int64) * len(distinct)
        + np.concatenate((item[full], item_of[place]))
    )
    sizes = np.concatenate((np.full(len(low), size), cut[one])).astype(np.int64)
    return Tests(
        vocabulary,
        line,
        order,
        item,
        np.concatenate((low, short_low[one])),
        np.concatenate((high, short_high[one])),
        sizes,
        np.searchsorted(pairs // len(distinct), np.arange(len(sizes) + 1)),
        pairs % len(distinct),
        len(low),
        distinct,
        longest,
    )


def search(texts: list[bytes | None], tests: Tests):
    """Words, the shard, and occurrences of windows (place in the shard, window, word).

    Only runs of words that all occur in the benchmark, and are as long as its shortest window,
    can hold an occurrence; the suffix array covers just these.
    """
    found = W.split(texts, W.LETTERS_DIGITS, lower=True)
    n = len(found.start)
    word = found.hashes()
    at = np.minimum(np.searchsorted(tests.vocabulary, word), len(tests.vocabulary) - 1)
    token = np.where(tests.vocabulary[at] == word, at + 1, 0).astype(np.int32) if n else np.zeros(0, np.int32)
    owner = found.owner()
    known = token > 0
    # runs of known words within one text
    new = np.ones(n, dtype=bool)
    new[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(new) - 1
    length = np.bincount(run) if n else np.zeros(0, np.int64)
    use = np.flatnonzero(known & (length[run] >= tests.least)) if n else np.zeros(0, np.int64)
    # after each run a token that no item has
    gap = np.cumsum(new[use]) - 1 if len(use) else use
    tokens = np.full(len(use) + int(gap[-1]) + 1 if len(use) else 1, -1, dtype=np.int32)
    where = np.arange(len(use)) + gap
    tokens[where] = token[use]
    back = np.zeros(len(tokens), dtype=np.int64)
    back[where] = use
    shard = Line.of(tokens)
    order = suffix_array(tokens, int(tests.size.max()))
    order = order[tokens[order] > 0]
    inverse = powers(pow(MULTIPLIER, -1, 1 << 64), max(len(tokens), len(tests.line.tokens)) + 1)
    begin = tests.order[tests.low]
    ends = np.zeros(len(begin), np.int64), np.full(len(begin), len(order))
    low = bisect(shard, order, tests.line, begin, *ends, tests.size, inverse, upper=False)
    high = bisect(shard, order, tests.line, begin, low, ends[1], tests.size, inverse, upper=True)
    count = high - low
    hit = np.flatnonzero(count)
    window = np.repeat(hit, count[hit])
    inner = np.arange(len(window)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    place = order[np.repeat(low[hit], count[hit]) + inner] if len(window) else np.zeros(0, np.int64)
    return found, owner, shard, place, window, back[place], inverse


def longest_matches(shard: Line, place, window, tests: Tests, inverse) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a window, the most words that agree with any item that has it, and a
    suffix (in order) that agrees so far.

    Among the suffixes of items that begin with a full window, those next to the words of the shard
    in order agree with them longest. An item of fewer words agrees as a whole.
    """
    all_words, suffix = tests.size[window].copy(), tests.low[window]
    full = np.flatnonzero(window < tests.full)
    place, low, high = place[full], suffix[full], tests.high[window[full]]
    whole = np.full(len(place), tests.longest + 1)
    at = bisect(tests.line, tests.order, shard, place, low, high, whole, inverse, upper=False)
    best, which = np.zeros(len(place), np.int64), low.copy()
    for beside in (at - 1, at):
        inside = np.flatnonzero((beside >= low) & (beside < high))
        same = agreeing(shard, place[inside], tests.line, tests.order[beside[inside]], tests.longest, inverse)
        more = same > best[inside]
        best[inside[more]], which[inside[more]] = same[more], beside[inside[more]]
    all_words[full], suffix[full] = best, which
    return all_words, suffix


def first_items(tests: Tests, which, words, inverse) -> list[str | None]:
    """The first item, in the order of names, that holds the first `words` words of a suffix."""
    ends = np.zeros(len(which), np.int64), np.full(len(which), len(tests.order))
    place = tests.order[which]
    low = bisect(tests.line, tests.order, tests.line, place, *ends, words, inverse, upper=False)
    high = bisect(tests.line, tests.order, tests.line, place, low, ends[1], words, inverse, upper=True)
    known: dict[tuple[int, int], str | None] = {}
    for ends in set(zip(low.tolist(), high.tolist())):
        known[ends] = tests.names[tests.item[slice(*ends)].min()]
    return [known[ends] for ends in zip(low.tolist(), high.tolist())]


def hits_of(texts: list[bytes | None], tests: Tests | None):
    """Per text: words, hit stretches, items and the longest match."""
    if tests is None:
        counts = W.split(texts, W.LETTERS_DIGITS, lower=True).counts
        return [(int(c), [], [], 0, None, None) for c in counts]
    found, owner, shard, place, window, word_at, inverse = search(texts, tests)
    rows = [(int(n), [], [], 0, None, None) for n in found.counts]
    if not len(place):
        return rows
    covered = W.spans(word_at, word_at + tests.size[window], len(found.start))
    size, which = longest_matches(shard, place, window, tests, inverse)
    # occurrences by text, the longest and then the first in front
    by_text = np.lexsort((word_at, -size, owner[word_at]))
    text = owner[word_at][by_text]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    best = by_text[first]
    names = np.array([tests.names[tests.owners[tests.owner_first[w]]] for w in window[best]], dtype=object)
    full = np.flatnonzero(window[best] < tests.full)
    names[full] = first_items(tests, which[best[full]], size[best[full]], inverse)
    for d, begin, end, top, name in zip(text[first], first, [*first[1:], len(text)], best, names):
        start = found.first[d]
        flags = np.concatenate(([0], covered[start : found.first[d + 1]].astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(flags))
        own = np.unique(window[by_text[begin:end]])
        items = {i for w in own for i in tests.owners[tests.owner_first[w] : tests.owner_first[w + 1]].tolist()}
        rows[d] = (
            int(found.counts[d]),
            [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])],
            [tests.names[i] for i in sorted(items) if tests.names[i] is not None],
            int(size[top]),
            name,
            int(word_at[top] - start),
        )
    return rows


def _joined(old, new):
    """The hits of one text against two blocks of items."""
    spans: list[dict] = []
    for s in sorted(old[1] + new[1], key=lambda s: s["start"]):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(dict(s))
    longest = min((old, new), key=lambda r: (-r[3], r[5] or 0, r[4] is None, r[4] or ""))
    return (new[0], spans, sorted({*old[2], *new[2]}), *longest[3:])


def _blocks(benchmark: DataFrame, item: str, text: str, size: int, limit: int):
    """Broadcasts of the windows of benchmark items, each from at most about `limit` bytes of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(text)).alias("text"))
    n = max(1, -(-text_bytes(items, "text") // limit))
    for block in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block)
        got = own.toArrow()
        yield spark.sparkContext.broadcast(
            suffixes(got.column("item").to_pylist(), texts_of(got.column("text")), size)
        )


_PART = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _scan(tests, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hits of a block to what earlier blocks have found."""
    for table in shards(batches, "text"):
        rows = hits_of(texts_of(table.column("text")), tests.value)
        if table.column("n_words").null_count < len(table):
            earlier = zip(*(table.column(c).to_pylist() for c in table.column_names[2:]))
            rows = [_joined(a, b) for a, b in zip(earlier, rows)]
        columns = list(zip(*rows))
        flat = [s for r in columns[1] for s in r]
        yield from pa.table(
            {
                "id": table.column("id"),
                "text": table.column("text"),
                "n_words": pa.array(columns[0], pa.int64()),
                "spans": lists(pa.array(flat, _PART), np.array([len(r) for r in columns[1]]), _PART),
                "items": pa.array(columns[2], pa.list_(pa.string())),
                "longest_words": pa.array(columns[3], pa.int32()),
                "longest_item": pa.array(columns[4], pa.string()),
                "longest_start": pa.array(columns[5], pa.int32()),
            }
        ).to_batches()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: its words, the stretches hit, the items found, the longest match.

    Columns: the id column, n_words, spans (of words; end exclusive), items (ids as strings,
    sorted), longest_words, longest_item, longest_start (the first word of the match).
    """
    fields = [c.split(" ", 1) for c in HITS.split(", ")]
    found = docs.select(
        F.col(quoted(id)).alias("id"),
        F.col(quoted(text)).alias("text"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in fields),
    )
    kind = found.schema["id"].dataType.simpleString()
    for tests in _blocks(benchmark, item, item_text, size, block_bytes):
        found = found.mapInArrow(
            lambda batches, tests=tests: _scan(tests, batches), f"id {kind}, text string, {HITS}"
        )
    return found.select(F.col("id").alias(id), *(name for name, _ in fields))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""

    def clean(tests, batches):
        for table in shards(batches, text):
            rows = hits_of(texts_of(table.column(text)), tests.value)
            yield from table.filter(pa.array([not r[1] for r in rows], pa.bool_())).to_batches()

    for tests in _blocks(benchmark, item, item_text, size, block_bytes):
        docs = docs.mapInArrow(lambda batches, tests=tests: clean(tests, batches), docs.schema)
    return docs


def digest(items: Column) -> Column:
    """SHA-256 of comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)
