"""Quality rules: fixed limits, and robust outliers among documents of one language and source.

The statistics of each document are transformed to a vector. For each language and source, the
minimum covariance determinant gives centre and scatter: from medians and deviations from them,
concentration steps keep the half of the rows with the smallest Mahalanobis distances and estimate
again from it. A document whose distance to its group lies beyond the cutoff is rejected.

All rows take part in every step. Distances are binned; counts and sums of each bin are integers
(vectors are held in thousandths), so they add up to the same numbers in every order, and a half
of the rows is the fewest leading bins that hold it. Groups are never gathered: Spark combines
their bins in each task before it shuffles them.

Words: maximal runs of characters other than space and \\x09-\\x0D.

Defined cases: null and empty texts have no words and fail the fixed limits. Null languages and
sources are values of their own. Groups with too few rows that pass the fixed limits are pooled by
language, and those still too small by all; a pool that is too small rejects nothing. Repeated rows
each count and each give a row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import beside, checkpointed, quoted, shards, texts_of, told_apart

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))

STATISTICS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur again in their text, and which of them are not the first."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later = np.zeros(len(hashes), dtype=bool)
    later[order[1:][same]] = True
    any_ = later.copy()
    any_[order[:-1][same]] = True
    return any_, later


def measured(texts: list[bytes | None]) -> list[np.ndarray]:
    """The statistics of each text."""
    found = W.split(texts)
    n = len(texts)
    data, offset = found.data, found.offset

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offset[1:]] - total[offset[:-1]]

    inside = W.NOT_WHITE[data]
    chars = per_text(inside & ((data & 0xC0) != 0x80))
    breaks = np.flatnonzero(data[: offset[-1]] == 0x0A)
    start, end = breaks[:-1] + 1, breaks[1:]
    line_owner = np.searchsorted(offset, start, side="right") - 1
    worded = np.concatenate(([0], np.cumsum(inside)))
    worded = worded[end] > worded[start]
    start, end, line_owner = start[worded], end[worded], line_owner[worded]
    _, later = _repeated(W.hashed(data, start, end), line_owner)
    windows, whole = found.windows(3)
    at = np.flatnonzero(whole)
    owner = found.owner()
    again, _ = _repeated(windows[at], owner[at])
    covered = W.spans(at[again], at[again] + 3, len(found.start))
    count = lambda rows: np.bincount(rows, minlength=n).astype(np.int64)
    return [found.counts, chars, per_text(_SYMBOL[data]), count(line_owner), count(line_owner[later]), count(owner[covered])]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """The rows, and a struct of the statistics of their texts."""
    fields = [f.split(" ")[0] for f in STATISTICS.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, text):
            texts = texts_of(table.column(text))
            parts = [measured(texts[a:b]) for a, b in W.pieces(texts)]
            columns = [pa.array(np.concatenate(p), pa.int64()) for p in zip(*parts)]
            struct = pa.StructArray.from_arrays(columns, fields)
            yield from table.append_column(name, struct).to_batches()

    kind = F.lit(None).cast("struct<" + STATISTICS.replace(" long", ":bigint") + ">")
    return docs.mapInArrow(add, docs.withColumn(name, kind).schema)


# Rows that a group needs for estimates of its own.
LEAST_ROWS = 100
# Squared distance beyond which a document is rejected: chi-square with 4 degrees of freedom has
# a tail of 4e-8 there.
CUTOFF = 40.0
STEPS = 4

# Transformed statistics are held in thousandths. Their scatter is not taken to be smaller than
# these standard deviations, so that a group without any variation keeps what is merely unusual:
# up to 13% symbols a word, or 28% duplicate lines or repeated words. Each is above the step of
# one symbol or one repeated window in the shortest text that the fixed limits keep.
FEATURES = {
    "word_length": 50.0,
    "symbols": 20.0,
    "dup_lines": 40.0,
    "repeat_words": 40.0,
}
_N = len(FEATURES)
_FLOOR = np.array(list(FEATURES.values()))
_BIN = 10  # width of the bins of the medians, in thousandths
_PAIRS = [(i, j) for i in range(_N) for j in range(i, _N)]


def _consistency() -> float:
    """What makes the scatter of the inner half of a normal sample that of the whole.

    The half has the squared radius q, the median of chi-square with 4 degrees of freedom; the
    factor is the half divided by chi-square's share below q with 6 degrees of freedom.
    """
    four = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2)
    six = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2 + x * x / 8)
    low, high = 0.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if four(middle) < 0.5 else (low, middle)
    return 0.5 / six(low)


CONSISTENCY = _consistency()


def base_failed(s: Column) -> Column:
    """Fewer than 50 words, or over half of them in windows of 3 words that occur again."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Transformed statistics of texts with words, in thousandths."""
    words = s["n_words"].cast("double")
    values = {
        "word_length": F.log(s["word_chars"] / words),
        "symbols": F.log1p(s["n_symbols"] / words),
        "dup_lines": F.log1p(s["n_dup_lines"] / s["n_lines"].cast("double")),
        "repeat_words": F.log1p(s["n_repeat_words"] / words),
    }
    return [F.round(1000 * v).cast("bigint").alias(k) for k, v in values.items()]


_ESTIMATE = "group bigint, n bigint, centre array<double>, weight array<double>"


def _estimated(group: int, n: int, centre: np.ndarray, scatter: np.ndarray) -> dict:
    return {
        "group": group,
        "n": n,
        "centre": [float(c) for c in centre],
        "weight": [float(w) for w in np.linalg.inv(scatter).ravel()],
    }


def _floored(scatter: np.ndarray) -> np.ndarray:
    """The scatter, at least that of the floors in every direction; the floor of word lengths adds to theirs."""
    scatter = scatter.copy()
    scatter[0, 0] += _FLOOR[0] ** 2
    value, vector = np.linalg.eigh(scatter / np.outer(_FLOOR, _FLOOR))
    return (vector * np.maximum(value, 1.0)) @ vector.T * np.outer(_FLOOR, _FLOOR)


def _started(table: pa.Table) -> pa.Table:
    """Medians and quartile ranges of a group, from counts of bins."""
    group, n = table.column("group")[0].as_py(), 0
    centre, scale = np.zeros(_N), np.zeros(_N)
    feature, place, count = (table.column(c).to_numpy() for c in ("feature", "place", "count"))
    for k in range(_N):
        order = np.flatnonzero(feature == k)
        order = order[np.argsort(place[order])]
        total = np.cumsum(count[order])
        n = int(total[-1])
        q = [(place[order][np.searchsorted(total, n * p)] + 0.5) * _BIN for p in (0.25, 0.5, 0.75)]
        centre[k], scale[k] = q[1], (q[2] - q[0]) / 1.349
    return pa.Table.from_pylist([_estimated(group, n, centre, _floored(np.diag(scale**2)))], schema=_arrow(_ESTIMATE))


def _concentrated(table: pa.Table) -> pa.Table:
    """Mean and scatter of the fewest leading bins that hold half of the rows."""
    table = table.sort_by("place")
    count = table.column("count").to_numpy()
    total = np.cumsum(count)
    last = int(np.searchsorted(total, (total[-1] + 1) // 2)) + 1
    half = float(total[last - 1])
    mean = np.array([float(sum(table.column(f"s{i}").to_pylist()[:last])) / half for i in range(_N)])
    scatter = np.zeros((_N, _N))
    for i, j in _PAIRS:
        mean_ij = float(sum(table.column(f"s{i}{j}").to_pylist()[:last])) / half
        scatter[i, j] = scatter[j, i] = mean_ij - mean[i] * mean[j]
    group = table.column("group")[0].as_py()
    row = _estimated(group, int(total[-1]), mean, _floored(CONSISTENCY * scatter))
    return pa.Table.from_pylist([row], schema=_arrow(_ESTIMATE))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def _distance(values: list[Column]) -> Column:
    gap = [v - F.col("centre")[i] for i, v in enumerate(values)]
    parts = [
        gap[i] * gap[j] * F.col("weight")[i * _N + j] * (1 if i == j else 2) for i, j in _PAIRS
    ]
    return F.greatest(sum(parts[1:], parts[0]), F.lit(0.0))


class Rules:
    """Groups of a corpus and their estimates."""

    def __init__(self, groups: DataFrame, estimates: DataFrame, n_groups: int, cutoff: float):
        self.groups, self.estimates, self.n_groups, self.cutoff = groups, estimates, n_groups, cutoff

    def judged(self, rows: DataFrame, lang: str, source: str, statistics: str, failed: str, distance: str) -> DataFrame:
        """The rows with base_failed and the squared distance, null where there is none."""
        s = F.col(quoted(statistics))
        rows = _grouped(rows, self.groups, self.n_groups, lang, source)
        rows = beside(rows, self.estimates, "group", self.n_groups)
        near = F.when(~base_failed(s) & F.col("centre").isNotNull(), _distance(vector(s)))
        return rows.withColumn(failed, base_failed(s)).withColumn(distance, near).drop("group", "n", "centre", "weight")


def _grouped(rows: DataFrame, groups: DataFrame, n_groups: int, lang: str, source: str) -> DataFrame:
    """The rows with the number of their group."""
    key = F.xxhash64(*told_apart(F.col(quoted(lang)), F.col(quoted(source))))
    return beside(rows.withColumn("lang_source", key), groups, "lang_source", n_groups).drop("lang_source")


def fit(stats: DataFrame, lang: str, source: str, statistics: str, least_rows: int = LEAST_ROWS, cutoff: float = CUTOFF) -> Rules:
    """Estimates of every group from rows with a column of statistics, which are read several times."""
    s = F.col(quoted(statistics))
    rows = stats.where(~base_failed(s)).select(
        F.xxhash64(*told_apart(F.col(quoted(lang)), F.col(quoted(source)))).alias("lang_source"),
        F.xxhash64(*told_apart(F.col(quoted(lang)))).alias("lang"),
        *vector(s),
    )
    sizes = checkpointed(rows.groupBy("lang_source", "lang").agg(F.count("*").alias("n")))
    n_groups = sizes.count()
    own = F.col("n") >= least_rows
    pooled = sizes.where(~own).groupBy("lang").agg(F.sum("n").alias("pool"))
    group = (
        F.when(own, F.xxhash64(F.lit(1), "lang_source"))
        .when(F.col("pool") >= least_rows, F.xxhash64(F.lit(2), "lang"))
        .otherwise(F.lit(3).cast("bigint"))
    )
    groups = checkpointed(sizes.join(pooled, "lang", "left").select("lang_source", group.alias("group")))
    rows = checkpointed(beside(rows, groups, "lang_source", n_groups).select("group", *FEATURES))
    places = F.array(*(F.struct(F.lit(k).alias("feature"), F.floor(F.col(c) / _BIN).alias("place")) for k, c in enumerate(FEATURES)))
    estimates = checkpointed(
        rows.select("group", F.explode(places).alias("p"))
        .groupBy("group", "p.feature", "p.place")
        .agg(F.count("*").alias("count"))
        .groupBy("group")
        .applyInArrow(_started, _ESTIMATE)
        .where(F.col("n") >= least_rows)
    )
    columns = [F.col(c) for c in FEATURES]
    for _ in range(STEPS):
        near = beside(rows, estimates, "group", n_groups).where("n is not null")
        place = F.least(F.floor(16 * F.log2(1 + _distance(columns))), F.lit(400)).alias("place")
        binned = near.select("group", place, *FEATURES).groupBy("group", "place").agg(
            F.count("*").alias("count"),
            *(F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)),
            *(F.sum(columns[i] * columns[j]).alias(f"s{i}{j}") for i, j in _PAIRS),
        )
        estimates = checkpointed(binned.groupBy("group").applyInArrow(_concentrated, _ESTIMATE))
    return Rules(groups, estimates, n_groups, cutoff)


def quality(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_rows: int = LEAST_ROWS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """A row per document: id, the statistics, base_failed, distance (squared; null where the
    limits already reject, or the pool is too small) and kept."""
    rows = docs.select(
        F.col(quoted(id)).alias("id"),
        F.col(quoted(text)).alias("text"),
        F.col(quoted(lang)).alias("lang"),
        F.col(quoted(source)).alias("source"),
    )
    stats = checkpointed(with_statistics(rows).drop("text"))
    rules = fit(stats, "lang", "source", "statistics", least_rows, cutoff)
    judged = rules.judged(stats, "lang", "source", "statistics", "base_failed", "distance")
    return judged.select(
        F.col("id").alias(id),
        "statistics.*",
        "base_failed",
        "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))).alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_rows: int = LEAST_ROWS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """The documents, with all their columns, that `quality` keeps. Texts are measured twice and
    never shuffled."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, inner))
    measured_rows = with_statistics(docs.toDF(*inner), of[text])
    stats = checkpointed(measured_rows.select(of[lang], of[source], "statistics"))
    rules = fit(stats, of[lang], of[source], "statistics", least_rows, cutoff)
    judged = rules.judged(measured_rows, of[lang], of[source], "statistics", "base_failed", "distance")
    good = judged.where(~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))
    return good.select(*inner).toDF(*docs.columns)
