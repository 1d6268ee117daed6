"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words on either side of it, never from itself; a document's
score is the sum of the logarithms of these conditional probabilities.

The vocabulary is the most frequent words of the whole corpus; all other words share buckets by
their hash. A word of a bucket has the probability of the bucket divided by the distinct words of
the corpus in it, and one more for words never seen, so that the probabilities of all words add up
to one however large the corpus. The network embeds the four words of the window, feeds them through one hidden layer,
and predicts a class and then the word within the class, so that a prediction takes two short
softmaxes. It starts from the frequencies of words alone.

Training goes over the whole corpus in rounds. In each round, every task starts from the same
parameters, masks and predicts one word in `masked` of its documents, other words in each round,
and steps with Adagrad in numpy; the parameters of all tasks are then averaged by the words they
saw, in slices and in two levels, so that no task and not the driver sees more than the parameters
of a share of the tasks. What the driver holds is one vocabulary and one set of parameters, about
1.5 MB, whatever the corpus.

Words: A-Z lower-cased, then maximal runs of characters other than space and \\x09-\\x0D.

Defined cases: null and empty texts have no words and score 0, without a mean. Beyond the ends of
a text stands an empty word. An empty corpus has uniform frequencies. Repeated rows count and
score each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.arrows import checkpointed, quoted, shards, texts_of

CLASSES, IN_CLASS = 64, 64
VOCABULARY = CLASSES * IN_CLASS
BUCKETS = 512  # ids shared by words outside the vocabulary
SIDE = 2  # words of the window on either side
EMBEDDING, HIDDEN = 16, 32
BATCH = 4096
ROWS = 8192  # words scored together
ROUNDS, MASKED = 2, 2  # equal, so that every word is predicted once in training
RATE = 0.1
SLICES, SHARES = 16, 64
EMPTY = VOCABULARY  # the id beyond the ends of a text


@dataclass
class Net:
    embedding: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @staticmethod
    def from_flat(flat: np.ndarray) -> Net:
        parts, at = [], 0
        for shape in SHAPES:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return Net(*parts)


SHAPES = [
    (VOCABULARY + 1, EMBEDDING),
    (2 * SIDE * EMBEDDING, HIDDEN),
    (HIDDEN,),
    (HIDDEN, CLASSES),
    (CLASSES,),
    (CLASSES, HIDDEN, IN_CLASS),
    (CLASSES, IN_CLASS),
]


def fresh(counts: np.ndarray, seed: int = 0) -> Net:
    """A network that predicts words by their frequency."""
    rng = np.random.default_rng(seed)
    draw = lambda shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    by_class = (counts + 1.0).reshape(CLASSES, IN_CLASS)
    total = by_class.sum(axis=1)
    return Net(
        draw(SHAPES[0], 0.1),
        draw(SHAPES[1], SHAPES[1][0] ** -0.5),
        np.zeros(SHAPES[2], np.float32),
        draw(SHAPES[3], 0.01),
        np.log(total / total.sum()).astype(np.float32),
        draw(SHAPES[5], 0.01),
        np.log(by_class / total[:, None]).astype(np.float32),
    )


@dataclass
class Vocabulary:
    hashes: np.ndarray  # ascending
    ids: np.ndarray  # of each hash; ids go by frequency
    shared: np.ndarray  # of each id, the logarithm of the words that share it

    def of(self, word: np.ndarray) -> np.ndarray:
        bucket = VOCABULARY - BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.hashes):
            return bucket
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        return np.where(self.hashes[at] == word, self.ids[at], bucket)


def windows_of(texts: list[bytes | None], vocabulary: Vocabulary):
    """Ids of all words, the ids of their windows, and the words of each text."""
    found = W.split(texts, lower=True)
    ids = vocabulary.of(found.hashes())
    # empty words between the texts
    line = np.full(len(ids) + SIDE * (len(texts) + 1), EMPTY, dtype=np.int32)
    place = np.arange(len(ids)) + SIDE * (found.owner() + 1)
    line[place] = ids
    steps = [s for s in range(-SIDE, SIDE + 1) if s]
    return ids, line, place, np.array(steps), found.counts


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits less the largest of their row, in place, and these largest ones."""
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    return np.exp(logits, out=logits), top


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product, which takes a fourth of the time of adding up short rows.

    Their last bits depend on the place of a row, so scores, equal for equal texts, are added up plainly.
    """
    return rows @ np.ones((rows.shape[1], 1), rows.dtype)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, in place of the logits."""
    logits, _ = _exp(logits)
    logits /= _sums(logits)
    return logits


def _chosen(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of one column of each row of logits, which are used up."""
    own = logits[np.arange(len(logits)), which]
    logits, top = _exp(logits)
    return own - (top + np.log(logits.sum(axis=1, keepdims=True))).ravel()


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of words by class, their classes and places in them, and where each class begins."""
    order = np.argsort((ids // IN_CLASS).astype(np.uint8), kind="stable")  # small integers sort in linear time
    of_class, within = np.divmod(ids[order], IN_CLASS)
    return order, of_class, within, np.searchsorted(of_class, np.arange(CLASSES + 1))


def _inner(net: Net, hidden: np.ndarray, of_class: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Logits of the words of its class, for words in the order of classes."""
    logits = np.empty((len(hidden), IN_CLASS), np.float32)
    for c in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[c], bounds[c + 1])
        np.matmul(hidden[own], net.words[c], out=logits[own])
    logits += net.word_bias[of_class]
    return logits


def log_probabilities(net: Net, window: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each word given its window."""
    n = len(ids)
    order, of_class, within, bounds = _by_class(ids)
    hidden = np.tanh(net.embedding[window[order]].reshape(n, -1) @ net.hidden + net.hidden_bias)
    back = np.empty(n)
    back[order] = _chosen(hidden @ net.classes + net.class_bias, of_class)
    back[order] += _chosen(_inner(net, hidden, of_class, bounds), within)
    return back


class Trainer:
    """Adagrad steps on batches of words and windows."""

    def __init__(self, net: Net):
        self.net = net
        self.seen = {f.name: np.full(getattr(net, f.name).shape, 1e-4, np.float32) for f in fields(net)}

    def _step(self, name: str, gradient: np.ndarray, rows=...) -> None:
        seen, value = self.seen[name], getattr(self.net, name)
        seen[rows] += gradient * gradient
        value[rows] -= RATE * gradient / np.sqrt(seen[rows])

    def learn(self, window: np.ndarray, ids: np.ndarray) -> None:
        net, n = self.net, len(ids)
        row = np.arange(n)
        order, of_class, within, bounds = _by_class(ids)
        window = window[order]
        inputs = net.embedding[window].reshape(n, -1)
        hidden = np.tanh(inputs @ net.hidden + net.hidden_bias)
        off = _softmax(hidden @ net.classes + net.class_bias)
        off[row, of_class] -= 1
        off /= n
        inner = _softmax(_inner(net, hidden, of_class, bounds))
        inner[row, within] -= 1
        inner /= n
        back = off @ net.classes.T
        present = np.flatnonzero(np.diff(bounds))
        words = np.empty((len(present), HIDDEN, IN_CLASS), np.float32)
        for k, c in enumerate(present):
            own = slice(bounds[c], bounds[c + 1])
            back[own] += inner[own] @ net.words[c].T
            np.matmul(hidden[own].T, inner[own], out=words[k])
        back *= 1 - hidden * hidden
        to_inputs = (back @ net.hidden.T).reshape(-1, EMBEDDING)
        self._step("classes", hidden.T @ off)
        self._step("class_bias", off.sum(axis=0))
        self._step("words", words, present)
        self._step("word_bias", np.add.reduceat(inner, bounds[present], axis=0), present)
        self._step("hidden", inputs.T @ back)
        self._step("hidden_bias", back.sum(axis=0))
        touched = window.ravel()
        by_id = np.argsort(touched.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(touched[by_id], prepend=-1))
        self._step("embedding", np.add.reduceat(to_inputs[by_id], first, axis=0), touched[by_id][first])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in shards(batches, "text"):
        texts = texts_of(table.column("text"))
        parts = [np.unique(W.split(texts[a:b], lower=True).hashes(), return_counts=True) for a, b in W.pieces(texts)]
        word, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(word))
        yield pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n"]
        )


def vocabulary_of(texts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words of a column text, and how often each id occurs in the corpus."""
    counted = checkpointed(texts.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - BUCKETS).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    counts = np.zeros(VOCABULARY)
    counts[: len(word)] = top.column("n").to_numpy()
    # the words beyond the top ones, by bucket: 512 rows at most
    by_bucket = counted.groupBy(F.pmod(F.col("word"), F.lit(BUCKETS)).alias("bucket"))
    all_buckets = by_bucket.agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    bucket = all_buckets.column("bucket").to_numpy()
    rest, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rest[bucket] = all_buckets.column("n").to_numpy()
    words[bucket] = all_buckets.column("words").to_numpy()
    of_top = (word % np.uint64(BUCKETS)).astype(np.int64)
    rest -= np.bincount(of_top, weights=counts[: len(word)], minlength=BUCKETS)
    words -= np.bincount(of_top, minlength=BUCKETS)
    counts[VOCABULARY - BUCKETS :] = rest
    shared = np.zeros(VOCABULARY)
    shared[VOCABULARY - BUCKETS :] = np.log(words + 1)
    order = np.argsort(word)
    return Vocabulary(word[order], np.arange(len(word))[order], shared), counts


def _trained(batches: Iterator[pa.RecordBatch], state, masked: int, turn: int) -> Iterator[pa.RecordBatch]:
    """The parameters after the documents of a task, times the words predicted, in slices."""
    vocabulary, flat = state.value
    trainer = Trainer(Net.from_flat(flat))
    seen = 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(least: int) -> None:
        nonlocal held
        if sum(len(i) for _, i in held) < max(least, 1):
            return
        window, ids = np.concatenate([w for w, _ in held]), np.concatenate([i for _, i in held])
        for a in range(0, len(ids), BATCH):
            trainer.learn(window[a : a + BATCH], ids[a : a + BATCH])
        held = []

    for table in shards(batches, "text"):
        texts = texts_of(table.column("text"))
        for a, b in W.pieces(texts):
            ids, line, place, steps, _ = windows_of(texts[a:b], vocabulary)
            # which words are masked depends on place, word and round alone
            draw = W.mixed(np.arange(len(ids), dtype=np.uint64) * np.uint64(VOCABULARY) + ids.astype(np.uint64))
            chosen = np.flatnonzero(draw % np.uint64(masked) == turn % masked)
            held.append((line[place[chosen][:, None] + steps], ids[chosen]))
            seen += len(chosen)
            learn(BATCH)
    learn(1)
    if seen:
        parts = np.array_split(trainer.net.flat().astype(np.float64) * seen, SLICES)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(SLICES), pa.int32()),
                pa.array([task] * SLICES, pa.int32()),
                pa.array([seen] * SLICES, pa.int64()),
                pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()),
            ],
            names=["slice", "task", "seen", "part"],
        )


def _added(table: pa.Table) -> pa.Table:
    """The sum of slices of parameters, in the order of their tasks."""
    table = table.sort_by("task")
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in table.column("part").to_pylist())
    return pa.table(
        {
            "slice": table.column("slice").slice(0, 1),
            "task": table.column("task").slice(0, 1),
            "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()),
            "part": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        }
    )


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, masked: int = MASKED, seed: int = 0) -> Model:
    """A model of the corpus."""
    texts = docs.select(F.col(quoted(text)).alias("text"))
    vocabulary, counts = vocabulary_of(texts)
    flat = fresh(counts, seed).flat()
    kind = "slice int, task int, seen bigint, part binary"
    context = docs.sparkSession.sparkContext
    for turn in range(rounds):
        state = context.broadcast((vocabulary, flat))
        parts = texts.mapInArrow(lambda b, s=state, t=turn: _trained(b, s, masked, t), kind)
        shares = parts.groupBy("slice", F.pmod("task", F.lit(SHARES))).applyInArrow(_added, kind)
        rows = shares.groupBy("slice").applyInArrow(_added, kind).orderBy("slice").toArrow()
        if len(rows):
            seen = rows.column("seen")[0].as_py()
            flat = np.concatenate([np.frombuffer(p, np.float32) for p in rows.column("part").to_pylist()]) / np.float32(seen)
    return Model(vocabulary, flat)


def scores(texts: list[bytes | None], vocabulary: Vocabulary, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the sums of their log-probabilities."""
    ids, line, place, steps, counts = windows_of(texts, vocabulary)
    out = np.empty(len(ids) + 1)
    for a in range(0, len(ids), ROWS):
        own = slice(a, a + ROWS)
        out[own][: len(ids) - a] = log_probabilities(net, line[place[own][:, None] + steps], ids[own])
    total = np.concatenate(([0.0], np.cumsum(out[:-1] - vocabulary.shared[ids])))
    last = np.cumsum(counts)
    return counts, total[last] - total[last - counts]


def _scored(batches: Iterator[pa.RecordBatch], state) -> Iterator[pa.RecordBatch]:
    vocabulary, flat = state.value
    net = Net.from_flat(flat)
    for table in shards(batches, "text"):
        texts = texts_of(table.column("text"))
        parts = [scores(texts[a:b], vocabulary, net) for a, b in W.pieces(texts)]
        counts, total = (np.concatenate(p) for p in zip(*parts))
        yield from pa.table(
            {"id": table.column("id"), "n_words": pa.array(counts, pa.int64()), "log_prob": pa.array(total, pa.float64())}
        ).to_batches()


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, n_words, log_prob (summed), mean_log_prob (per word)."""
    state = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.flat))
    rows = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda b: _scored(b, state), f"id {kind}, n_words bigint, log_prob double")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select(F.col("id").alias(id), "n_words", "log_prob", mean.alias("mean_log_prob"))
