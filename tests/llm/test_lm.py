import random

import numpy as np
import pytest

from plumbline.llm import lm


def corpus(n, seed):
    """Sentences in which a word follows from its neighbours."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(5, 12)):
            k = rng.randint(0, 19)
            text += [f"left{k}", f"mid{k}", f"right{k}"]
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def model(make_docs):
    docs = make_docs(list(enumerate(corpus(3000, 1))))
    return lm.train(docs, rounds=12, masked=2)


def test_held_out_documents_beat_shuffled_ones(make_docs, model):
    rng = random.Random(2)
    held = corpus(60, 3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    rows = {r.doc_id: r for r in lm.score(make_docs(list(enumerate(held + shuffled))), model).collect()}
    good = np.mean([rows[k].mean_log_prob for k in range(60)])
    bad = np.mean([rows[k + 60].mean_log_prob for k in range(60)])
    assert good > bad + 0.5
    # far better than frequencies alone, which give each of 60 words the same chance
    assert good > np.log(1 / 60) + 0.5


def test_scores_are_those_of_one_softmax_over_all_words(make_docs, model):
    net = lm.Net.from_flat(model.flat)
    texts = ["left1 mid1 right1 unknown", "mid2", "LEFT3  mid3\n"]
    rows = {r.doc_id: r for r in lm.score(make_docs(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        ids, line, place, steps, _ = lm.windows_of([text.encode()], model.vocabulary)
        total = 0.0
        for i, word in enumerate(ids):
            around = [ids[i + s] if 0 <= i + s < len(ids) else lm.EMPTY for s in steps]
            hidden = np.tanh(net.embedding[around].ravel() @ net.hidden + net.hidden_bias)
            top = np.exp(hidden @ net.classes + net.class_bias)
            every = []
            for c in range(lm.CLASSES):
                inner = np.exp(hidden @ net.words[c] + net.word_bias[c])
                every.append(top[c] / top.sum() * inner / inner.sum())
            every = np.concatenate(every)
            assert abs(every.sum() - 1) < 1e-3
            total += np.log(every[word]) - model.vocabulary.shared[word]
        assert abs(rows[k].log_prob - total) < 1e-3 * max(1, abs(total))
        assert rows[k].n_words == len(ids)


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(5)
    net = lm.fresh(np.ones(lm.VOCABULARY))
    window = rng.integers(0, 50, (500, 4))
    ids = window[:, 1]
    before = -lm.log_probabilities(net, window, ids).mean()
    trainer = lm.Trainer(net)
    for _ in range(60):
        trainer.learn(window, ids)
    assert -lm.log_probabilities(net, window, ids).mean() < before - 3


def test_null_empty_long_and_repeated_texts(make_docs, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "left1 " * 50_000), (None, "left1 mid1"), (5, "left1 mid1"), (5, "left1 mid1")]
    found = sorted(lm.score(make_docs(rows), model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_words for r in found] == [0, 0, 0, 50_000, 2, 2, 2]
    assert all(r.log_prob == 0 and r.mean_log_prob is None for r in found[:3])
    assert found[4].log_prob == found[5].log_prob == found[6].log_prob


def test_empty_corpus(make_docs):
    none = make_docs([(1, "a")]).limit(0)
    empty = lm.train(none)
    assert lm.score(none, empty).count() == 0
    assert lm.score(make_docs([(1, "a b")]), empty).first().n_words == 2
    assert lm.train(make_docs([(1, None), (2, "")])) is not None


def test_default_rounds_predict_every_word_once(make_docs):
    texts = corpus(200, 4)
    docs = make_docs(list(enumerate(texts))).select("text")
    vocabulary, counts = lm.vocabulary_of(docs)
    state = docs.sparkSession.sparkContext.broadcast((vocabulary, lm.fresh(counts).flat()))
    kind = "slice int, task int, seen bigint, part binary"
    seen = 0
    for turn in range(lm.ROUNDS):
        parts = docs.mapInArrow(lambda b, t=turn: lm._trained(b, state, lm.MASKED, t), kind)
        seen += sum(r.seen for r in parts.where("slice = 0").select("seen").collect())
    assert seen == sum(len(t.split()) for t in texts)


def test_defaults_tell_held_out_documents_from_shuffled_ones(make_docs):
    model = lm.train(make_docs(list(enumerate(corpus(6000, 1)))))
    rng = random.Random(2)
    held = corpus(60, 3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    rows = {r.doc_id: r for r in lm.score(make_docs(list(enumerate(held + shuffled))), model).collect()}
    good = np.mean([rows[k].mean_log_prob for k in range(60)])
    bad = np.mean([rows[k + 60].mean_log_prob for k in range(60)])
    assert good > bad


def test_words_of_a_bucket_share_its_probability(make_docs):
    rng = random.Random(6)
    rare = [f"rare{i}" for i in range(9000)]
    texts = [" ".join(rng.sample(rare, 60)) for _ in range(400)] + [" ".join(rare)]
    model = lm.train(make_docs(list(enumerate(texts))))
    buckets = model.vocabulary.shared[lm.VOCABULARY - lm.BUCKETS :]
    assert not model.vocabulary.shared[: lm.VOCABULARY - lm.BUCKETS].any()
    held = np.exp(buckets) - 1
    assert round(held.sum()) == len(rare) - (lm.VOCABULARY - lm.BUCKETS)
    # every word of the corpus once, alone in its text: together they are at most certain
    rows = lm.score(make_docs(list(enumerate(rare))), model).collect()
    total = np.exp([r.log_prob for r in rows]).sum()
    assert 0.9 < total < 1
