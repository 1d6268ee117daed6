import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), symbols, len(lines), len(lines) - len(set(lines)), len(again), failed)


@pytest.fixture
def rows():
    rng = random.Random(8)
    sound = lambda: "".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9)))
    clean = lambda: "\n".join(" ".join(sound() for _ in range(rng.randint(4, 20))) for _ in range(rng.randint(8, 30)))
    rows = []
    for k in range(330):
        source = (None, "a", "b", "tiny")[min(k % 4, 3)] if k < 320 else f"rare{k}"
        rows.append((k, clean(), ("en", None)[k // 4 % 2], source))
    for k in range(330, 350):
        rows.append((k, clean().replace(" ", "### "), "en", "a"))
    special = [None, "", " \n\n", "one\none\n one", "a b c " * 60, "### " * 80, "x" * 200_000 + " y" * 100, "line one\nline one\nline two"]
    return rows + [(400 + k, t, "en", "a") for k, t in enumerate(special)] + [(None, rows[0][1], "en", "b"), rows[3], rows[3]]


def test_statistics_and_limits_are_those_of_brute_force(make_docs, rows):
    found = quality.quality(make_docs(rows)).collect()
    got = sorted(((r.doc_id, *r[1:7], r.base_failed) for r in found), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t, _, _ in rows), key=repr)
    assert not any(r.kept for r in found if r.base_failed)


def test_outliers_go_and_clean_documents_stay(make_docs, rows):
    found = {r.doc_id: r for r in quality.quality(make_docs(rows), least_rows=30).collect()}
    assert all(found[k].kept for k in range(330))
    assert not any(found[k].kept for k in range(330, 350))
    assert all(found[k].distance > quality.CUTOFF for k in range(330, 350))


def test_small_pools_reject_nothing(make_docs, rows):
    found = quality.quality(make_docs(rows), least_rows=10_000).collect()
    assert all(r.kept != r.base_failed and r.distance is None for r in found)


def test_good_documents_stay_with_all_columns(make_docs, rows):
    docs = make_docs(rows)
    good = quality.keep_good(docs, least_rows=30)
    assert good.columns == docs.columns
    judged = quality.quality(docs, least_rows=30).where("kept")
    assert sorted(map(repr, (r.doc_id for r in good.collect()))) == sorted(map(repr, (r.doc_id for r in judged.collect())))
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_estimates_are_those_of_concentration_steps(spark):
    """The binned steps against plain ones on all rows."""
    rng = np.random.default_rng(4)
    n = 3000
    words = rng.integers(100, 200, n)
    chars = (words * rng.normal(5, 0.4, n)).astype(int)
    odd = rng.random(n) < 0.2
    chars[odd] = words[odd] * 12
    rows = [(int(w), int(c), 0, 10, 0, 0) for w, c in zip(words, chars)]
    stats = spark.createDataFrame(rows, quality.STATISTICS).select(
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.struct("*").alias("statistics")
    )
    estimate = quality.fit(stats, "lang", "source", "statistics").estimates.first()
    v = np.round(1000 * np.log(chars / words))
    centre, scale = np.median(v), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.349
    for _ in range(quality.STEPS):
        inner = v[np.argsort(abs(v - centre))[: n // 2]]
        centre, scale = inner.mean(), inner.std() * quality.CONSISTENCY**0.5
    assert abs(estimate.centre[0] - centre) < 10
    assert abs(estimate.weight[0] ** -0.5 - (scale**2 + 50**2) ** 0.5) < 10


def test_consistency_factor():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200_000, 4))
    inner = x[np.argsort((x**2).sum(axis=1))[:100_000]]
    assert abs(quality.CONSISTENCY * inner.var() - 1) < 0.02


def test_repeats_alone_reject_in_a_group_without_any(make_docs):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    line = lambda: " ".join(words(12))
    rows = [(k, "\n".join(line() for _ in range(12)), "en", "a") for k in range(150)]
    phrase = " ".join(words(15))
    rows.append((200, "\n".join(f"{line()}\nyes\nno" for _ in range(14)), "en", "a"))
    rows.append((201, "\n".join(f"{' '.join(words(9))} {phrase} {' '.join(words(9))}" for _ in range(3)), "en", "a"))
    rows.append((202, "\n".join([line() for _ in range(12)] + [rows[0][1].split("\n")[0]] * 2), "en", "a"))
    found = {r.doc_id: r for r in quality.quality(make_docs(rows)).collect()}
    assert not found[200].base_failed and 100 * found[200].n_dup_lines > 50 * found[200].n_lines
    assert not found[201].base_failed and 100 * found[201].n_repeat_words > 44 * found[201].n_words
    assert not found[200].kept and not found[201].kept
    assert all(found[k].kept for k in (*range(150), 202))
