import re

import numpy as np
import pytest

from plumbline.llm import graph, minhash

LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, percent=85):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            shared = len(sets[i] & sets[j])
            both = None not in (rows[i][0], rows[j][0])
            if both and (same_id or sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i] | sets[j]))):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for k, (e, _) in enumerate(rows) if root(k) == root(i) and e is not None]
        least = min(ids) if d is not None else None
        out.append((d, len(sets[i]), least, d is None or d == least))
    return sorted(out, key=repr)


@pytest.fixture
def rows(prose):
    rng = np.random.default_rng(5)
    texts = []
    for length in (6, 30, 120, 400):
        original = prose(length).split()
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 10, 15):
            copy = list(original)
            for at in rng.integers(0, length, edits):
                copy[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(copy))
    texts += [prose(50) for _ in range(10)] + ["Alpha beta", "alpha  BETA\n", "alpha", None, "", "  ", prose(20_000)]
    rows = [(500 - 3 * i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), rows[3]]


@pytest.mark.parametrize("block_shingles", [1 << 22, 600])
def test_components_are_those_of_brute_force(make_docs, rows, block_shingles):
    found = minhash.near_duplicates(make_docs(rows), block_shingles=block_shingles).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_many_near_copies_of_one_text(make_docs, prose):
    rng = np.random.default_rng(9)
    original = prose(60).split()
    rows = []
    for k in range(150):
        copy = list(original)
        for at in rng.integers(0, 60, k % 5):
            copy[at] = f"w{rng.integers(10_000)}"
        rows.append((k, " ".join(copy)))
    found = minhash.near_duplicates(make_docs(rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_one_document_of_each_group_stays(make_docs, rows):
    docs = make_docs(rows)
    kept = minhash.keep_one(docs, percent=85)
    assert set(kept.columns) == set(docs.columns)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(rows) if r[3]), key=repr)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    near, far = [], []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = np.concatenate((a[:320], rng.integers(0, 1 << 63, 80, dtype=np.uint64)))
        c = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        low = minhash.planes(minhash.minima(np.concatenate((a, b, c)), np.array([400, 400, 400])))
        near.append(minhash.estimate(low[0], low[1]))
        far.append(minhash.estimate(low[0], low[2]))
    assert abs(np.mean(near) - 320 / 480) < 0.02
    assert abs(np.mean(far)) < 0.02


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    odd = [(200, 200), (201, 202), (202, 201), (None, 5), (300, None)]
    links = spark.createDataFrame(path + star + odd, "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 60)} | {202: 201}
    assert got == want
    assert graph.components(links.limit(0)).count() == 0
