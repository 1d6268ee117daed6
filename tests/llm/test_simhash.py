import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash as S


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(x)) for r, p, x in zip(rows, prints, label)), key=repr)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hash_is_that_of_spark(spark):
    texts = ["a b c", "é", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    assert {r.t: r.h % (1 << 64) for r in rows} == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


@pytest.mark.parametrize("nodes", [S.TREE_NODES, 3])
def test_documents(make_docs, prose, nodes, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 16)
    monkeypatch.setattr(S, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(i, prose(rng.randint(1, 40))) for i in range(0, 60, 2)]
    long = prose(400).split()
    for i in range(61, 100, 2):
        words = list(long)
        words[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (-5, None), (203, "one"), (203, "one"), (204, "ONE\ttwo"), (None, rows[3][1]), (None, "nothing like it")]
    rows += [(300, prose(30_000)), (None, " ".join(long))]
    assert got(S.near_duplicates(make_docs(rows), tree_nodes=nodes)) == brute(rows)


def test_no_documents(make_docs):
    assert got(S.near_duplicates(make_docs([]))) == []


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
@pytest.mark.parametrize("frontier", [S.FRONTIER, 5])
def test_trees_find_what_is_within_the_radius(radius, frontier, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (150, 3)).astype(np.uint64)
    prints = rng.choice(base, 150) ^ np.bitwise_or.reduce(flips, axis=1)
    unit = rng.integers(0, 3, 150)
    pairs = np.unique(np.stack([unit.astype(np.uint64), prints]), axis=1)
    unit, prints = pairs[0].astype(np.int64), pairs[1]
    trees = S.Trees(unit, prints)
    ask_unit, ask = np.append(unit, [7, -1]), np.append(prints, prints[:2])
    found = {(q, n) for a, b in trees.within(ask_unit, ask, radius) for q, n in zip(a.tolist(), b.tolist())}
    want = {
        (q, n)
        for q in range(len(ask))
        for n in range(len(trees.prints))
        if ask_unit[q] == trees.unit[n] and int(ask[q] ^ trees.prints[n]).bit_count() <= radius
    }
    assert found == want


def test_trees_skip_what_is_out_of_reach(monkeypatch):
    """Far fewer distances are taken than there are pairs."""
    looked = []
    count = np.bitwise_count
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    trees = S.Trees(np.zeros(len(prints), np.int64), prints)
    monkeypatch.setattr(S.np, "bitwise_count", lambda x: looked.append(len(x)) or count(x))
    for _ in trees.within(np.zeros(len(prints), np.int64), prints, 2):
        pass
    assert sum(looked) < 0.3 * len(prints) ** 2


def test_dense_group_lists_no_pairs(spark):
    centre = 0x0123456789ABCDEF
    near = [centre ^ (1 << i) ^ (1 << j) for i in range(60) for j in range(i)]
    frame = spark.createDataFrame([(p,) for p in near], "print bigint")
    links = S.near_links(frame, tree_nodes=100)
    assert len(near) - 1 <= links.count() < 60 * len(near)
