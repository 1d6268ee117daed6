import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixture

SIZES = {"B": 40, "a": 300, "b": 300, "é": 30, None: 120, "void": 5}


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    left = total
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * share for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@pytest.fixture
def rows(prose):
    rng = np.random.default_rng(6)
    out = []
    for source, n in SIZES.items():
        for _ in range(n):
            words = 0 if source == "void" else int(np.exp(rng.normal(3, 1)))
            out.append((len(out), prose(words), "en", source))
    out += [(None, prose(9), "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (7, prose(5000), "en", "b"), out[0], out[0]]
    return out


def sizes_of(rows):
    total = {}
    for _, text, _, source in rows:
        total[source] = total.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return total


@pytest.mark.parametrize("group_rows", [4096, 20])
def test_mixture_comes_near_its_targets(make_docs, rows, group_rows):
    found = mixture.mixture(make_docs(rows), group_rows=group_rows).collect()
    assert len(found) == len(rows)
    size = sizes_of(rows)
    want = targets(size)
    by_size = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    for source, total in size.items():
        if source == "void":
            continue
        own = by_size[total, round(want[source], 6)]
        taken = sum(r.taken for r in own)
        # a group of a few documents cannot make up for one that is longer than all of them
        most = max(r.size for r in own) if group_rows < 100 else 0
        assert abs(taken - want[source]) <= max((0.09 if source == "b" else 0.02) * want[source], 12, most)
        ratio = want[source] / total
        assert all(int(ratio) <= r.copies <= int(ratio) + 1 for r in own)
        assert abs(sum(r.copies for r in own) - ratio * len(own)) < 2


def test_reruns_agree(make_docs, rows):
    a, b = (mixture.mixture(make_docs(rows, parts), group_rows=50).select("doc_id", "taken").collect() for parts in (1, 5))
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_flight_keeps_both_sums_until_the_landing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(3, 60))
        size = np.sort(rng.integers(0, 50, n))[::-1].astype(float)
        chance = rng.random(n)
        out = mixture.flight(size, chance, rng.random(n), land=False)
        assert abs(out.sum() - chance.sum()) < 1e-6 and abs(out @ size - chance @ size) < 1e-5
        assert ((out > 0) & (out < 1)).sum() <= 3
        landed = mixture.flight(size, chance, rng.random(n), land=True)
        assert set(landed) <= {0.0, 1.0}


def test_chances_are_kept_on_average():
    rng = np.random.default_rng(3)
    size, chance = np.linspace(60, 1, 40), np.full(40, 0.3)
    mean = np.mean([mixture.flight(size, chance, rng.random(40), land=False) for _ in range(3000)], axis=0)
    assert abs(mean - 0.3).max() < 0.13  # the shortest few
    assert abs(mean - 0.3)[:30].max() < 0.03


def test_a_source_with_one_very_long_document_meets_its_target():
    rng = np.random.default_rng(3)
    size = np.sort(np.concatenate(([5000], np.exp(rng.normal(3, 1, 301)).astype(int))))[::-1].astype(float)
    for _ in range(50):
        out = mixture.flight(size, np.full(302, 0.66), rng.random(302), land=True)
        assert abs(out @ size - 0.66 * size.sum()) < 0.09 * size.sum()


def test_mix_keeps_columns_and_takes_the_same_words(make_docs, rows):
    docs = make_docs(rows)
    out = mixture.mix(docs)
    assert out.columns == [*docs.columns, "copies_"]
    assert sum(r.copies_ for r in out.collect()) == pytest.approx(
        mixture.mixture(docs).agg(F.sum("copies")).first()[0], abs=8
    )
    assert out.where("copies_ < 1").count() == 0


def test_empty_table(make_docs):
    none = make_docs([(1, "a", "en", "s")]).limit(0)
    assert mixture.mixture(none).count() == 0 and mixture.mix(none).count() == 0
    assert mixture.mixture(make_docs([(1, None, "en", "s")])).first().taken == 0
