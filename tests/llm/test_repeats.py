import re

import pytest

from plumbline.llm import repeats


def brute(rows, size):
    split = [(d if d is not None else float("inf"), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d, w), (raw, _) in zip(split, rows):
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((raw, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.fixture
def rows(prose):
    shared = [prose(9), prose(30)]
    texts = [f"{prose(20)}\n{shared[k % 2]} {prose(15)}" for k in range(30)]
    texts += [texts[2], texts[5] + " tail", shared[0], None, "", " \n", "one two", "x " * 50, prose(20_000)]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[3]), (None, texts[3]), (rows[4][0], rows[4][1]), (rows[4][0], texts[6])]


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 900, "bucket_windows": 40}])
def test_removed_words_are_those_of_brute_force(make_docs, rows, limits):
    found = repeats.deduplicate(make_docs(rows), size=5, **limits).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr)
    assert got == brute(rows, 5)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_packing_is_lossless():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (1, 1 << 20, 1 << 56):
        values = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (repeats.unpacked(repeats.packed(values)) == values).all()


def test_empty_table(make_docs):
    assert repeats.deduplicate(make_docs([(1, "a")]).limit(0)).count() == 0
