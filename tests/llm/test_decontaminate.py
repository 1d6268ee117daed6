import random
import re

import pytest

from plumbline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), hit, sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=repr)


@pytest.fixture
def items(prose):
    return [(i, prose(n)) for i, n in enumerate((3, 12, 25, 1, 40))] + [(7, None), (8, ""), (9, "!!"), (None, prose(4)), (1, prose(11))]


@pytest.fixture
def docs(prose, items):
    texts = [prose(60) for _ in range(12)]
    texts += [f"{prose(5)} {t} {prose(5)}" for _, t in items if t]
    texts += [items[2][1].upper(), (items[1][1] + " ") * 3, None, "", "...", prose(30_000)]
    rows = list(enumerate(texts))
    return rows + [(None, texts[13]), (3, texts[3]), (3, texts[14])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_are_those_of_brute_force(spark, make_docs, docs, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(make_docs(docs), benchmark, size=6, block_bytes=block_bytes).collect()
    got = sorted(
        ((r.doc_id, r.n_words, {i for s in r.spans for i in range(s.start, s.end)}, r["items"]) for r in found), key=repr
    )
    assert got == brute(docs, items, 6)


def test_longest_match(spark, make_docs):
    benchmark = spark.createDataFrame([(5, "a b c d e f g h")], "item_id long, text string")
    docs = make_docs([(1, "x b c d y c d e f g h z"), (2, "q")])
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark, size=3).collect()}
    assert (rows[1].longest_words, rows[1].longest_item, rows[1].longest_start) == (6, "5", 5)
    assert (rows[2].longest_words, rows[2].longest_item) == (0, None)


def brute_longest(text, items, size):
    """Words, item and start of the longest run that an item holds: `size` words or a whole item."""
    held = [(str(i) if i is not None else None, words(t)) for i, t in items]
    w, best = words(text), (0, None, None)
    for p in range(len(w)):
        for name, h in held:
            for q in range(len(h)):
                n = 0
                while p + n < len(w) and q + n < len(h) and w[p + n] == h[q + n]:
                    n += 1
                rank = (-n, p, name is None, name or "")
                if (n >= size or n and n == len(h)) and (
                    best[0] == 0 or rank < (-best[0], best[2], best[1] is None, best[1] or "")
                ):
                    best = (n, name, p)
    return best


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_longest_match_is_that_of_brute_force(spark, make_docs, block_bytes):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(25)] + [(3, text(9)), (None, text(9)), (30, None), (31, "")]
    docs = [(i, text(rng.randint(0, 30))) for i in range(60)] + [(60, None), (61, items[0][1] + " z " + items[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(make_docs(docs), benchmark, size=4, block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.longest_words, r.longest_item, r.longest_start) for r in found}
    assert got == {d: brute_longest(t, items, 4) for d, t in docs}
    hits = [(r.doc_id, r.n_words, {i for s in r.spans for i in range(s.start, s.end)}, r["items"]) for r in found]
    assert sorted(hits, key=repr) == brute(docs, items, 4)


def test_match_with_an_item_that_shares_its_first_window():
    shared, rest = [f"s{i}" for i in range(10)], [f"r{i}" for i in range(20)]
    items = [" ".join(shared), " ".join(shared + rest)]
    tests = decontaminate.suffixes(["1", "2"], [t.encode() for t in items], 10)
    assert decontaminate.hits_of([items[1].encode()], tests)[0][3:] == (30, "2", 0)


def test_one_very_long_item_among_many_short_ones():
    short = [f"a{i} b{i} c{i}".encode() for i in range(1000)]
    long = " ".join(f"w{i % 3000}" for i in range(50_000)).encode()
    tests = decontaminate.suffixes([str(i) for i in range(1001)], [*short, long], 10)
    assert len(tests.line.tokens) == 3 * 1000 + 50_000 + 1001
    rows = decontaminate.hits_of([long, short[7]], tests)
    assert rows[0][3:] == (50_000, "1000", 0) and rows[0][2] == ["1000"]
    assert rows[1][2:] == (["7"], 3, "7", 0)


def test_clean_documents_stay_with_all_columns(spark, make_docs, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    all_docs = make_docs(docs)
    kept = decontaminate.decontaminate(all_docs, benchmark, size=6, block_bytes=200)
    assert kept.columns == all_docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
        repr((d, t)) for d, t in docs if not brute([(d, t)], items, 6)[0][2]
    )


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b")])
    assert decontaminate.contamination(docs, none).first().n_words == 2
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), some).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), some).count() == 0
