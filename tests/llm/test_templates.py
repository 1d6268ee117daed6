import collections
import re

import pytest

from plumbline.llm import templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, depth=3, least=5, similarity=0.6):
    """The numbers of dropped lines of each (id, text)."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    lines = []
    for k, (_, t) in enumerate(docs):
        own = [mask(x) for x in t.split("\n")]
        for i, m in enumerate(own):
            lines.append((k, i, m, own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None))
    deep = [x for x in lines if len(x[2]) > depth]
    leaves = collections.defaultdict(list)
    for k, i, m, _, _ in deep:
        leaves[len(m), m[:depth]].append((m, (docs[k][0] is not None, docs[k][0] or 0, i)))
    template = {}
    for own in leaves.values():
        count = collections.Counter(m for m, _ in own)
        first = {m: min(f for x, f in own if x == m) for m in count}
        seed = min(count, key=lambda m: (-count[m], first[m]))
        if len(count) > 1 and len(own) >= least:
            for m in count:
                if sum(a == b for a, b in zip(m, seed)) / len(m) >= similarity:
                    template[m] = seed
    around = collections.defaultdict(dict)
    for k, i, m, before, after in deep:
        around[template.get(m, m)].setdefault(k, (before, after))
    found = set()
    for t, own in around.items():
        count = collections.Counter(own.values())
        if len(own) >= least and len(count) >= least and 2 * max(count.values()) <= len(own):
            found.add(t)
    gone = collections.defaultdict(list)
    for k, i, m, _, _ in deep:
        if template.get(m, m) in found:
            gone[docs[k]].append(i)
    return gone


@pytest.fixture
def rows(prose):
    texts = []
    for k in range(12):
        body = [prose(12) for _ in range(4)]
        body.insert(k % 4, f"user {k}x logged in from host {prose(1)} at 12:0{k % 10}")
        body.insert(k % 3, "All rights reserved by us .")
        texts.append("\n".join(body))
    texts += [texts[0]] * 9  # copies keep their lines
    texts += ["", None, "\n\n", "Of.\nOf.", "All  rights\treserved by us .", prose(20_000), "x" * 50_000 + " 1 2 3 4"]
    texts += [f"{prose(9)}\nOf." for _ in range(8)]
    rows = list(enumerate(texts))
    return rows + [(None, texts[2]), rows[3], (4, "All rights reserved by us .\nand more of it here")]


def test_dropped_lines_are_those_of_brute_force(make_docs, rows):
    docs = make_docs(rows)
    found = templates.drop_lines(docs, dropped="dropped")
    assert found.columns == [*docs.columns, "dropped"]
    gone = brute(rows)
    want = []
    for d, t in rows:
        own = gone.get((d, t), [])
        kept = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in own)
        want.append((d, kept, own))
    got = [(r.doc_id, r.text, r.dropped) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(len(own) == 2 for own in gone.values())


def test_plan_has_no_python(make_docs, rows):
    plan = templates.drop_lines(make_docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_empty_table(make_docs):
    assert templates.drop_lines(make_docs([(1, "a")]).limit(0)).count() == 0


def test_blocks_between_blank_lines_go_and_copies_stay(make_docs, prose):
    footer = ["Published by the great society of lines .", "Licensed under terms that nobody reads .", "Write to us for any other use ."]
    unlike = ["\n\n".join([prose(15), prose(15), *footer]) for _ in range(8)]
    base = [prose(10) for _ in range(20)]
    near = ["\n\n".join(base[:k] + [prose(10)] + base[k + 1 :]) for k in range(8)]
    found = templates.drop_lines(make_docs(list(enumerate(unlike + near))), dropped="dropped").collect()
    assert {tuple(r.dropped) for r in found if r.doc_id < 8} == {(4, 6, 8)}
    assert not any(r.dropped for r in found if r.doc_id >= 8)


def test_second_template_of_a_leaf_generalises(make_docs, prose):
    name = lambda k: "abcdefghijklmnop"[k] * 4
    texts = [f"{prose(15)}\nPosted on Monday by {name(k)} from the {name(k)} office\n{prose(15)}" for k in range(8)]
    texts += [f"{prose(15)}\n{prose(15)}\nPosted on Monday with {name(k)} under our {name(k)} licence" for k in range(7)]
    # more templates of one leaf than a round settles
    odd = [" ".join(["One", "two", "three", *(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in "uvwxyz")]) for k in range(70)]
    late = [f"One two three late {name(k)} of {name(k)} again and" for k in range(6)]
    texts += [f"{prose(15)}\n{x}\n{x}" for x in odd] + [f"{x}\n{prose(15)}" for x in late]
    found = {r.doc_id: r.dropped for r in templates.drop_lines(make_docs(list(enumerate(texts))), dropped="dropped").collect()}
    want = [[1]] * 8 + [[2]] * 7 + [[]] * 70 + [[0]] * 6
    assert [found[k] for k in range(len(texts))] == want
