import random
import re
from collections import Counter

import pytest

from plumbline.llm import collocations as C


def brute(rows, least=10, longest=3, covered=50, top=2000):
    f = Counter()
    n = Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        longer = [
            b
            for (other, w), b in candidates.items()
            if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))
        ]
        if not any(100 * b >= covered * a for b in longer):
            out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def rows():
    rng = random.Random(5)
    words = ["Aa", "bb", "cc", "dd", "éé", "ee.", "ff", "gg;", "hh\t", "ii\n"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["de", "fr", None]), "s") for i in range(60)]
    out += [(70, None, "de", "s"), (71, "", "de", "s"), (72, "...", "xx", "s"), (73, "one", "zz", "s")]
    out += [(80, "bb cc dd ee " * 300, "de", None)] * 2 + [(None, "aa aa aa aa", "und", "s")] * 12
    return out


@pytest.mark.parametrize("least,longest,top", [(10, 3, 2000), (3, 2, 2000), (4, 4, 7), (5, 5, 2000)])
def test_phrases_of_brute_force(make_docs, rows, least, longest, top, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_PHRASES", 64)
    monkeypatch.setattr(C, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(C, "TOP_ROWS", 10)
    found = C.collocations(make_docs(rows), least, longest, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, longest, top=top)
    assert want and got(found) == want


def test_nothing(make_docs):
    assert got(C.collocations(make_docs([]))) == []
    assert got(C.collocations(make_docs([(1, None, None, None), (2, "a b", "de", None)]))) == []


def test_ties_are_ranked_by_bytes(make_docs):
    text = "\n".join(["z a", "é a2", "b z2", "Ω c"] * 10)
    found = got(C.collocations(make_docs([(1, text, "de", "s")])))
    assert [r[2] for r in found] == sorted(["z a", "é a2", "b z2", "Ω c"], key=str.encode)


def test_scores_beyond_64_bits(spark, make_docs, monkeypatch):
    big = 3_000_000_000_000
    words = spark.createDataFrame([("de", 1, "x", 2 * big, 9 * big), ("de", 2, "y", 3 * big, 9 * big)], "lang string, code bigint, word string, f bigint, n bigint")
    phrases = spark.createDataFrame([("de", [1, 2], big)], "lang string, words array<bigint>, a bigint")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: (words, phrases))
    assert got(C.collocations(make_docs([]))) == [("de", 1, "x y", big, 2 * big, 3 * big, 9 * big, 1000000 // 6)]
