import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import words as W

TEXT = st.text(st.sampled_from("aAbB zZ09\n\t\r\x0b\x1c.,_é中\U0001f600 "), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_the_regex(texts):
    found = W.split([t if t is None else t.encode() for t in texts])
    got = [
        [found.data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])]
        for a, b in zip(found.first[:-1], found.first[1:])
    ]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=4), st.integers(1, 4))
def test_windows_are_equal_when_their_words_are(texts, size):
    found = W.split([t.encode() for t in texts])
    hashes, whole = found.windows(size)
    seen = {}
    at = 0
    for t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        for i in range(len(own)):
            assert whole[at] == (i + size <= len(own))
            if whole[at]:
                seen.setdefault(tuple(own[i : i + size]), set()).add(int(hashes[at]))
            at += 1
    assert all(len(h) == 1 for h in seen.values())
    assert len(set().union(*seen.values())) == len(seen)


def test_very_long_words():
    texts = [b"a" * 300_000, b"a" * 299_999 + b"b", b"a" * 300_000]
    h = W.split(texts).hashes()
    assert h[0] == h[2] != h[1]


def test_pieces_cover_all_texts():
    texts = [b"x" * n for n in (5, 0, 9, 1, 1, 1)] + [None]
    cut = list(W.pieces(texts, 4))
    assert [i for a, b in cut for i in range(a, b)] == list(range(7))
