import numpy as np
import pytest
import tiktoken

from plumbline.llm import tokens


@pytest.mark.parametrize("block_bytes", [16 << 20, 10, 7])
def test_counts_are_those_of_the_tokenizer(make_docs, prose, block_bytes):
    texts = [prose(n) for n in range(40)] + [None, "", " \n", "\U0001f600 é 中文 <|endoftext|>", prose(20_000), "a" * 5000]
    rows = list(enumerate(texts)) + [(None, texts[3]), (2, texts[2])]
    encoding = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})
    want = sorted(((d, len(encoding.encode_ordinary(t or ""))) for d, t in rows), key=repr)
    if block_bytes < 100:
        rows, want = rows[:44], sorted(((d, len(encoding.encode_ordinary(t or ""))) for d, t in rows[:44]), key=repr)
    found = tokens.token_counts(make_docs(rows), block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == want


@pytest.mark.parametrize("end_id", [9, 70_000])
def test_documents_span_blocks(spark, tmp_path, end_id):
    rng = np.random.default_rng(1)
    kind = tokens.width_of(end_id)
    want = []
    for name, size in (("a.bin", 1000), ("b.bin", 37), ("c.bin", 0), ("d.bin", 5)):
        data = rng.integers(0, 9, size)
        data[rng.random(size) < (0.1 if name == "a.bin" else 0)] = end_id
        data.astype(kind).tofile(tmp_path / name)
        start, ordinal = 0, 0
        for stop in [*np.flatnonzero(data == end_id), size]:
            if stop < size or start < size:
                want.append((name, ordinal, start, int(stop) - start, bool(stop < size)))
            start, ordinal = int(stop) + 1, ordinal + 1
    for block_bytes in (4, 6, 64, 1 << 20):
        found = tokens.scan(spark, str(tmp_path), end_id, block_bytes)
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_cut_ids_raise(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="ids are cut"):
        tokens.scan(spark, str(tmp_path), 9).collect()


def test_empty_table(make_docs):
    assert tokens.token_counts(make_docs([(1, "a")]).limit(0)).count() == 0
