"""Words and word windows of many texts at once, as numpy arrays.

A word is a maximal run of bytes of a class; all classes here split UTF-8 only at ASCII bytes, so
bytes and code points give the same words. Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

# Texts are handled together up to this many bytes; a longer text is handled alone.
PIECE_BYTES = 4 << 20

_BYTES = np.arange(256)
NOT_WHITE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LETTERS_DIGITS = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 256  # bytes of a word from which it is hashed on its own


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; data must go on for 8 bytes after the last span."""
    loads = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    h = mixed((loads[start] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * _MUL)
    todo = np.flatnonzero((length > 8) & (length <= _LONG))
    at = 8
    while len(todo):
        left = length[todo] - at
        h[todo] = mixed(h[todo] * _MUL + (loads[start[todo] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(length > _LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of some texts: word i is data[start[i]:end[i]]; text d has words first[d]:first[d+1]."""

    data: np.ndarray
    offset: np.ndarray  # of each text in data, and of the end; a line break follows each text
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hashed(self.data, self.start, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from each word on, and whether these lie within its text."""
        return windows(self.hashes(), self.first, size)


def windows(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of `size` word hashes, from prefix sums modulo 2**64."""
    n = len(word)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word * powers(_BASE, n), out=total[1:])
    last = np.minimum(np.arange(n) + size, n)
    h = mixed((total[last] - total[:-1]) * powers(_BASE_INVERSE, n))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return h, left >= size


def split(texts: Sequence[bytes | None], word_bytes: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    """The words of texts in UTF-8; a null text has none."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    # a line break before, after and between the texts, and room for loads of 8 bytes
    raw = b"".join((b"\n", b"\n".join([t or b"" for t in texts]), b"\n" * 9))
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    offset = np.concatenate(([1], np.cumsum(lengths + 1) + 1))
    inside = word_bytes[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    return Words(data, offset, start, end, np.searchsorted(start, offset))


def pieces(texts: Sequence[bytes | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def spans(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some span start:end covers."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
