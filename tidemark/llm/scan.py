"""Vectorised reading of texts: words, hashes and n-grams of many whole texts at once with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as the
pattern ``[^\\x20\\x09-\\x0D]+`` over characters. Nothing here keeps state between calls, and the
memory used follows the size of one slice of texts (or of one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_OTHER_CODES = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.int64).astype(_U)
_SHIFT_CODES = (_rng.integers(1, 2**62, 64, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; tables for usual slices are kept."""
    if len(_powers[0]) < n or (len(_powers[0]) > 4 * SLICE_BYTES and n <= SLICE_BYTES):
        size = max(n, SLICE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, _U(base))
            table[0] = _U(1)
            _powers[k] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that all bits depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of ``limit`` bytes together at most, or of one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Slice:
    """The bytes and words of some whole texts, laid end to end with a space after each."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])  # a text's first byte
        self.space = SPACE[self.buf]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], self.space]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.at)  # a text's first word
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def word_hashes(self, which: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words: polynomials of the bytes, finalised. Given the numbers of some words, other hashes of these."""
        starts, ends, codes = (self.starts, self.ends, _BYTE_CODES) if which is None else (self.starts[which], self.ends[which], _OTHER_CODES)
        if not len(starts):
            return np.zeros(0, _U)
        power, inverse = power_tables(len(self.buf) + 1)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(codes[self.buf] * power[: len(self.buf)], dtype=_U)])
        return mix((total[ends] - total[starts]) * inverse[starts])

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``width`` words that lie in one text, and their first words."""
        m = len(hashes) - width + 1
        if m <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        code = np.zeros(m, _U)
        for k in range(width):
            code += hashes[k : k + m] * _SHIFT_CODES[k]
        at = np.flatnonzero(self.doc[:m] == self.doc[width - 1 : width - 1 + m])
        return mix(code[at]), at


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted distinct 64-bit hashes.

    A text with fewer than ``width`` words has its whole sequence as the one shingle; one without
    words has an empty set. Letters are taken as they are: lower-case first if case is to be ignored.
    """
    for i, j in slices(texts):
        part = Slice(texts[i:j])
        words = part.word_hashes()
        codes, at = part.windows(words, width)
        cut = np.searchsorted(part.doc[at], np.arange(part.n + 1))
        for k in range(part.n):
            n = int(part.n_words[k])
            if n >= width:
                yield np.unique(codes[cut[k] : cut[k + 1]])
            elif n:
                own = words[part.first[k] : part.first[k + 1]]
                yield mix(np.array([np.sum(own * _SHIFT_CODES[:n], dtype=_U) ^ _SHIFT_CODES[32 + n]], _U))
            else:
                yield np.zeros(0, _U)


def ngram_codes(part: Slice, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (2**bits) of the byte n-grams that lie in one text, and how many each text has."""
    code = np.zeros(max(len(part.buf) - width + 1, 0), np.uint32)
    for k in range(width):
        code = code * np.uint32(0x01000193) + part.buf[k : k + len(code)]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    sizes = np.maximum(np.diff(part.at) - 1 - (width - 1), 0)
    within = np.repeat(part.at[:-1], sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    return code[within], sizes
