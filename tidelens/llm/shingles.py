"""Word shingles of ASCII-folded texts as sorted 64-bit hashes, from flat byte arrays."""

from __future__ import annotations

import numpy as np

from tidelens.llm.common import mix64

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))  # a random word for each byte
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = mix64(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown and kept in the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(10, int(n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any stretch is one subtraction; see ``stretch``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def stretch(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of values a..b, alike wherever they stand."""
    return mix64((sums[b] - sums[a]) * powers(_INVERSE, len(sums))[a] + (b - a).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text: runs of bytes that are no ASCII white space, A-Z in lower case."""
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    return stretch(prefix_sums(_VALUES[_LOWER[data]]), edges[::2], edges[1::2])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all shingles of ``width`` words in order; fewer words are one shingle, none are none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    if len(words) < width:
        total = (words * _ORDER[:len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix64(np.array([total], np.uint64))
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k:k + n] * _ORDER[k]
    return mix64(total)


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(word_hashes(data), width))
