"""Word shingles as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK_WORDS = 50_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def _spans(words: list[bytes], size: int) -> np.ndarray:
    """Hash of every run of `size` words, one space between words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def text_shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles of a lower-cased text.

    A text with fewer words is one shingle; null and a text without words have none.
    Long texts are hashed in blocks of words, so that work memory stays bounded.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    parts = [_spans(words[k : k + _BLOCK_WORDS + size - 1], size) for k in range(0, len(words) - size + 1, _BLOCK_WORDS)]
    return np.unique(np.concatenate(parts))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
