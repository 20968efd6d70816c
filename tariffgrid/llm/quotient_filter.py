"""Counting quotient filters over packed word-id n-grams: exact counters in few bytes.

An n-gram's word ids are packed into one to three 64-bit limbs, and the limbs are mixed by
an invertible permutation. The first bits of a mixed key are its quotient, all the others
its remainder, so that nothing is lost: a filter gives its n-grams back. As the permutation
spreads keys evenly, ranges of quotients hold like shares of the n-grams whatever these are.
"""

from __future__ import annotations

import struct

import numpy as np

#: Odd multipliers of the permutation; any would do that mix well.
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: The counter byte that says: the count stands in the list of large ones.
_LARGE = 255
_HEAD = struct.Struct("<qqq")

Limbs = list[np.ndarray]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _cross(x: np.ndarray) -> np.ndarray:
    y = x * np.uint64(_M3)
    return y ^ (y >> np.uint64(29))


class NgramKeys:
    """Packs n word ids of so many bits each, and permutes the packed keys."""

    def __init__(self, n: int, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError("word ids of 1 to 32 bits")
        a_limb = 64 // bits
        self.n, self.bits = n, bits
        self.words = [min(a_limb, n - k) for k in range(0, n, a_limb)]
        self.widths = [k * bits for k in self.words]

    def pack(self, ids: np.ndarray, starts: np.ndarray) -> Limbs:
        """The packed n-grams of ids at these starts."""
        limbs, at = [], 0
        for words in self.words:
            limb = np.zeros(len(starts), np.uint64)
            for k in range(at, at + words):
                limb = (limb << np.uint64(self.bits)) | ids[starts + k].astype(np.uint64)
            limbs.append(limb)
            at += words
        return limbs

    def unpack(self, limbs: Limbs) -> np.ndarray:
        """The word ids, a row for each n-gram."""
        found, at = np.empty((len(limbs[0]), self.n), np.int64), 0
        for limb, words in zip(limbs, self.words):
            for k in range(words):
                found[:, at + k] = (limb >> np.uint64(self.bits * (words - 1 - k))) & _mask(self.bits)
            at += words
        return found

    def permute(self, limbs: Limbs) -> Limbs:
        out = list(limbs)
        if len(out) > 1:
            for i in range(1, len(out)):
                out[i] = out[i] ^ (_cross(out[i - 1]) & _mask(self.widths[i]))
            out[0] = out[0] ^ (_cross(out[-1]) & _mask(self.widths[0]))
        for i, width in enumerate(self.widths):
            half, mask, x = np.uint64((width + 1) // 2), _mask(width), out[i]
            for m in (_M1, _M2):
                x = (x * np.uint64(m)) & mask
                x = x ^ (x >> half)
            out[i] = x
        return out

    def restore(self, limbs: Limbs) -> Limbs:
        out = list(limbs)
        for i, width in enumerate(self.widths):
            half, mask, x = np.uint64((width + 1) // 2), _mask(width), out[i]
            for m in (_M2, _M1):
                x = x ^ (x >> half)
                x = (x * np.uint64(pow(m, -1, 1 << width))) & mask
            out[i] = x
        if len(out) > 1:
            out[0] = out[0] ^ (_cross(out[-1]) & _mask(self.widths[0]))
            for i in range(len(out) - 1, 0, -1):
                out[i] = out[i] ^ (_cross(out[i - 1]) & _mask(self.widths[i]))
        return out

    def quotient(self, limbs: Limbs, bits: int) -> np.ndarray:
        """The first so many bits of each key (all of the first limb, if it has fewer)."""
        return (limbs[0] >> np.uint64(max(0, self.widths[0] - bits))).astype(np.int64)


def counted(limbs: Limbs, counts: np.ndarray | None = None) -> tuple[Limbs, np.ndarray]:
    """The distinct keys in order, and the sum of their counts (1 each by default)."""
    if not len(limbs[0]):
        return limbs, np.zeros(0, np.int64)
    if counts is None and len(limbs) == 1:
        limbs = [np.sort(limbs[0])]
    else:
        order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        counts = None if counts is None else counts[order]
    new = np.ones(len(limbs[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(new))) if counts is None else np.add.reduceat(counts, at)
    return [x[at] for x in limbs], sums.astype(np.int64)


def merged(filters: list[tuple[Limbs, np.ndarray]]) -> tuple[Limbs, np.ndarray]:
    """One sorted filter of several."""
    if len(filters) == 1:
        return filters[0]
    return counted([np.concatenate([f[0][i] for f in filters]) for i in range(len(filters[0][0]))], np.concatenate([f[1] for f in filters]))


def _bytes_of(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]).tobytes()


def _from_bytes(data: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = -(-width // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(n).astype(np.uint64), at + n * size


def to_block(keys: NgramKeys, limbs: Limbs, counts: np.ndarray, part_bits: int) -> bytes:
    """The bytes of a sorted filter whose keys agree in their first part_bits.

    A bit for each quotient that occurs, a bit for each remainder that ends its quotient's
    run, the remainders in whole bytes, a byte for each counter and eight for a large one.
    """
    n, rest = len(counts), max(0, keys.widths[0] - part_bits)
    slots = min(rest, max(0, n.bit_length() - 1))
    local = limbs[0] & _mask(rest)
    slot = (local >> np.uint64(rest - slots)).astype(np.int64) if slots else np.zeros(n, np.int64)
    occupied = np.zeros(1 << slots, np.uint8)
    occupied[slot] = 1
    ends = np.ones(n, np.uint8)
    ends[:-1] = slot[1:] != slot[:-1]
    large = counts[counts >= _LARGE]
    return b"".join(
        (
            _HEAD.pack(n, slots, len(large)),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            _bytes_of(local & _mask(rest - slots), rest - slots),
            *(_bytes_of(x, w) for x, w in zip(limbs[1:], keys.widths[1:])),
            np.minimum(counts, _LARGE).astype(np.uint8).tobytes(),
            large.astype("<i8").tobytes(),
        )
    )


def from_block(keys: NgramKeys, data: bytes, part: int, part_bits: int) -> tuple[Limbs, np.ndarray]:
    """The sorted filter of a block, and its counters."""
    view = memoryview(data)
    n, slots, n_large = _HEAD.unpack_from(view)
    at, rest = _HEAD.size, max(0, keys.widths[0] - part_bits)
    size = -(-(1 << slots) // 8)
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=1 << slots))
    at += size
    size = -(-n // 8)
    ends = np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=n)
    at += size
    run = np.cumsum(ends, dtype=np.int64) - ends
    first, at = _from_bytes(view, at, n, rest - slots)
    first |= (occupied[run].astype(np.uint64) << np.uint64(rest - slots)) if rest - slots < 64 else np.uint64(0)
    if keys.widths[0] > rest:
        first |= np.uint64(part << rest)
    limbs = [first]
    for width in keys.widths[1:]:
        limb, at = _from_bytes(view, at, n, width)
        limbs.append(limb)
    counts = np.frombuffer(view, np.uint8, n, at).astype(np.int64)
    counts[counts == _LARGE] = np.frombuffer(view, "<i8", n_large, at + n)
    return limbs, counts
