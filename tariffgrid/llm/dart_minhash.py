"""Weighted MinHash by throwing hashed darts (Christiani, "DartMinHash", 2020).

Over every element lies a region: its weight wide, unbounded in rank. Hashes throw
darts into it as a Poisson process of rate one per unit of weight and rank, so that
a set of elements keeps exactly the darts below its weights. A set of total weight W
looks only at ranks up to t / W, which holds about t darts whatever its size; each
dart belongs to one of k coordinates, and the earliest dart of a coordinate is its
sketch value. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. t = k ln k + 2k fills every coordinate most of the time; sets
with a coordinate left empty look twice as far, which changes no coordinate found.
"""

from __future__ import annotations

import math

import numpy as np

from tariffgrid.llm.shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)
_UNIT = 2.0**-53


def _throw(element: np.ndarray, cell: np.ndarray, part: np.ndarray | None, reach: np.ndarray, owner: np.ndarray):
    """Darts (owner, hash, rank) of unit-wide cells of the elements' regions, up to reach.

    part: how much of each cell lies below the element's weight; None: all of it.
    """
    state = mix(element + (cell + np.uint64(1)) * _SALT)
    rank = np.zeros(len(state))
    while len(state):
        state = mix(state + _STEP)
        rank = rank - np.log1p((state >> np.uint64(11)) * -_UNIT)
        near = np.flatnonzero(rank <= reach)
        state, rank, reach, owner = state[near], rank[near], reach[near], owner[near]
        if part is None:
            yield owner, state, rank
        else:
            part = part[near]
            hit = (mix(state ^ _SALT) >> np.uint64(11)) * _UNIT < part
            yield owner[hit], state[hit], rank[hit]


def sketch(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """The k sketch values of each non-empty set of 64-bit elements, as a (sets, k) array.

    weights: positive floats parallel to the elements; one each if omitted.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    darts = k * math.log(k) + 2 * k
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        weight = None if weights is None else np.concatenate([weights[i] for i in todo]).astype(float)
        total = sizes if weights is None else np.bincount(owner, weights=weight, minlength=len(todo))
        reach, cell, part = (darts / total)[owner], np.zeros(1, np.uint64), None
        if weights is not None:  # one row for each cell that the weight reaches into
            cells = np.maximum(np.ceil(weight).astype(np.int64), 1)
            first = np.repeat(np.cumsum(cells) - cells, cells)
            element, owner, weight, reach = (np.repeat(x, cells) for x in (element, owner, weight, reach))
            cell = (np.arange(len(element)) - first).astype(np.uint64)
            part = np.minimum(weight - cell, 1.0)
        found = list(_throw(element, cell, part, reach, owner))
        who, dart, rank = (np.concatenate([f[c] for f in found]) for c in range(3))
        slot = who * k + (mix(dart + _SALT) % np.uint64(k)).astype(np.int64)
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, slot, rank)
        kept = rank == earliest[slot]
        values = np.zeros(len(todo) * k, np.uint64)
        np.maximum.at(values, slot[kept], dart[kept])
        full = np.isfinite(earliest).reshape(-1, k).all(axis=1)
        out[todo[full]] = values.reshape(-1, k)[full]
        todo, darts = todo[~full], darts * 2
    return out


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit hash for each band of rows of the sketches; equal only within a band."""
    rows = values.reshape(len(values), bands, -1)
    h = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :].repeat(len(values), axis=0)
    for r in range(rows.shape[2]):
        h = mix(h * _SALT + rows[:, :, r])
    return h.view(np.int64)
