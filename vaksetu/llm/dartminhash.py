"""DartMinHash (Christiani 2020): weighted min-wise signatures from hashed darts.

Every element owns an infinite plane of (weight, rank). It is cut into unit cells; a cell's hash says how many darts
(Poisson, mean 1) hit it and where. A set sees the darts whose weight coordinate lies below the element's weight, in
order of rank, and each of the k coordinates keeps the earliest dart thrown at it. Two sets agree in a coordinate with
probability equal to their weighted Jaccard similarity. About ``k ln k + 2k`` darts a set fill all coordinates;
sets that still lack one look at higher ranks until none is empty, so signatures are always complete.
"""

from __future__ import annotations

import math

import numpy as np

from .words import GOLDEN, U64, mix

EMPTY = U64(0xFFFFFFFFFFFFFFFF)
RANK_BITS, ID_BITS = 22, 24
STEP = U64(0xD1B54A32D192ED03)


def _poisson_table() -> np.ndarray:
    """16 hash bits -> number of darts in a cell of area 1."""
    bounds, p, total = [], math.exp(-1), 0.0
    for n in range(1, 10):
        total += p
        bounds.append(total)
        p /= n
    return np.searchsorted(np.array(bounds), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


_DARTS = _poisson_table()


def signatures(elements: np.ndarray, sets: np.ndarray, count: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """uint64[count, k]; a row of EMPTY for a set without positive weight.

    elements: element hashes, sets: the set of each (ascending). Without weights each distinct element weighs 1 and
    repeats in a set change nothing. Weights must be finite; those not above 0 are left out.
    """
    out = np.full(count * k, EMPTY, U64)
    limit = None
    if weights is not None:
        keep = weights > 0
        elements, sets, weights = elements[keep], sets[keep], weights[keep].astype(float)
        cells = np.ceil(weights).astype(np.int64)
        which = np.repeat(np.arange(len(cells)), cells)
        cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        limit = np.minimum(1.0, weights[which] - cell)
        elements, sets = mix(elements[which] + cell.astype(U64) * STEP), sets[which]
        mass = np.bincount(sets, limit, count)
    else:
        mass = np.bincount(sets, minlength=count).astype(float)
    low = np.zeros(count, np.int64)
    high = np.ceil((k * math.log(k) + 2 * k) / np.maximum(mass, 1e-9)).astype(np.int64)
    todo = mass > 0
    while todo.any():
        some = slice(None) if todo.all() else np.flatnonzero(todo[sets])
        e, s = elements[some], sets[some]
        ranks = (high - low)[s]
        which = np.repeat(np.arange(len(e)), ranks)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(ranks) - ranks - low[s], ranks)
        cell = mix(e[which] ^ (rank.astype(U64) * GOLDEN))
        darts = _DARTS[(cell >> U64(48)).astype(np.uint16)]
        at = np.repeat(np.arange(len(cell)), darts)
        nth = np.ones(len(at), np.int64)
        starts = np.cumsum(darts, dtype=np.int64) - darts
        nth = np.arange(len(at)) - starts[at]
        dart = mix(cell[at] + nth.astype(U64) * STEP)
        row, when = s[which[at]], rank[at]
        if limit is not None:
            ok = (mix(dart ^ STEP) >> U64(11)).astype(float) * 2.0**-53 < limit[some][which[at]]
            dart, row, when = dart[ok], row[ok], when[ok]
        coordinate = ((dart & U64(0xFFFFFFFF)) * U64(k) >> U64(32)).astype(np.int64)
        # rank first, then bits that identify the dart: the least value is the earliest dart and names it
        packed = (when.astype(U64) << U64(RANK_BITS + ID_BITS)) | ((dart >> U64(64 - RANK_BITS)) << U64(ID_BITS)) | (mix(dart) >> U64(64 - ID_BITS))
        np.minimum.at(out, row * k + coordinate, packed)
        todo &= (out.reshape(count, k) == EMPTY).any(axis=1)
        low, high = high, high * 2
    return out.reshape(count, k)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """int64[sets, bands]: a hash of each ``rows`` consecutive coordinates, different by band."""
    n, k = signature.shape
    out = np.tile((np.arange(k // rows, dtype=U64) + U64(1)) * STEP, (n, 1))
    for r in range(rows):
        out = mix(out * GOLDEN + signature[:, r : k // rows * rows : rows])
    return out.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """int64[sets]: one bit of each of 64 coordinates, spread over the signature."""
    k = signature.shape[1]
    bits = mix(signature[:, np.arange(64) * k // 64]) & U64(1)
    return (bits << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64).view(np.int64)
