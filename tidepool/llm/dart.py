"""DartMinHash signatures of weighted sets.

Darts fall on the plane of weight and rank as a Poisson process of rate one for
each element, drawn by hashing the element, so that every set sees the same
darts.  A set keeps the darts below its elements' weights.  Each dart belongs
to one of ``k`` coordinates, and a coordinate's value is its dart of lowest
rank: two sets agree there with the probability of their weighted Jaccard
similarity.  Only darts up to a rank of about k ln k over the set's total weight
are drawn at first, so a signature costs the elements plus k ln k darts, not
their product; a set that leaves a coordinate empty is drawn again, twice as
high.

The plane is cut into cells of area one, in which the number of darts is
Poisson(1): weights [0, 1), [1, 2), [2, 4), ... and ranks in steps of one over
the width.
"""

from __future__ import annotations

import math

import numpy as np

from . import words as W

#: Coordinates in a signature, and how they are banded: 60 bands of 8 miss a pair of similarity 0.8 in 2 of 100,000 cases, and longer bands spare comparisons of texts that are less alike.
BANDS, ROWS = 60, 8
K = BANDS * ROWS

#: Cells handled at once.
_CELLS = 1 << 18

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(keys: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, height: np.ndarray, k: int, out: np.ndarray, low: np.ndarray) -> None:
    """Lets the darts of some elements fall into out and low (dart and rank by set and coordinate); height: of each element, the rank up to which darts are drawn."""
    band = 0
    while True:
        left, width = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
        if weights is None:
            live = np.arange(len(keys)) if band == 0 else np.empty(0, dtype=np.int64)
        else:
            live = np.flatnonzero(weights > left)
        if not len(live):
            return
        steps = np.ceil(height[live] * width).astype(np.int64)
        ends = np.cumsum(steps)
        first = 0
        while first < len(live):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CELLS, side="right")))
            _cells(keys, weights, owner, height, live[first:last], steps[first:last], band, left, width, k, out, low)
            first = last
        band += 1


def _cells(keys, weights, owner, height, live, steps, band, left, width, k, out, low) -> None:
    at = np.repeat(live, steps)
    row = np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps)
    cell = W.mix(keys[at] + (row.astype(np.uint64) + np.uint64((band << 40) + 1)) * np.uint64(0x9E3779B97F4A7C15))
    darts = np.searchsorted(_POISSON, _unit(cell), side="right")
    cell, at, row, n = cell[darts > 0], at[darts > 0], row[darts > 0], darts[darts > 0]
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    dart = W.mix(np.repeat(cell, n) ^ ((number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    at = np.repeat(at, n)
    rank = (np.repeat(row, n) + _unit(W.mix(dart + np.uint64(1)))) / width
    keep = rank < height[at]
    if weights is not None:
        keep &= left + _unit(W.mix(dart + np.uint64(2))) * width < weights[at]
    dart, at, rank = dart[keep], at[keep], rank[keep]
    place = owner[at] * k + (W.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-rank)  # the lowest rank is written last and stays
    place, rank, dart = place[order], rank[order], dart[order]
    best = np.full(len(low), np.inf)
    best[place] = rank
    mine = np.zeros(len(out), dtype=np.uint64)
    mine[place] = dart
    better = best < low
    low[better], out[better] = best[better], mine[better]


def signatures(keys: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """A row of k darts for each set; set i has the distinct elements keys[bounds[i]:bounds[i + 1]], all of weight one if no weights are given."""
    sets = len(bounds) - 1
    sizes = np.diff(bounds)
    out = np.zeros(sets * k, dtype=np.uint64)
    low = np.full(sets * k, np.inf)
    total = sizes.astype(float) if weights is None else np.add.reduceat(np.append(weights, 0.0), bounds[:-1]) * (sizes > 0)
    height = np.where(total > 0, (k * math.log(k) + 4 * k) / np.maximum(total, 1e-300), 0)
    owner = np.repeat(np.arange(sets), sizes)
    todo = total > 0
    while todo.any():
        pick = todo[owner]
        own = np.flatnonzero(pick)
        fresh = todo.repeat(k)
        low[fresh] = np.inf
        _throw(keys[own], None if weights is None else weights[own], owner[own], height[owner[own]], k, out, low)
        todo &= ~np.isfinite(low).reshape(sets, k).all(axis=1)
        height = np.where(todo, height * 2, height)
    return out.reshape(sets, k)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each row, the band's number included."""
    rows = signature.shape[1] // bands
    out = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, dtype=np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, c])
        out[:, b] = h
    return out


def signer(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bands of the signatures of plain sets, in parts of bounded size."""
    parts, first = [], 0
    while first < len(bounds) - 1:
        last = min(len(bounds) - 1, first + 128)
        parts.append(band_hashes(signatures(flat[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])))
        first = last
    return np.concatenate(parts)
