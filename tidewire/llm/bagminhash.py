"""BagMinHash signatures: unbiased minwise hashing of weighted sets.

An element owns one Poisson process of points in weight x time, shared by all m signature places: every point is dealt to a
random place, and a place keeps the earliest point that falls below the weight its element has in the bag. Two bags then agree
at a place with the probability of their weighted Jaccard similarity. Weights are discretised to 2**depth levels; the process
over the whole range is the top of a hierarchy of halves, and a point's coordinate is the path of coins by which it falls to
a level, so an element's points at one weight are those of its points at a greater weight that fall low enough.

Times come in order, so a process is followed only to the time at which the bag's places are full: with total weight W,
(log m + SLACK) / W leaves a place empty in one of e**SLACK bags, which are taken up again with twice the time. A bag of any
size so costs about m * (log m + SLACK) points in all, not m for each of its elements.
"""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Points of a process drawn at once, the margin of time, elements followed at once, and rows of points gathered at once.
CHUNK, SLACK, BLOCK, GATHER = 32, 5.0, 1 << 17, 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def element_points(elements: np.ndarray, levels: np.ndarray, until: np.ndarray, places: int, depth: int) -> np.ndarray:
    """First times, not after until, of each element's points below its level, by place: (n, places) float32, inf where there is
    none. levels lie in 1..2**depth."""
    out = np.full((len(elements), places), np.inf, dtype=np.float32)
    seeds, at, start = _mix(elements.astype(np.uint64)), np.zeros(len(elements)), 0
    rows = np.arange(len(elements))
    while len(rows):
        with np.errstate(over="ignore"):
            h = _mix(seeds[rows][:, None] + np.arange(start, start + CHUNK, dtype=np.uint64)[None, :] * _GOLD)
            coins = _mix(h)
        wait = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (places << depth)
        time = at[rows][:, None] + np.cumsum(wait, axis=1)
        place = ((coins >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        low = (coins & np.uint64((1 << depth) - 1)).astype(np.int64)
        row, k = np.nonzero((low < levels[rows][:, None]) & (time <= until[rows][:, None]))
        cell = rows[row] * places + place[row, k].astype(np.int64)
        flat, found = out.reshape(-1), time[row, k].astype(np.float32)
        empty = np.isinf(flat[cell])
        # of several points the first is written last
        flat[cell[empty][::-1]] = found[empty][::-1]
        at[rows] = time[:, -1]
        rows = rows[time[:, -1] < until[rows]]
        start += CHUNK
    return out


def signatures(elements: np.ndarray, levels: np.ndarray, starts: np.ndarray, places: int, depth: int) -> np.ndarray:
    """Signatures of bags laid one after another (starts: first position of each, none empty): (bags, places) uint32.

    A place is identified by its earliest time, which tells the element and point apart up to chance of 2**-24."""
    elements = elements.astype(np.uint64)
    sizes = np.diff(np.append(starts, len(elements)))
    horizon = (np.log(places) + SLACK) / np.add.reduceat(levels, starts)
    best = np.full((len(starts), places), np.inf, dtype=np.float32)
    todo = np.arange(len(starts))
    while len(todo):
        best[todo] = np.inf
        bag = np.repeat(todo, sizes[todo])
        begins = np.cumsum(sizes[todo]) - sizes[todo]
        index = np.arange(len(bag)) + np.repeat(starts[todo] - begins, sizes[todo])
        for a in range(0, len(index), BLOCK):  # bounds what is held at once, whatever the size of a bag
            part, of = index[a : a + BLOCK], bag[a : a + BLOCK]
            # an element that several bags have at one level is followed once, as far as any of them needs
            order = np.lexsort((levels[part], elements[part]))
            e, w = elements[part][order], levels[part][order]
            first = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (w[1:] != w[:-1])])
            group = np.empty(len(part), dtype=np.int64)
            group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
            far = np.maximum.reduceat(horizon[of][order], first)
            points = element_points(e[first], w[first], far, places, depth)
            for b in range(0, len(part), GATHER):
                own = of[b : b + GATHER]
                begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                found = np.minimum.reduceat(points[group[b : b + GATHER]], begin, axis=0)
                best[own[begin]] = np.minimum(best[own[begin]], found)
        todo = todo[~(best[todo] <= horizon[todo][:, None]).all(axis=1)]
        horizon[todo] *= 2
    return best.view(np.uint32)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band of so many places: (bags, places // rows) int64."""
    n, m = sig.shape
    grouped = sig[:, : m - m % rows].reshape(n, m // rows, rows).astype(np.uint64)
    h = _mix(np.arange(m // rows, dtype=np.uint64))[None, :].repeat(n, axis=0)
    for k in range(rows):
        h = _mix(h ^ grouped[:, :, k])
    return h.view(np.int64)
