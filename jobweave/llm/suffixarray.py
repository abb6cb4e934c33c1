"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy, to a fixed depth."""

from __future__ import annotations

import numpy as np

from .textops import prefix_hash, range_hash

_U = np.uint64


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their first `depth` bytes (the text is followed by zeros), and the rank of each: its group's first place.

    The first order is by eight bytes. A group ordered to h bytes is refined by the ranks that stand up to h places
    further, which doubles the depth; groups of one are settled and left out of later rounds.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    # ranks count from 1; 0 stands for places beyond the end
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
    h = 8
    while h < depth and n:
        shift = min(h, depth - h)
        sizes = np.diff(np.append(starts, n))
        open_ = np.repeat(sizes > 1, sizes)
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        at = order[slots]
        key = (rank[at].astype(_U) << _U(32)) | rank[at + shift].astype(_U)
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        # a slot starts a group if it did before or if its key differs from the one before
        new[slots[1:]] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        full = np.repeat(starts, np.diff(np.append(starts, n))) + 1
        rank[order[slots]] = full[slots]
        h += shift
    return order, rank[:n] - 1


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int) -> np.ndarray:
    """For each place of `order`, the bytes (at most `depth`) that its suffix shares with the one before it.

    Kasai's rule, along many stretches of the text in step: the prefix shared at a position is at least that of the
    position before it less one. `starts` and `stops` bound the stretches, which cover the text. As the order goes no
    deeper than `depth`, the first of the suffixes that share what is carried over may share less with the one before;
    hashes of what is carried over tell, and that position is compared afresh.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    padded = np.concatenate([data, np.zeros(depth + 1, np.uint8)])
    lcp = np.zeros(n, np.int64)
    sums = prefix_hash(padded)
    by = np.argsort(starts - stops, kind="stable")
    at, ends = starts[by].copy(), stops[by]
    sizes = ends - at
    held = np.zeros(len(at), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))
        p = at[:live] + step
        k = np.maximum(held[:live] - 1, 0)
        slot = place[p]
        before = order[np.maximum(slot - 1, 0)]
        k[np.maximum(p, before) + k > n] = 0
        k[(slot == 0) | (range_hash(sums, p, p + k) != range_hash(sums, before, before + k))] = 0
        active = np.flatnonzero(slot > 0)
        while len(active):
            more = (k[active] < depth) & (padded[p[active] + np.minimum(k[active], depth)] == padded[before[active] + np.minimum(k[active], depth)]) & (np.maximum(p[active], before[active]) + k[active] < n)
            active = active[more]
            k[active] += 1
        lcp[slot] = k
        held[:live] = k
    return lcp
