"""Groups of equal strings of a minimum length, by threshold-bounded interval
expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def rotation_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the text's rotations by at least their first ``depth`` bytes
    (prefix doubling from eight bytes on; ties stay in any order)."""
    n = len(text)
    around = np.concatenate([text, text[np.arange(8) % n]]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | around[k:n + k]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], ordered[1:] != ordered[:-1]])
        if known >= depth or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = (rank << np.uint64(32)) | np.roll(rank, -known)
        known *= 2


def boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each place of the order behind the transform ``bwt``: whether it has
    less than ``length`` bytes in common with the place before.

    Breadth first: from the interval of all rotations (the empty string), each
    interval of a string is extended to the left by every byte that stands in
    its part of the transform. The extended intervals' ends are places whose
    common prefix is one longer than the level before; an interval whose end
    was known is not followed, so common prefixes come out by increasing value
    and each is found once. Past ``length - 1`` the rest has at least
    ``length`` in common."""
    n = len(bwt)
    known = np.zeros(n + 1, bool)
    known[0] = True
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
    # from where the byte's next / last occurrence before is, along the order
    lows, highs = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        sizes = highs - lows
        item = np.repeat(np.arange(len(lows)), sizes)
        at = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes - lows, sizes)
        to, byte = lf[at], bwt[at].astype(np.int64)
        after, before = to + 1, to - 1
        is_last = (after >= first[byte + 1]) | (psi[np.minimum(after, n - 1)] >= highs[item])
        is_first = (before < first[byte]) | (psi[np.maximum(before, 0)] < lows[item])
        key = item * 256 + byte
        new_high, new_low = after[is_last], to[is_first]
        new_high = new_high[np.argsort(key[is_last], kind="stable")]
        new_low = new_low[np.argsort(key[is_first], kind="stable")]
        fresh = ~known[new_high]
        lows, highs = new_low[fresh], new_high[fresh]
        known[highs] = True
        # two intervals of a level may end at the same place: one is enough
        highs, one = np.unique(highs, return_index=True)
        lows = lows[one]
        if not len(lows):
            break
    return known[:n]


def equal_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): places of the text in an order, and for each in that
    order the number of its group; places are in one group if the ``length``
    bytes from them on (around the end) are equal."""
    order = rotation_order(text, length)
    bwt = text[order - 1]
    return order, np.cumsum(boundaries(bwt, length)) - 1
