"""Suffix arrays in numpy, and what they say about repeated windows of several texts.

``suffix_order`` refines ranks as Larsson and Sadakane do: the order by the first 8 bytes, then by twice as many each round,
in which only suffixes that still share their rank are sorted, by the rank of the suffix so many bytes further.
``prefixes`` walks each text from left to right as Kasai and others do: a start shares at least one byte less with its
predecessor in the array than the start before it did. All texts are walked side by side.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a little-endian number; past the end are zeros."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(text), dtype="<u8", buffer=padded.data, strides=(1,)).copy()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``text`` in their order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    keys = words_at(text).byteswap()
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    last = np.concatenate([fresh[1:], [True]])
    open_ = np.flatnonzero(~(fresh & last))  # places in groups of more than one
    h = 8
    while len(open_):
        suffix = order[open_]
        ahead = suffix + h
        # Past the end, a shorter suffix comes first; each has a number of its own.
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + n + h, n + h - 1 - (ahead - n))
        pair = rank[suffix] * (2 * n + h + 1) + second
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        order[open_] = suffix
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(fresh, open_, 0))
        last = np.concatenate([fresh[1:], [True]])
        open_ = open_[~(fresh & last)]
        h *= 2
    return order


def prefixes(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """For each valid start, how many bytes (``most`` at most) it shares with the start ``before`` it in order.

    Text r has its valid starts at starts[r] .. starts[r] + counts[r] - 1; ``before`` is -1 where there is none.
    """
    padded = np.concatenate([text, np.zeros(most + 8, dtype=np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
    valid = np.zeros(len(padded), dtype=bool)
    for_all = _spread(starts, counts)
    valid[for_all] = True
    shared = np.zeros(len(text), dtype=np.int16)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    alive = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")
    h = np.zeros(len(starts), dtype=np.int64)
    for step, lanes in enumerate(alive):
        at = starts[:lanes] + step
        other = before[at]
        h = h[:lanes]
        if step:
            came = before[at - 1]
            h = np.where((came >= 0) & valid[came + 1], np.maximum(h - 1, 0), 0)
        h[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (h < most))
        while len(going):
            differ = words[at[going] + h[going]] ^ words[other[going] + h[going]]
            same = differ == 0
            # The lowest set bit tells how many bytes at the front agree.
            low = differ & (~differ + np.uint64(1))
            h[going] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            going = going[same]
            going = going[h[going] < most]
        np.minimum(h, most, out=h)
        shared[at] = h
    return shared


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[r], starts[r] + 1, .. for each r, one after the other."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


def repeated_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a ``width``-byte window in each of the texts, end to end: does it occur twice or more?

    Also the starts in order of their windows, as indices of that same numbering.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 0)
    places = _spread(starts, counts)
    number = np.full(len(text) + 1, -1, dtype=np.int64)
    number[places] = np.arange(len(places))
    order = suffix_order(text)
    order = order[number[order] >= 0]
    before = np.full(len(text) + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    alike = prefixes(text, starts, counts, before, width)[order] >= width
    found = np.zeros(len(places), dtype=bool)
    ranked = number[order]
    found[ranked[alike]] = True
    found[ranked[:-1][alike[1:]]] = True
    return found, ranked
