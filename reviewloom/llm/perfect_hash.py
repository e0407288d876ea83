"""Minimal perfect hashing of distinct 64-bit keys, built and looked up in whole arrays.

A table has ``shards``; a key's shard comes from its hash. In a shard the keys go through levels: at each one a key hashes to
a bit among two for every key that is left; a key alone on its bit has its place there, the others go on to the next
level. A key's index is the number of set bits before its own one, so n keys have the indexes 0 to n - 1. A key that was
never put in may find an index too, so each index's key is kept and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits for a key at each level, in 64-bit words that hold them, and levels at most: each key that is left
#: finds a place of its own with a chance above a half.
SPACE, LEVELS = 2, 48
#: Bits of a remembered key's place: the last key of each place is found without its levels.
PLACES = 16


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """32 well-mixed bits of each key, as uint64; another mix for each salt."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x >> np.uint64(32)


def below(hashes: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """32-bit hashes spread over 0 .. size - 1."""
    return ((hashes * np.asarray(sizes, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return below(mixed(keys, LEVELS), shards)


def built(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each level, all levels' words, and the distinct ``keys`` in order of their indexes."""
    left, words, sizes, placed = np.asarray(keys), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-SPACE * len(left) // 64)
        at = below(mixed(left, level), size * 64)
        alone = np.bincount(at, minlength=size * 64) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        own = alone[at]
        placed.append(left[own][np.argsort(at[own])])
        left = left[~own]
    if len(left):
        raise ValueError("keys are not distinct")
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return np.array(sizes, dtype=np.int64), join(words, np.uint64), join(placed, np.int64)


@dataclass
class Table:
    """The shards ``numbers`` of ``shards``, with what ``built`` gave for each; indexes run on from shard to shard."""

    shards: int
    numbers: list[int]
    sizes: list[np.ndarray]
    words: list[np.ndarray]
    keys: list[np.ndarray]

    def __post_init__(self):
        levels = max((len(s) for s in self.sizes), default=0)
        # Word 0 has no bits; shards that aren't here, and levels they haven't, have it alone.
        self.bits = np.concatenate([np.zeros(1, np.uint64), *self.words])
        self.first = np.zeros((self.shards, levels), dtype=np.int64)
        self.size = np.ones((self.shards, levels), dtype=np.int64)
        place = 1
        for number, sizes in zip(self.numbers, self.sizes, strict=True):
            self.first[number, : len(sizes)] = place + np.cumsum(sizes) - sizes
            self.size[number, : len(sizes)] = sizes
            place += int(sizes.sum())
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.key = np.concatenate([np.zeros(0, np.int64), *self.keys])
        self.starts = np.cumsum([0, *map(len, self.keys)])
        # At first every place remembers the key of index 0; of no keys, none is ever found.
        self.known = np.full(1 << PLACES, self.key[0] if len(self.key) else 0, dtype=np.int64)
        self.index = np.full(1 << PLACES, 0 if len(self.key) else -1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.key)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for one that isn't here."""
        place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)
        found = self.index[place]
        new = np.flatnonzero(self.known[place] != keys)
        if len(new):
            place, keys = place[new], keys[new]
            found[new] = index = self._searched(keys)
            self.known[place] = keys
            kept = self.known[place] == keys  # of several keys at one place, one is kept
            self.index[place[kept]] = index[kept]
        return found

    def _searched(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        left, shard = np.arange(len(keys)), shard_of(keys, self.shards)
        for level in range(self.first.shape[1]):
            if not len(left):
                break
            own = shard[left]
            at = below(mixed(keys[left], level), self.size[own, level] * 64)
            word, bit = self.first[own, level] + (at >> 6), (at & 63).astype(np.uint64)
            bits = self.bits[word]
            here = (bits >> bit) & np.uint64(1) == 1
            lower = bits[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            index = self.before[word[here]] + np.bitwise_count(lower)
            same = self.key[index] == keys[left[here]]
            found[left[here][same]] = index[same]
            left = left[~here]
        return found
