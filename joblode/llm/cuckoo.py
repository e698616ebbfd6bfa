"""A cuckoo filter over 64-bit keys, filled, asked and emptied in bulk (numpy)."""

from __future__ import annotations

import numpy as np

from joblode.llm._words import mixed

#: Fingerprints of 16 bits in a bucket.
SLOTS = 4
#: Share of the slots that a new table is meant to fill.
LOAD = 0.8
#: Rounds of displacements before the table counts as full.
ROUNDS = 500
_CHUNK = 4096


def buckets_for(keys: int) -> int:
    """The power of two of buckets that holds so many keys."""
    return 1 << max(1, int(np.ceil(np.log2(max(1, keys / SLOTS / LOAD)))))


class Filter:
    """Buckets of fingerprints (0: free). A key has two buckets, of which each follows from the other and the fingerprint."""

    def __init__(self, buckets: int, blob: bytes | None = None):
        if buckets & (buckets - 1) or buckets < 1:
            raise ValueError("the number of buckets is a power of two")
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if blob is None else np.frombuffer(blob, np.uint16).reshape(buckets, SLOTS).copy()
        self._random = np.random.default_rng(20240507)

    @property
    def buckets(self) -> int:
        return len(self.table)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark), (keys & self.mask).astype(np.int64)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mixed(mark.astype(np.uint64), 41) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be held: always where it is, seldom where it is not."""
        mark, at = self._places(keys)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(at, mark)] == mark[:, None]).any(1)

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(at, kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        taken = self.table[at] != 0
        fits = rank < SLOTS - taken.sum(1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        self.table[at[fits], slot] = mark[fits]
        return fits

    def add(self, keys: np.ndarray) -> bool:
        """Hold the keys too (again, where they are held already); False: the table is full and of no further use."""
        mark, at = self._places(keys)
        for _ in range(ROUNDS):
            for _ in range(2):
                left = ~self._settle(mark, at)
                mark, at = mark[left], at[left]
                at = self._other(at, mark)
            if not len(mark):
                return True
            # one of each bucket's homeless displaces one of its fingerprints, which goes on to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = self._random.integers(0, SLOTS, len(one))
            mark[one], self.table[at[one], slot] = self.table[at[one], slot], mark[one]
            at[one] = self._other(at[one], mark[one])
        return False

    def add_new(self, keys: np.ndarray) -> tuple[np.ndarray, bool]:
        """Add keys in their order, each only if it is not held already: which were added, and whether there was room."""
        added = np.zeros(len(keys), bool)
        for a in range(0, len(keys), _CHUNK):
            part = keys[a : a + _CHUNK]
            mark, at = self._places(part)
            # keys of one chunk with the same fingerprint and buckets: the first is added, the others find it
            name = np.minimum(at, self._other(at, mark)) << 16 | mark
            first = np.zeros(len(part), bool)
            first[np.unique(name, return_index=True)[1]] = True
            new = first & ~self.contains(part)
            added[a : a + _CHUNK] = new
            if not self.add(part[new]):
                return added, False
        return added, True

    def remove(self, keys: np.ndarray) -> None:
        """Drop one fingerprint for each key; only keys that are held may be given."""
        mark, at = self._places(keys)
        for m, i, j in zip(mark.tolist(), at.tolist(), self._other(at, mark).tolist(), strict=True):
            for b in (i, j):
                slot = np.flatnonzero(self.table[b] == m)
                if len(slot):
                    self.table[b, slot[0]] = 0
                    break
            else:
                raise ValueError("a key that is not held can't be removed")
