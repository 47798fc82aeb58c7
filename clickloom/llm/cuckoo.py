"""A cuckoo filter over 64-bit hashes: inserts, deletes and vectorised look-ups."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; a key may sit in either of two buckets.

    The second bucket follows from the first and the fingerprint, so that an entry can move and
    be deleted without its key. A key that was inserted is always found. One that was not is
    found with a chance of about 8 in 2^32: callers back the filter by an exact table.
    A key must be deleted only if it was inserted, once for each insertion.
    """

    def __init__(self, capacity: int):
        buckets = 16
        while buckets * SLOTS * 0.85 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint32)
        self.size = 0

    @staticmethod
    def from_bytes(content: bytes) -> "CuckooFilter":
        self = CuckooFilter(0)
        self.table = np.frombuffer(content, np.uint32).reshape(-1, SLOTS).copy()
        self.size = int(np.count_nonzero(self.table))
        return self

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (hashes >> np.uint64(32)).astype(np.uint32)
        print_ = np.where(print_ == 0, np.uint32(1), print_)
        first = _mixed(hashes) & mask
        return print_, first, (first ^ _mixed(print_.astype(np.uint64))) & mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes) or not self.size:
            return np.zeros(len(hashes), bool)
        print_, first, second = self._places(hashes)
        seen = (self.table[first] == print_[:, None]).any(1)
        return seen | (self.table[second] == print_[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> None:
        """Add keys; the filter must have been made large enough for all it will hold."""
        mask = np.uint64(len(self.table) - 1)
        for print_, first, second in zip(*self._places(np.asarray(hashes, np.uint64))):
            for place in (first, second):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = print_
                    break
            else:
                place = second
                for kick in range(2000):
                    slot = kick % SLOTS
                    print_, self.table[place, slot] = self.table[place, slot], print_
                    place = (place ^ _mixed(np.uint64([print_]))[0]) & mask
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = print_
                        break
                else:
                    raise OverflowError("the cuckoo filter is full")
            self.size += 1

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one entry for each key."""
        for print_, first, second in zip(*self._places(np.asarray(hashes, np.uint64))):
            for place in (first, second):
                held = np.flatnonzero(self.table[place] == print_)
                if len(held):
                    self.table[place, held[0]] = 0
                    self.size -= 1
                    break
            else:
                raise KeyError("deleting a key that the cuckoo filter does not hold")


def built(hashes: np.ndarray) -> CuckooFilter:
    """A filter of the smallest size that takes all keys."""
    capacity = len(hashes)
    while True:
        held = CuckooFilter(capacity)
        try:
            held.insert(hashes)
            return held
        except OverflowError:
            capacity = len(held.table) * SLOTS
