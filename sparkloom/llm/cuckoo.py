"""A cuckoo filter over 16-byte digests, in NumPy: whole arrays of digests are added, removed and looked up at once.

A digest's fingerprint (16 bits, never 0) lies in one of two buckets; the second follows from the first and the fingerprint, so an entry can be
moved without its digest. Equal entries are interchangeable, so a removal never hides another digest as long as each digest is added once and only
digests that were added are removed; the reference counts beside the filter see to that. When moving entries finds no room, every bucket gets
four more slots: nothing that was added is ever lost, only the rate of false positives grows (about 2 * slots / 65536).
"""

from __future__ import annotations

import numpy as np

SLOTS, MOST_MOVES, LOAD = 4, 100, 0.8


def digests(keys: list[bytes]) -> np.ndarray:
    """16-byte digests as pairs of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _first(buckets: np.ndarray) -> np.ndarray:
    """A mask of the first of each bucket's entries."""
    out = np.zeros(len(buckets), bool)
    out[np.unique(buckets, return_index=True)[1]] = True
    return out


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table  # a row per bucket, entries from the left, 0 where none is
        self.used = (table != 0).sum(1)

    @classmethod
    def sized(cls, expected: int) -> Cuckoo:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, expected) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        buckets, slots = np.frombuffer(data[:8], np.uint32)
        return cls(np.frombuffer(data[8:], np.uint16).reshape(buckets, slots).copy())

    def write(self) -> bytes:
        return np.array(self.table.shape, np.uint32).tobytes() + self.table.tobytes()

    def __len__(self) -> int:
        return int(self.used.sum())

    def _other(self, fingerprint: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((fingerprint.astype(np.int64) * 0x9E3779B1 >> 8) & (len(self.table) - 1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fingerprint = np.maximum(keys[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        bucket = (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fingerprint, bucket, self._other(fingerprint, bucket)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for each digest that was added; for others too, at the filter's rate of false positives."""
        fingerprint, one, two = self._places(keys)
        return (self.table[one] == fingerprint[:, None]).any(1) | (self.table[two] == fingerprint[:, None]).any(1)

    def _put(self, fingerprint: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Place what has room; a mask of the rest."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        slot = self.used[b] + rank
        fits = slot < self.table.shape[1]
        self.table[b[fits], slot[fits]] = fingerprint[order][fits]
        self.used += np.bincount(b[fits], minlength=len(self.used))
        left = np.zeros(len(b), bool)
        left[order[~fits]] = True
        return left

    def add(self, keys: np.ndarray) -> None:
        fingerprint, bucket, two = self._places(keys)
        left = self._put(fingerprint, bucket)
        fingerprint, bucket = fingerprint[left], two[left]
        moves = 0
        while True:
            left = self._put(fingerprint, bucket)
            fingerprint, bucket = fingerprint[left], bucket[left]
            if not len(bucket):
                return
            moves += 1
            if moves % MOST_MOVES == 0:
                self.table = np.pad(self.table, ((0, 0), (0, SLOTS)))
                continue
            # One entry of each full bucket makes room and goes to its other bucket; who else waits for that bucket waits on.
            first = _first(bucket)
            b, slot = bucket[first], (fingerprint[first].astype(np.int64) + moves) % self.table.shape[1]
            out = self.table[b, slot].copy()
            self.table[b, slot] = fingerprint[first]
            fingerprint, bucket = np.concatenate([out, fingerprint[~first]]), np.concatenate([self._other(out, b), bucket[~first]])

    def remove(self, keys: np.ndarray) -> None:
        """Take digests out that were added before."""
        fingerprint, one, two = self._places(keys)
        tried = np.zeros(len(one), bool)
        while len(one):
            first = _first(one)
            at = np.flatnonzero(first)
            match = self.table[one[at]] == fingerprint[at, None]
            found = match.any(1)
            if (tried[at] & ~found).any():
                raise ValueError("a digest that was never added can't be removed")
            b, slot = one[at[found]], match[found].argmax(1)
            last = self.used[b] - 1
            self.table[b, slot] = self.table[b, last]
            self.table[b, last] = 0
            self.used[b] = last
            # Who wasn't in the first bucket is in the second; who waited is tried again.
            miss = at[~found]
            one[miss], tried[miss] = two[miss], True
            rest = np.ones(len(one), bool)
            rest[at[found]] = False
            fingerprint, one, two, tried = fingerprint[rest], one[rest], two[rest], tried[rest]
