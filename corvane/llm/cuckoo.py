"""A cuckoo filter whose batches of insertions, deletions and probes are vectorised."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Odd 64-bit constant of the multiplicative hash that pairs a fingerprint with its other bucket.
MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints (0: free). A key is two 64-bit halves of its digest."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.table = np.zeros((1 << bits, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        return cls(max(2, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8) + 1)))))

    @classmethod
    def from_bytes(cls, bits: int, data: bytes) -> "CuckooFilter":
        return cls(bits, np.frombuffer(data, np.uint16).reshape(1 << bits, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _first(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = (k2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        return (k1.view(np.uint64) & np.uint64((1 << self.bits) - 1)).astype(np.int64), fp

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        mixed = fp.astype(np.uint64) * MIX >> np.uint64(64 - self.bits)
        return bucket ^ mixed.astype(np.int64)

    def might_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        bucket, fp = self._first(k1, k2)
        here = (self.table[bucket] == fp[:, None]).any(1)
        return here | (self.table[self._other(bucket, fp)] == fp[:, None]).any(1)

    def _place(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots of its bucket; tells which didn't."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        free = self.table[b] == 0
        fits = rank < free.sum(1)
        nth = free.cumsum(1) == (rank + 1)[:, None]
        slot = (nth & free).argmax(1)
        self.table[b[fits], slot[fits]] = fp[order][fits]
        left = np.ones(len(bucket), bool)
        left[order[fits]] = False
        return left

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Inserts distinct keys that it doesn't hold; False if it is too full, then it must be built anew, larger."""
        bucket, fp = self._first(k1, k2)
        random = np.random.default_rng(len(k1))
        for turn in range(500):
            left = self._place(bucket, fp) if len(bucket) else np.zeros(0, bool)
            bucket, fp = bucket[left], fp[left]
            if not len(bucket):
                return True
            if turn:  # one of each bucket drives out a fingerprint, which goes to its other bucket
                _, one = np.unique(bucket, return_index=True)
                slot = random.integers(0, SLOTS, len(one))
                driven = self.table[bucket[one], slot].copy()
                self.table[bucket[one], slot] = fp[one]
                fp[one] = driven
            bucket = self._other(bucket, fp)
        return False

    def _clear(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Frees one slot of its bucket for each fingerprint found there; tells which weren't."""
        left, wait = np.ones(len(bucket), bool), np.arange(len(bucket))
        while len(wait):
            hit = self.table[bucket[wait]] == fp[wait][:, None]
            wait, hit = wait[hit.any(1)], hit[hit.any(1)]
            _, one = np.unique(bucket[wait], return_index=True)  # one of each bucket at a time
            self.table[bucket[wait[one]], hit[one].argmax(1)] = 0
            left[wait[one]] = False
            wait = np.delete(wait, one)
        return left

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Deletes distinct keys that it holds, one fingerprint each."""
        bucket, fp = self._first(k1, k2)
        left = self._clear(bucket, fp)
        self._clear(self._other(bucket, fp)[left], fp[left])
