"""Cuckoo filters over 128-bit keys given as two int64 arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _prints(low: np.ndarray) -> np.ndarray:
    """16-bit fingerprints, never 0 (0 is a free slot)."""
    x = (low.astype(np.int64).view(np.uint64) * _MIX) >> np.uint64(48)
    return np.where(x == 0, 1, x).astype(np.uint16)


def _other(bucket: np.ndarray, fingerprint: np.ndarray, mask: int) -> np.ndarray:
    return bucket ^ (((fingerprint.astype(np.uint64) * np.uint64(0xC6A4A7935BD1E995)) >> np.uint64(20)).astype(np.int64) & mask)


class CuckooFilter:
    """Set with deletion: 4 slots of 16 bits a bucket, a power of two of buckets."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter of these distinct keys with space for `room` more; grows until all fit."""
        buckets = 1
        while buckets * SLOTS * 0.8 < len(high) + room + 1:
            buckets *= 2
        while True:
            out = cls(np.zeros((buckets, SLOTS), dtype=np.uint16))
            if out.insert(high, low):
                return out
            buckets *= 2

    def _place(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return high.astype(np.int64) & self.mask, _prints(low)

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Add keys that are not in the set; False when the filter is too full (then build a larger one)."""
        bucket, fp = self._place(high, low)
        for turn in range(2):  # all at once into the first, then the other bucket
            order = np.argsort(bucket, kind="stable")
            bucket, fp = bucket[order], fp[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            used = (self.table[bucket] != 0).sum(axis=1)
            fits = used + rank < SLOTS
            # Free slots are always the last ones of a bucket.
            self.table[bucket[fits], (used + rank)[fits]] = fp[fits]
            bucket, fp = bucket[~fits], fp[~fits]
            if turn == 0:
                bucket = _other(bucket, fp, self.mask)
        return all(self._kick(int(b), int(f)) for b, f in zip(bucket, fp, strict=True))

    def _kick(self, bucket: int, fp: int) -> bool:
        for k in range(_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return True
            slot = (fp + k) % SLOTS
            fp, row[slot] = int(row[slot]), fp
            bucket = int(_other(np.array([bucket]), np.array([fp], dtype=np.uint16), self.mask)[0])
        return False

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take out keys that are in the set."""
        bucket, fp = self._place(high, low)
        other = _other(bucket, fp, self.mask)
        for a, b, f in zip(bucket.tolist(), other.tolist(), fp.tolist(), strict=True):
            for x in (a, b):
                row = self.table[x]
                at = np.flatnonzero(row == f)
                if len(at):
                    last = int((row != 0).sum()) - 1
                    row[at[0]], row[last] = row[last], 0
                    break

    def may_have(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        bucket, fp = self._place(high, low)
        found = (self.table[bucket] == fp[:, None]).any(axis=1)
        return found | (self.table[_other(bucket, fp, self.mask)] == fp[:, None]).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").astype(np.uint16).reshape(-1, SLOTS))
