"""A cuckoo filter over 64-bit hashes: insertions, deletions, no false negatives."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = 0xFF51AFD7ED558CCD
_MASK = (1 << 64) - 1


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's second bucket follows from its first and the fingerprint."""

    def __init__(self, buckets: int = 16, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of(cls, keys) -> CuckooFilter:
        """Sized for 75 % load; an overfull one doubles and starts again."""
        need = max(16, 1 << int(len(keys) / (0.75 * SLOTS)).bit_length())
        while True:
            out = cls(need)
            if all(out.insert(k) for k in keys):
                return out
            need *= 2

    def _spot(self, key: int) -> tuple[int, int]:
        return (key >> 20) & (self.buckets - 1), (key & 0xFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (((mark * _MIX & _MASK) >> 33) & (self.buckets - 1))

    def insert(self, key: int) -> bool:
        """False if there is no room after 500 moves; the filter has then lost a mark and must be rebuilt."""
        b, mark = self._spot(key)
        for bucket in (b, self._other(b, mark)):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        for turn in range(500):
            slot = (mark + turn) % SLOTS
            self.cells[b, slot], mark = mark, int(self.cells[b, slot])
            b = self._other(b, mark)
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Take out one mark of a key that was inserted."""
        b, mark = self._spot(key)
        for bucket in (b, self._other(b, mark)):
            at = np.flatnonzero(self.cells[bucket] == mark)
            if len(at):
                self.cells[bucket, at[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which of the uint64 keys may be in."""
        last = np.uint64(self.buckets - 1)
        b = (keys >> np.uint64(20)) & last
        mark = keys & np.uint64(0xFFFF)
        mark[mark == 0] = 1
        other = b ^ (((mark * np.uint64(_MIX)) >> np.uint64(33)) & last)
        m = mark.astype(np.uint16)[:, None]
        return (self.cells[b.astype(np.int64)] == m).any(1) | (self.cells[other.astype(np.int64)] == m).any(1)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        cells = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(cells), cells)
