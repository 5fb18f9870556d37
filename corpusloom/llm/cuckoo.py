"""Cuckoo filter in numpy: 16-bit fingerprints, 4 slots a bucket, batched insert, delete and lookup.

Items are 64-bit hashes. The filter is a multiset: an item inserted twice must be deleted twice, so callers insert a key
once, when its exact reference count says so, and delete it once.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
HEADER = 16


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None, count: int = 0):
        self.mask = np.int64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.count = count

    @classmethod
    def build(cls, items: np.ndarray) -> CuckooFilter:
        """A filter of all ``items``, doubled until everything fits."""
        buckets = 1
        while buckets * SLOTS * 0.84 < len(items):
            buckets *= 2
        while not (out := cls(buckets)).insert(items):
            buckets *= 2
        return out

    def _spots(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = items.astype(np.int64).view(np.uint64) * MIX
        mark = (x >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (x & np.uint64(0xFFFFFFFFFFFF)).astype(np.int64) & self.mask, mark

    def _other(self, spot: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return spot ^ ((mark.astype(np.uint64) * MIX >> np.uint64(20)).astype(np.int64) & self.mask)

    def _settle(self, spot: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots; True where it worked. Marks that meet in a bucket take its free slots in turn."""
        order = np.argsort(spot, kind="stable")
        s = spot[order]
        turn = np.arange(len(s)) - np.searchsorted(s, s, side="left")
        free = self.table[s] == 0
        rank = np.cumsum(free, axis=1)
        hit = free & (rank == (turn + 1)[:, None])
        row, slot = np.nonzero(hit)
        self.table[s[row], slot] = mark[order][row]
        done = np.zeros(len(s), bool)
        done[order[row]] = True
        return done

    def insert(self, items: np.ndarray, kicks: int = 200) -> bool:
        """False, with an unusable filter, if the items do not fit."""
        spot, mark = self._spots(items)
        for _ in range(2):
            done = self._settle(spot, mark)
            spot, mark = self._other(spot[~done], mark[~done]), mark[~done]
        turn = 0
        while len(spot) and turn < kicks:
            # one eviction a bucket and round; the evicted mark goes to its other bucket
            first = np.unique(spot, return_index=True)[1]
            slot = (mark[first].astype(np.int64) + turn) % SLOTS
            out = self.table[spot[first], slot].copy()
            self.table[spot[first], slot] = mark[first]
            mark[first] = out
            spot[first] = self._other(spot[first], out)
            done = self._settle(spot, mark)
            spot, mark = spot[~done], mark[~done]
            turn += 1
        self.count += len(items)
        return not len(spot)

    def contains(self, items: np.ndarray) -> np.ndarray:
        spot, mark = self._spots(items)
        return (self.table[spot] == mark[:, None]).any(1) | (self.table[self._other(spot, mark)] == mark[:, None]).any(1)

    def delete(self, items: np.ndarray) -> np.ndarray:
        """Remove one mark for each item; True where one was found."""
        spot, mark = self._spots(items)
        gone = np.zeros(len(items), bool)
        for where in (spot, self._other(spot, mark)):
            left = np.flatnonzero(~gone)
            code = where[left] * 65536 + mark[left]
            order = np.argsort(code, kind="stable")
            c = code[order]
            turn = np.arange(len(c)) - np.searchsorted(c, c, side="left")
            same = self.table[where[left][order]] == mark[left][order][:, None]
            hit = same & (np.cumsum(same, axis=1) == (turn + 1)[:, None])
            row, slot = np.nonzero(hit)
            self.table[where[left][order][row], slot] = 0
            gone[left[order[row]]] = True
        self.count -= int(gone.sum())
        return gone

    def to_bytes(self) -> bytes:
        return np.array([len(self.table), self.count], "<i8").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        buckets, count = np.frombuffer(raw[:HEADER], "<i8").tolist()
        return cls(buckets, np.frombuffer(raw[HEADER:], "<u2").reshape(buckets, SLOTS).copy(), count)
