"""Piece lattice of many short strings at once, in numpy.

A vocabulary is a list of pieces. `Lattice.edges` finds, for all strings of one length, which
substrings are pieces, by rolling 64-bit hashes and one table lookup per substring.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
TABLE_BITS = 19
CROWDED, EMPTY = np.int32(1 << 29), np.int32(0)  # a mark on piece numbers; an empty slot matches by no key


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and the length of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), lengths


def matrix(codes: np.ndarray, lengths: np.ndarray, which: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return codes[starts[which][:, None] + np.arange(n)]


class Lattice:
    def __init__(self, pieces: list[str], longest: int | None = None):
        self.longest = longest or max(map(len, pieces))
        keep = [(p, i) for i, p in enumerate(pieces) if 0 < len(p) <= self.longest]
        hashes = np.zeros(len(keep), np.uint64)
        ids = np.array([i for _, i in keep], np.int32)
        codes, lengths = codes_of([p for p, _ in keep])
        starts = np.cumsum(lengths) - lengths
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            h = np.zeros(len(which), np.uint64)
            m = matrix(codes, lengths, which, starts, int(n))
            for k in range(n):
                h = self._step(h, m[:, k])
            hashes[which] = h
        self.tables = []
        rest = np.arange(len(keep))
        while len(rest):  # what finds its slot taken goes to a next, nearly empty, table; the slot is marked
            slot = self._slot(hashes[rest], len(self.tables))
            first = np.unique(slot, return_index=True)[1]
            key, value = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, EMPTY, np.int32)
            key[slot[first]], value[slot[first]] = hashes[rest[first]], ids[rest[first]]
            later = np.delete(np.arange(len(rest)), first)
            value[slot[later]] |= CROWDED
            self.tables.append((key, value))
            rest = rest[later]

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code.astype(np.uint64) + np.uint64(1)) * BASE

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return ((h * MIX) >> np.uint64(64 - TABLE_BITS - table)) & np.uint64((1 << TABLE_BITS) - 1)

    def lookup(self, h: np.ndarray, table: int = 0) -> np.ndarray:
        """Piece number per hash, -1 for none."""
        key, value = self.tables[table]
        slot = self._slot(h, table).view(np.int64)
        found = value[slot]
        out = np.where(key[slot] == h, found & ~CROWDED, np.int32(-1))
        if table + 1 < len(self.tables):  # only marked slots need the next table
            again = np.flatnonzero((found & CROWDED).astype(bool) & (out < 0))
            if len(again):
                out[again] = self.lookup(h[again], table + 1)
        return out

    def edges(self, m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> piece number per row of a code point matrix, -1 where the substring is no piece."""
        out = {}
        n = m.shape[1]
        for i in range(n):
            h = np.zeros(len(m), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = self._step(h, m[:, j - 1])
                out[i, j] = self.lookup(h)
        return out
