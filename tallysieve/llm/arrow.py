"""Arrow batches of texts: bounded slices, words and 64-bit hashes of words, without a loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, WIDE = 2 << 20, 8 << 20  # wide ones where distinct words are worked on once
BLOCK_BYTES = 1 << 20
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
R = np.uint64(0x9FB21C651E98DF25)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_kept: dict[str, Callable[[], object]] = {}


def keeps(name: str, drop: Callable[[], object]) -> None:
    """The operator `name` keeps tables in a worker process; `drop` lets go of them."""
    _kept[name] = drop


def make_room(name: str) -> None:
    """At the start of a task: what other operators kept in this worker process goes, and free memory with it."""
    for other, drop in _kept.items():
        if other != name:
            drop()
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str = "t", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of text each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of all words [^\\x20\\x09-\\x0D]+, and n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~GAPS[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of R and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(int(R), -1, 1 << 64)
        for k, base in enumerate((R, np.uint64(inverse))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over its bytes and its length, mixed."""
    out = np.empty(len(starts), np.uint64)
    if lower:
        data = LOWER[data]
    block = starts // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(starts)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        low, high = starts[a], ends[b - 1]
        power, inverse = _power(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * R)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = (h + words[k : k + n]) * R
        return mix(h)
    power, inverse = _power(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[:n])
