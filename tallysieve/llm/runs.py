"""Periodic runs of words: every maximal stretch that repeats with some period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of length 2 q
and `shortest` at least, that no neighbouring word extends with period q.

String synchronising sets. At each dyadic scale t = 4, 8, 16, ... every window of t words has a hash as its
identity. A window that lies in a known run with a period of t / 3 or less is out of play. Position s is selected if,
of the windows at s .. s + t that are in play, the one at s or at s + t has the smallest identity: whether s is
selected depends on the 2 t words from there alone, so equal contexts are selected alike, and any
t positions in a row hold a selected one unless they lie in a highly periodic region.

- Periods below 11 are found by comparing words at that distance.
- A run of period q (3 t - 1 <= q <= 6 t - 2) whose first q words hold a selected position holds an equal one
  q further on. Selected positions in reach with the same context propose their distance.
- A run without a selected position consists of two neighbouring highly periodic regions of one smaller
  period that overlap by less than that period (or meet); their words aligned propose the distances.

Each proposal is extended to both sides by comparing words (their 64-bit hashes). Of proposals for the same stretch the smallest
period stays. So all runs are found; hashes only choose what is compared.

All texts of a slice are searched at once, larger scales for the long ones only: time n log n for n words, and
the lengths of the runs found. Memory per task: a slice, about 100 bytes a word of it.

Defined cases: null and empty texts, and those of white space, have no words and no runs; their collapsed text
is empty; repeated rows are treated alike; an empty table gives an empty table; other columns, whatever their
names, are carried in one column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried

SHORTEST = 12
FIRST_SCALE, SMALL = 4, 10
SLICE_BYTES = 2 << 20
BLOCK = 32


class Found:
    """Stretches (start, end, period) so far: one per start and end, the smallest period."""

    def __init__(self):
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        new = np.stack([start, end, period], 1)[end - start >= 2 * period]
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        self.rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def small_periods(words: np.ndarray, found: Found) -> None:
    """Runs with a period up to SMALL."""
    for p in range(1, min(SMALL, len(words) - 1) + 1):
        same = np.concatenate([[False], words[p:] == words[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        found.add(edge[::2], edge[1::2] + p, np.full(len(edge) // 2, p))


def selected(ids: np.ndarray, t: int, regions: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set at scale t; `ids` are the identities of the windows of t words."""
    n = len(ids)
    ids = ids >> np.uint64(1)
    if len(regions):
        out = np.zeros(n + 1, np.int32)
        np.add.at(out, regions[:, 0], 1)
        np.add.at(out, np.minimum(regions[:, 1] - t + 1, n), -1)
        ids = np.where(np.cumsum(out[:n]) > 0, np.uint64(0xFFFFFFFFFFFFFFFF), ids)
    low, width = ids, 1  # minimum over `width` windows
    while width < t:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if len(low) < 2:
        return np.zeros(0, np.int64)
    low = np.minimum(low[:-1], low[1:])  # t + 1 windows
    m = len(low)
    chosen = (low != np.uint64(0xFFFFFFFFFFFFFFFF)) & ((low == ids[:m]) | (low == ids[t : t + m]))
    return np.flatnonzero(chosen)


def close_pairs(places: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, distance): chains of selected positions with an equal context `distance` further on."""
    at, distance = [], []
    live, k = np.arange(len(places)), 1
    while len(live := live[live + k < len(places)]):
        gap = places[live + k] - places[live]
        near = gap <= 6 * t - 2
        live, gap = live[near], gap[near]
        hit = np.flatnonzero(gap >= 3 * t - 1)
        hit = hit[contexts[live[hit] + k] == contexts[live[hit]]]
        at.append(places[live[hit]]), distance.append(gap[hit])
        k += 1
    at = np.concatenate([*at, places[:0]])
    distance = np.concatenate([*distance, places[:0]])
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    # contexts that overlap or touch lie in one stretch
    new = np.append(True, (distance[1:] != distance[:-1]) | (at[1:] - at[:-1] > 2 * t))[: len(at)]
    heads = np.flatnonzero(new)
    return at[heads], at[np.append(heads[1:], len(at))[: len(heads)] - 1], distance[heads]


def extend(words: np.ndarray, left: np.ndarray, right: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The furthest (start, end) around words left..right - 1, known to equal those `period` on, with that period."""
    left, right, n = left.copy(), right.copy(), len(words)
    for side in (1, -1):
        live, size = np.arange(len(left)), BLOCK
        while len(live):
            step = np.arange(size)
            i = (right[live, None] + step) if side > 0 else (left[live, None] - 1 - step)
            j = i + period[live, None]
            inside = (i >= 0) & (j < n)
            same = inside & (words[np.clip(i, 0, n - 1)] == words[np.clip(j, 0, n - 1)])
            ran = np.where(same.all(1), size, same.argmin(1))
            if side > 0:
                right[live] += ran
            else:
                left[live] -= ran
            live = live[ran == size]
            size = max(BLOCK, min(2 * size, (1 << 20) // max(len(live), 1)))
    return left, right + period


def neighbours(words: np.ndarray, rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) proposed by two highly periodic regions of one period, side by side."""
    rows = rows[(3 * rows[:, 2] <= t) & (rows[:, 1] - rows[:, 0] >= 3 * t - 1)]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    pairs = np.flatnonzero((rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 0] <= rows[:-1, 1]))
    out = []
    for a, b in zip(rows[pairs].tolist(), rows[pairs + 1].tolist()):
        p = a[2]
        period = words[b[0] : b[0] + p]
        view = np.lib.stride_tricks.sliding_window_view(words[a[0] : a[0] + 2 * p - 1], p)
        match = np.flatnonzero((view == period).all(1))
        if not len(match):
            continue
        low, high = 3 * t - 1, min(6 * t - 2, a[1] - a[0], b[1] - b[0])
        first = (b[0] - a[0] - int(match[0])) % p
        q = np.arange(low + (first - low) % p, high + 1, p)
        left = np.maximum(a[0], b[0] - q)
        right = np.minimum(a[1], b[1] - q)
        keep = right > left
        out.append(np.stack([left, right, q], 1)[keep])
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def search(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of two periods or more, by start and period; positions in the joined words.

    `words` holds one number per word, texts one after the other at `offsets`; no run crosses a text's border.
    """
    from tallysieve.llm.arrow import R, mix

    sizes, found, t = np.diff(offsets), Found(), FIRST_SCALE
    while len(which := np.flatnonzero(sizes >= (2 if t == FIRST_SCALE else 2 * (3 * t - 1)))):
        # the texts that are long enough, each followed by a number of its own
        ends = np.cumsum(sizes[which] + 1)
        shift = offsets[which] - (ends - sizes[which] - 1)
        source = np.arange(int(ends[-1])) + np.repeat(shift, sizes[which] + 1)
        w = words[np.minimum(source, len(words) - 1)]
        w[ends - 1] = mix(which.astype(np.uint64) + np.uint64(1 << 40))
        local = Found()
        if t == FIRST_SCALE:
            small_periods(w, local)
        else:
            text = np.searchsorted(offsets, found.rows[:, 0], side="right") - 1
            known = np.isin(text, which)
            back = shift[np.searchsorted(which, text[known])]
            local.rows = found.rows[known] - np.stack([back, back, 0 * back], 1)
        ids, width = w, 1
        while width < t:
            ids, width = mix(ids[:-width] * R + ids[width:]), 2 * width
        regions = local.rows[(3 * local.rows[:, 2] <= t) & (local.rows[:, 1] - local.rows[:, 0] >= t)]
        places = selected(ids, t, regions)
        places = places[places + 2 * t <= len(w)]
        contexts = mix(ids[places] * R + ids[places + t])
        first, last, distance = close_pairs(places, contexts, t)
        left, right, more = neighbours(w, local.rows, t)
        distance = np.concatenate([distance, more])
        start, end = extend(w, np.concatenate([first, left]), np.concatenate([last, right]), distance)
        if t == FIRST_SCALE:
            start, end, distance = (np.concatenate([c, d]) for c, d in zip((start, end, distance), local.rows.T))
        shift = shift[np.searchsorted(ends, start, side="right")]
        found.add(start + shift, end + shift, distance)
        t *= 2
    return found.rows


def periodic_runs(
    docs: DataFrame, text: str = "text", shortest: int = SHORTEST, carry: Sequence[str] | None = None
) -> DataFrame:
    """(__row, n_words, runs, collapsed) for every row; __row holds the columns named in `carry`, or all.

    `runs` lists (start, length, period) in words from 0, by start, then period. `collapsed` is the text
    without the words that a run holds after its first period, the words joined by one space.
    """
    base = docs.select(carried(docs, carry), docs[text].cast("string").alias("t"))
    empty = F.lit(None).cast("array<struct<start:long,length:long,period:long>>").alias("runs")
    schema = base.select(ROW, F.lit(0).cast("long").alias("n_words"), empty, F.lit("").alias("collapsed")).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import bytes_of, hash_words, make_room, slices, words_of

        make_room(__name__)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                data, at = bytes_of(part.column("t"))
                starts, ends, offsets = words_of(data, at)
                rows = search(hash_words(data, starts, ends), offsets)
                size = rows[:, 1] - rows[:, 0]
                rows = rows[size >= np.maximum(shortest, 2 * rows[:, 2])]
                text_of = np.searchsorted(offsets, rows[:, 0], side="right") - 1
                cover = np.zeros(len(starts) + 1, np.int32)
                np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
                np.add.at(cover, rows[:, 1], -1)
                stays = np.cumsum(cover)[:-1] == 0
                body = data.tobytes()
                collapsed = []
                dropping = np.isin(np.arange(part.num_rows), text_of).tolist()
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    mine = body[a:b].split()  # at the six ASCII white-space bytes
                    if dropping[k]:
                        mine = compress(mine, stays[offsets[k] : offsets[k + 1]].tolist())
                    collapsed.append(b" ".join(mine))
                fields = (rows[:, 0] - offsets[text_of], rows[:, 1] - rows[:, 0], rows[:, 2])
                structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(kind))
                cuts = np.searchsorted(text_of, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), structs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=schema.names,
                )

    return base.mapInArrow(run, schema)
