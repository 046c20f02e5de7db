"""Byte-level BPE by the ranks of a public file: encoding and decoding.

A text is cut into pre-tokens by the public pattern (contractions, runs of letters, digits, other
signs with one space in front, white space). The cuts are found for all texts of a slice at once from
the class of each character. Each distinct pre-token of a slice is merged once.

Merging keeps the parts of all pre-tokens as one linked list of byte positions, with a stop between two
pre-tokens. Every rank has a bucket of positions whose part and the next one make up the token of that rank, and
a bitmap of three levels (64 children a node) marks the ranks with a bucket. Find-first-set from the top gives the
lowest rank; entries of its bucket whose pair has changed since are skipped, the others are merged
together, of overlapping ones every second from the left, and their new pairs go to the buckets.
Where a token of a lower rank begins or ends with the merged one, its merge may open that rank: of such a rank only
the first entry of each pre-token is merged at a time and the rest goes back to the bucket. So each pre-token sees
its merges in the order of rank, then place. Steps are as many as ranks in use, and each costs what it
merges: a pre-token of millions of bytes takes time in proportion to its length.

Memory per task: one slice of a batch, and about 25 bytes for each byte of its distinct pre-tokens.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows are encoded alike;
an empty table gives an empty table; other columns, whatever their names, are carried in one column.
Strings of special tokens are ordinary text. Ids that the file doesn't hold make decoding fail.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.arrow import keeps
from tallysieve.llm.common import ROW, carried

SLICE_BYTES = 8 << 20
OTHER, LETTER, DIGIT, SPACE = range(4)
# Fixed value: the pattern whose cuts pre_tokens() makes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = np.delete(np.arange(0x110000, dtype=np.uint32), slice(0xD800, 0xE000))
    everything = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[points[m.start() : m.end()]] = kind
    return out


def pre_tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pre-tokens of the joined texts, with the end; and n + 1 pre-token offsets of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    edges = np.cumsum([0, *map(len, texts)])
    n = len(codes)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)  # of a text; the end counts as one
    first[edges] = True
    start = np.append(kind[1:] != kind[:-1], True)  # start[i]: a run begins at i + 1
    start = np.concatenate([[True], start]) | first
    # the last of several spaces before something else stands alone, and a blank joins what follows
    last = np.flatnonzero((kind == SPACE) & start[1:] & ~first[1:])
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    mark = np.flatnonzero((codes == 39) & start[:-1] & ~first[1:])
    mark = mark[kind[mark + 1] == LETTER]
    ends = edges[np.searchsorted(edges, mark, side="right")]
    for suffix in SUFFIXES:
        size = len(suffix)
        at = mark[mark + size < ends]
        for k, letter in enumerate(suffix, 1):
            at = at[codes[at + k] == ord(letter)]
        start[at + 1] = False
        start[at + 1 + size] = True
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    starts = np.flatnonzero(start[:n])
    return np.append(place[starts], place[n]), np.searchsorted(starts, edges)


class RankQueue:
    """Buckets of positions by rank; three bitmap levels find the lowest rank that has one."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves = [0] * (size // 64 + 1)
        self.nodes = [0] * (size // 4096 + 1)
        self.top = 0

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = ranks.argsort(kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist() if len(ranks) else (), cuts, cuts[1:]):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(places[a:b])
                continue
            self.buckets[rank] = [places[a:b]]
            leaf, node = rank >> 6, rank >> 12
            self.leaves[leaf] |= 1 << (rank & 63)
            self.nodes[node] |= 1 << (leaf & 63)
            self.top |= 1 << node

    def lowest(self) -> int:
        """The lowest rank with a bucket, -1 for none."""
        if not self.top:
            return -1
        node = (self.top & -self.top).bit_length() - 1
        bits = self.nodes[node]
        leaf = node << 6 | (bits & -bits).bit_length() - 1
        bits = self.leaves[leaf]
        return leaf << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        leaf, node = rank >> 6, rank >> 12
        self.leaves[leaf] &= ~(1 << (rank & 63))
        if not self.leaves[leaf]:
            self.nodes[node] &= ~(1 << (leaf & 63))
            if not self.nodes[node]:
                self.top &= ~(1 << node)
        bucket = self.buckets.pop(rank)
        return bucket[0] if len(bucket) == 1 else np.sort(np.concatenate(bucket))


class Ranks:
    """The tokens of a rank file."""

    def __init__(self, body: bytes):
        pairs = (line.split() for line in body.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.rank.values()) + 1
        tokens = [b""] * self.size
        made: dict[int, int] = {}
        self.early = set()  # ranks whose merge may open a lower one
        for token, rank in self.rank.items():
            tokens[rank] = token
            for c in range(1, len(token)):
                a, b = self.rank.get(token[:c]), self.rank.get(token[c:])
                if a is not None and b is not None:
                    made[a * (self.size + 1) + b] = rank
                    self.early |= {x for x in (a, b) if x > rank}
        self.pairs = np.array(sorted(made), np.int64)
        self.merged = np.array([made[p] for p in self.pairs.tolist()], np.int32)
        self.of_byte = np.array([self.rank.get(bytes([b]), self.size) for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in tokens])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.body = np.frombuffer(b"".join(tokens), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two parts make up, -1 for none."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], np.int32(-1))

    def merge(self, tokens: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are no token themselves, one after the other, and the number of ids of each."""
        data = np.frombuffer(b"\0" + b"\0".join(tokens) + b"\0", np.uint8)
        stops = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])]).astype(np.int64)
        n = len(data)
        part = self.of_byte[data]
        part[stops] = self.size  # a stop pairs with nothing
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.append(self.rank_of(part[:-1], part[1:]), np.int32(-1))
        alive, mark, queue = np.ones(n, bool), np.zeros(n, bool), RankQueue(self.size)
        alive[stops] = False
        first = np.flatnonzero(pair >= 0).astype(np.int32)
        queue.push(pair[first], first)
        while (r := queue.lowest()) >= 0:
            i = queue.take(r)
            i = i[pair[i] == r]  # others are stale
            if len(i) > 1:
                i = i[np.append(True, i[1:] != i[:-1])]
                if r in self.early:
                    owner = np.searchsorted(stops, i)
                    go = np.append(True, owner[1:] != owner[:-1])
                    queue.push(np.full(int((~go).sum()), r, np.int32), i[~go])
                    i = i[go]
                else:
                    over = after[i[:-1]] == i[1:]
                    if over.any():  # overlapping entries: every second one of a chain
                        at = np.arange(len(i))
                        head = np.maximum.accumulate(np.where(np.append(True, ~over), at, 0))
                        i = i[(at - head) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            end = after[j]
            after[i], before[end], part[i], pair[j], alive[j] = end, i, r, -1, False
            left = before[i]
            mark[i] = True
            left = left[~mark[left]]
            mark[i] = False
            u = np.concatenate([i, left])
            new = self.rank_of(part[u], part[after[u]])
            pair[u] = new
            good = new >= 0
            queue.push(new[good], u[good])
        places = np.flatnonzero(alive)
        if (part[places] == self.size).any():
            raise ValueError("a byte is not in the vocabulary")
        return part[places].astype(np.uint32), np.diff(np.searchsorted(places, stops))

    def ids(self, tokens: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and the number of ids of each: the token itself, or its merges."""
        whole = np.fromiter((self.rank.get(t, -1) for t in tokens), np.int64, len(tokens))
        sizes = np.ones(len(tokens), np.int64)
        merged, sizes[whole < 0] = self.merge([t for t, w in zip(tokens, whole.tolist()) if w < 0])
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        flat[ragged(starts[whole < 0], sizes[whole < 0])] = merged
        return flat, sizes

    def many(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets of the texts."""
        places, edges = pre_tokens(texts)
        body = pa.py_buffer("".join(texts).encode())
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(np.ascontiguousarray(places, np.int64)), body]
        ).dictionary_encode()
        flat, sizes = self.ids(column.dictionary.to_pylist())
        starts, which = np.cumsum(sizes) - sizes, column.indices.to_numpy(zero_copy_only=False)
        return flat[ragged(starts[which], sizes[which])], np.concatenate([[0], np.cumsum(sizes[which])])[edges]

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if len(ids) and (int(ids.max()) >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.body[ragged(self.offsets[ids], self.lengths[ids])].tobytes()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each given stretch, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


@cache
def ranks(path: str) -> Ranks:
    """The task's ranks; one per worker process."""
    with open(path, "rb") as file:
        return Ranks(file.read())


keeps(__name__, lambda: (classes.cache_clear(), ranks.cache_clear()))


def encode(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(__row, token_bytes) for every row: ids as little-endian unsigned 32-bit integers; __row holds the columns in `carry`, or all."""
    base = docs.select(carried(docs, carry), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    schema = base.select(ROW, F.lit(b"").alias("token_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                ids, edges = ranks(path).many(part.column("t").to_pylist())
                data = ids.astype("<u4").tobytes()
                out = [data[4 * a : 4 * b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(out, pa.binary())], names=[ROW, "token_bytes"])

    return base.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "token_bytes", carry: Sequence[str] | None = None) -> DataFrame:
    """(__row, data) for every row: the bytes of its ids; null ids are taken for none."""
    base = rows.select(carried(rows, carry), F.coalesce(rows[ids], F.lit(b"")).alias("t"))
    schema = base.select(ROW, F.lit(b"").alias("data")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                out = [ranks(path).text(np.frombuffer(t.as_buffer(), "<u4")) for t in part.column("t")]
                yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(out, pa.binary())], names=[ROW, "data"])

    return base.mapInArrow(run, schema)
