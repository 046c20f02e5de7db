"""Packing of documents into fixed windows by best-fit decreasing.

`cut_documents` turns each text into token ids and cuts overlong ones into full windows and a
rest. `pack` deals the pieces by hash to one shard per shuffle partition, sorts each shard by
length, longest first, and places one piece after the other in the open window that it
fills best. A segment tree over remaining capacities finds that window: its leaves are the
capacities 0..window, a node tells whether an open window lies below it. A task holds the
tree and the open windows' numbers, not the pieces: they stream by. A shard leaves at most a
few windows half empty, so padding stays as low as for one global run while shards are much larger
than a window.

Ids are those of the public byte-level vocabulary, by its rank file; the special string
counts as one id, as in the vocabulary's own library. Texts with very long runs of white space or
of one kind of character go to that library, whose pattern matcher has no backtracking limit.

Defined cases: null text counts as empty; an empty text is one piece with the end id alone;
repeated rows give repeated pieces; a shard without pieces gives nothing; other columns of
the input, whatever their names, are carried in one column.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.arrow import keeps
from tallysieve.llm.common import ROW, carried, parts

WINDOW, END_ID = 1024, 0
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_LONG_RUN = re.compile(r"\s{10000}|\S{100000}")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding(
            "ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
        )
        self.library = Tokenizer.from_file(json_path)

    def one(self, text: str) -> bytes:
        if len(text) >= 10_000 and _LONG_RUN.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_to_numpy(text, allowed_special="all")
        return np.asarray(ids, "<u4").tobytes()


_encoders: dict[tuple, Encoder] = {}
keeps(__name__, _encoders.clear)


def encoder(*args: str) -> Encoder:
    if args not in _encoders:
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def cut_documents(
    docs: DataFrame,
    tokenizer: tuple[str, str, str],
    text: str = "text",
    window: int = WINDOW,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(__row, start, length, doc_tokens, token_bytes): the pieces of every document, full windows and a rest.

    `token_bytes` holds the ids as little-endian unsigned 32-bit integers. `tokenizer` is
    (JSON file, rank file of the same vocabulary, its pattern).
    """
    base = docs.select(carried(docs, carry), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    long = F.lit(0).cast("long")
    schema = base.select(
        ROW, long.alias("start"), long.alias("length"), long.alias("doc_tokens"), F.lit(b"").alias("token_bytes")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        step, end = 4 * window, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows, start, length, total, pieces = [], [], [], [], []
                for i, ids in enumerate(map(encoder(*tokenizer).one, part.column("t").to_pylist())):
                    ids += end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        rows.append(i)
                        start.append(at // 4)
                        length.append(len(piece) // 4)
                        total.append(len(ids) // 4)
                        pieces.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(ROW).take(pa.array(rows, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, length, total)],
                        pa.array(pieces, pa.binary()),
                    ],
                    names=schema.names,
                )

    return base.mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)  # 1 where an open window lies below
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int, value: int) -> None:
        node = self.size + capacity
        self.tree[node] = value
        while node > 1:
            node >>= 1
            value = self.tree[2 * node] | self.tree[2 * node + 1]
            if self.tree[node] == value:
                break
            self.tree[node] = value

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` that an open window has; -1 if none."""
        node = self.size + need
        if self.tree[node]:
            return need
        while node > 1:  # up to the first right neighbour with something below, then down to its left end
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def put(self, capacity: int, sequence: int) -> None:
        if capacity:
            self.open[capacity].append(sequence)
            if len(self.open[capacity]) == 1:
                self._mark(capacity, 1)

    def take(self, capacity: int) -> int:
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity, 0)
        return sequence


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with (sequence_id, offset). `pieces` has __row, start, length and anything else.

    Sequence ids hold the shard above bit 40 and a count within the shard below it.
    """
    key = F.xxhash64(F.to_json(ROW), F.col("start"))
    dealt = pieces.repartition(parts(pieces.sparkSession), key).sortWithinPartitions(F.desc("length"), key)
    long = F.lit(0).cast("long")
    schema = pieces.select("*", long.alias("sequence_id"), long.alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows, sequence = OpenWindows(window), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, offsets = [], []
            for length in batch.column("length").to_pylist():
                capacity = windows.tightest(length)
                if capacity < 0:
                    mine, capacity = sequence, window
                    sequence += 1
                else:
                    mine = windows.take(capacity)
                ids.append(mine)
                offsets.append(window - capacity)
                windows.put(capacity - length, mine)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names
            )

    return dealt.mapInArrow(run, schema)
