"""Token counts of whole texts, equal to the library's on the whole text.

Overlap resynchronisation. A huge text is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a common boundary that is proven stable: a space after a
non-space, where no piece of the vocabulary can reach across (checked on the vocabulary), and
where both encodings do have a token edge. If an overlap has no such place, it is
widened, in the end to the whole rest of the text.

Texts up to HUGE characters are encoded whole. Memory per task: one slice of a batch and one chunk.

Defined cases: null and empty texts have 0 tokens and 0 bytes; repeated rows give
repeated rows; an empty table gives an empty table; other columns of the input, whatever
their names, are carried in one column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.arrow import keeps
from tallysieve.llm.common import ROW, carried

SPACE = "▁"  # how the library writes a space; the character itself means one, too
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256


class Counter:
    """Counts of one sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        # proof of stability: no piece holds a space after something else
        self.stable = all(SPACE not in p.lstrip(SPACE) for p in pieces)

    def edges(self, data: bytes) -> np.ndarray:
        """Byte offsets at which tokens start."""
        pieces = self.model.encode(data.decode(), return_type="proto").pieces
        return np.fromiter((p.begin for p in pieces), np.int64, len(pieces))

    def many(self, texts: Sequence[str]) -> list[int]:
        texts = [t.replace(SPACE, " ") for t in texts]
        whole = self.model.encode([t if len(t) <= HUGE else "" for t in texts], num_threads=1)
        return [len(w) if len(t) <= HUGE else self.huge(t) for t, w in zip(texts, whole)]

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text by overlapping chunks (sizes in bytes), spliced at stable common boundaries."""
        data = text.encode()
        if not self.stable or len(data) <= chunk:
            return len(self.model.encode(text)) if text else 0
        total, start = 0, 0  # a chunk starts with the text, or after the space of a stable boundary
        while True:
            width = overlap
            while True:
                stop = _whole(data, start + chunk + width)
                left = self.edges(data[start:stop]) + start
                if stop == len(data):
                    return total + len(left)
                cut = self._splice(data, left, _whole(data, start + chunk), stop)
                if cut is not None:
                    break
                width *= 2  # no common stable boundary: widen the overlap
            total += int(np.searchsorted(left, cut))
            start = cut + 1

    def _splice(self, data: bytes, left: np.ndarray, low: int, stop: int) -> int | None:
        """A stable boundary in [low, stop) where the left chunk and one that starts at `low` both have a token edge."""
        at, right = data.find(b" ", low, stop - 1), None
        while at >= 0:
            if at > low and data[at - 1] != 32 and data[at + 1] != 32:
                if right is None:
                    right = self.edges(data[low:stop]) + low
                if all(edges[min(np.searchsorted(edges, at), len(edges) - 1)] == at for edges in (left, right)):
                    return at
            at = data.find(b" ", at + 1, stop - 1)
        return None


def _whole(data: bytes, at: int) -> int:
    """The next place, `at` or later, where no character is cut."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


_counters: dict[str, Counter] = {}
keeps(__name__, _counters.clear)


def counter(path: str) -> Counter:
    """The task's counter; one per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(__row, n_bytes, n_tokens) for every row; __row holds the columns named in `carry`, or all."""
    base = docs.select(carried(docs, carry), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    schema = base.select(ROW, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import bytes_of, make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch):
                sizes = np.diff(bytes_of(part.column("t"))[1])
                counts = counter(path).many(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                    names=[ROW, "n_bytes", "n_tokens"],
                )

    return base.mapInArrow(run, schema)
