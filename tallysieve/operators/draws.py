"""Bootstrap samples whose draws follow hashes of (replicate, class, draw), packed.

Each draw is one hash, so that SQL can repeat it: hashes are rows times replicates in number. No draw is a row, though.
Blocks of DRAWS hashes are dealt by the range of RANGE slots that they hit, two bytes each. A range, held once for CHUNK
replicates, turns slots into places in the order of distinct scores. Places are dealt again, by replicate and in
ranges of RANGE places with the highest first: one pass keeps the counts of one range and two running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.operators.metric import numbers, streamed
from tallysieve.session import fan_out

RANGE = 1 << 16  # offsets take two bytes
DRAWS = 1 << 15
CHUNK = 100


def _ranges(values: np.ndarray, size: int) -> Iterator[tuple[int, slice]]:
    """Ranges of `size` that ascending values fall in, and where."""
    if len(values):
        which = values // size
        starts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(values)]
        yield from ((int(which[a]), slice(a, b)) for a, b in zip(starts, starts[1:]))


def _bytes(column: pa.Array, k: int, dtype: str) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), dtype)


def drawn_slots(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(class, part, chunk, replicate, at): slots of each range that each block of draws hits. `sizes`: class, n."""
    blocks = sizes.where("class is not null").select(
        "class", "n", F.col("class").cast("string").alias("text"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {DRAWS}"))).alias("block"),
    )
    asked = blocks.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    asked = fan_out(asked, "class", "block", "replicate").sortWithinPartitions("class", "block")
    digest = methodcaller("digest")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "text", "block", "replicate")))
            for k, (n, text, block, replicate) in enumerate(rows):
                span = (block * DRAWS, min(n, (block + 1) * DRAWS))
                if span != known:
                    known, names = span, [b"%d" % i for i in range(*span)]
                prefix = f"{seed}|{replicate}|{text}|".encode()
                digests = b"".join(map(digest, map(hashlib.sha256, map(prefix.__add__, names))))
                slots = np.sort((np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> 4) % np.uint64(n)).astype(np.int64)
                hit = list(_ranges(slots, RANGE))
                same = lambda v: pa.array(np.full(len(hit), v, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column("class")[k], len(hit)), pa.array([p for p, _ in hit], pa.int64()),
                        same(replicate // CHUNK), same(replicate),
                        pa.array([(slots[s] % RANGE).astype(np.uint16).tobytes() for _, s in hit], pa.binary()),
                    ],
                    names=["class", "part", "chunk", "replicate", "at"],
                )

    kind = sizes.schema["class"].dataType.simpleString()
    return asked.mapInArrow(draw, f"class {kind}, part bigint, chunk int, replicate int, at binary")


def drawn_places(slots: DataFrame, drawn: DataFrame, replicates: int) -> DataFrame:
    """(class, replicate, range, at, n): how often each place is drawn. `slots`: class, slot, place; others hit nothing."""
    packed = slots.groupBy("class", F.expr(f"slot div {RANGE}").alias("part")).agg(
        F.collect_list(F.struct((F.col("slot") % RANGE).cast("int").alias("slot"), "place")).alias("_rows")
    )
    held = packed.select(
        "class", "part", F.explode(F.sequence(F.lit(0), F.lit(replicates // CHUNK))).alias("chunk"),
        F.col("_rows.slot").alias("slots"), F.col("_rows.place").alias("places"),
    )

    def start(held: pa.Table | None):
        if held is None:
            return lambda batch: iter(())
        place = np.full(RANGE, -1, np.int64)
        slots, places = (held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("slots", "places"))
        place[slots] = places
        distinct, index = np.unique(place, return_inverse=True)
        missing = int(np.searchsorted(distinct, 0))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asking, at = numbers(batch, "replicate"), batch.column("at")
            for replicate in np.unique(asking).tolist():
                hit = np.concatenate([_bytes(at, k, "<u2") for k in np.flatnonzero(asking == replicate).tolist()])
                count = np.bincount(index[hit], minlength=len(distinct))
                count[:missing] = 0
                some = np.flatnonzero(count)
                found, count = distinct[some], count[some]
                ranges = list(_ranges(found, RANGE))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column("class")[0], len(ranges)), pa.array(np.full(len(ranges), replicate, np.int32)),
                        pa.array([r for r, _ in ranges], pa.int64()),
                        pa.array([(found[s] % RANGE).astype(np.uint16).tobytes() for _, s in ranges], pa.binary()),
                        pa.array([count[s].astype(np.uint32).tobytes() for _, s in ranges], pa.binary()),
                    ],
                    names=["class", "replicate", "range", "at", "n"],
                )

        return step

    kind = slots.schema["class"].dataType.simpleString()
    return streamed(held, drawn, ["class", "part", "chunk"], f"class {kind}, replicate int, range bigint, at binary, n binary", start)


def sample_areas(places: DataFrame) -> DataFrame:
    """(replicate, auroc, average_precision) from counts by place (positive boolean, replicate, range, at, n)."""
    dealt = fan_out(places, "replicate").sortWithinPartitions("replicate", F.desc("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, sums = None, np.zeros((2, RANGE), np.int64), [0, 0, 0.0, 0.0]

        def close() -> None:
            """Adds one range to (positives, negatives, positives over negatives below less all of these, precision)."""
            n, p = counts[:, ::-1]
            tp, fp = sums[0] + np.cumsum(p), sums[1] + np.cumsum(n)
            some = np.flatnonzero(p)
            sums[2] += float((p[some] * (n[some] / 2 - fp[some])).sum())
            sums[3] += float((p[some] * tp[some] / (tp[some] + fp[some])).sum())
            sums[0], sums[1] = int(tp[-1]), int(fp[-1])
            counts[:] = 0

        def result() -> pa.RecordBatch:
            P, N, less, precise = sums
            both = P and N
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now[0]], pa.int32()),
                    pa.array([(float(P) * N + less) / (float(P) * N) if both else None], pa.float64()),
                    pa.array([precise / P if both else None], pa.float64()),
                ],
                names=["replicate", "auroc", "average_precision"],
            )

        for batch in batches:
            positive = numbers(batch, "positive").tolist()
            for k, key in enumerate(zip(numbers(batch, "replicate").tolist(), numbers(batch, "range").tolist())):
                if key != now:
                    if now:
                        close()
                        if key[0] != now[0]:
                            yield result()
                            sums = [0, 0, 0.0, 0.0]
                    now = key
                counts[int(positive[k]), _bytes(batch.column("at"), k, "<u2")] += _bytes(batch.column("n"), k, "<u4")
        if now:
            close()
            yield result()

    return dealt.mapInArrow(run, "replicate int, auroc double, average_precision double")
