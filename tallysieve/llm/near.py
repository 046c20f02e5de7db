"""MinHash near-duplicates of texts, candidates verified by odd sketches, links confirmed on full sets.

A document's set holds its distinct shingles of `words` words (A-Z in lower case), or its whole
word sequence if it has fewer. Documents are linked if 100 * intersection >= similarity * union.

1. One pass over the texts gives each document the size and a 128-bit digest of its set and BANDS
   band keys of ROWS MinHash samples each. Documents with the same set form a class; only its
   smallest number goes on.
2. Classes that share a band key form a bucket; buckets with the same members count once. A pair at
   the threshold shares none of 28 bands with probability 1.5e-5, closer pairs less.
3. Members meet in tiles of bounded size. They carry their set and an odd sketch: 512 MinHash samples, folded
   into a bitmap of 2,048 parities. In a tile, the population count of the XOR of two bitmaps
   estimates the similarity (deviation about 0.02 at 0.8); pairs estimated below the threshold by more than
   MARGIN are left out, others confirmed on full sets, best first, unless they are connected
   already. A tile gives one row per member at most.
   First round: a bucket of up to BLOCK members is one tile; larger ones are dealt into blocks, and a member goes
   to MIXES of these, of different buckets where it has several: so a large group of near copies is connected by
   rows that grow with it.
   Second round: only buckets that still hold several components. Their blocks hold one component each
   (small components share blocks), and any two blocks of different components make a tile. A group that is one
   component meets the others of its bucket, not itself.
4. Components of these links; classes hand their component to all members.

No pair list is built, nothing is capped, and no group meets in one task: exact copies are combined
before the shuffle, near copies meet in tiles.

Defined cases: null and empty texts, and those of white space, have an empty set and are linked
with nothing; a null key is linked with nothing; rows with the same key are one node, which has the links of all
its texts, and give one row each; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried, stash
from tallysieve.llm.graph import components
from tallysieve.llm.tiles import Forest, by_tile, groups, mixed_lists, unsettled_lists

WORDS, SIMILARITY = 5, 80
BANDS, ROWS = 28, 5
SAMPLES, BITS, MARGIN = 512, 2048, 0.1
BLOCK, MIXES = 128, 4
CHUNK = 4096
SEED = 20_240_613

_rng = np.random.default_rng(SEED)
_FACTOR = (_rng.integers(0, 1 << 31, SAMPLES, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)


def min_hashes(shingles: np.ndarray, samples: int) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set of 64-bit shingles."""
    low = np.full(samples, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), CHUNK):
        values = (short[None, a : a + CHUNK] ^ _SHIFT[:samples, None]) * _FACTOR[:samples, None]
        np.minimum(low, values.min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    from tallysieve.llm.arrow import R, mix

    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        h = mix((h + column.astype(np.uint64)) * R)
    return h.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of SAMPLES (function, value) elements in BITS places, as packed bytes."""
    from tallysieve.llm.arrow import R, mix

    place = mix((np.arange(len(low), dtype=np.uint64) << np.uint64(32) | low.astype(np.uint64)) * R) % np.uint64(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS) & 1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing parities of two odd sketches."""
    share = np.clip(1 - 2 * differing / BITS, 1e-9, 1)
    return 1 - np.log(share) / np.log(1 - 2 / BITS) / (2 * SAMPLES)


def to_bytes(shingles: np.ndarray) -> bytes:
    """The low 48 bits of each hash: two different shingles of a pair of documents agree in them with chance 4e-15."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :6] = packed
    return out.view("<u8").ravel()


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    from tallysieve.llm.arrow import bytes_of, hash_words, window_hashes, words_of

    data, offsets = bytes_of(texts)
    starts, ends, first = words_of(data, offsets)
    hashes = hash_words(data, starts, ends, lower=True)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        out.append(np.unique(window_hashes(hashes[a:b], min(words, b - a))) if b > a else hashes[:0])
    return out


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n_shingles, x, y, bands) per row; x, y and bands are null for an empty set."""
    base = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    schema = "id long, n_shingles long, x long, y long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, mix, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch):
                x, y, bands = [], [], []
                sets = shingle_sets(part.column("t"), words)
                for s in sets:
                    if len(s):
                        x.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                        y.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                        bands.append(band_keys(min_hashes(s, BANDS * ROWS)))
                    else:
                        x.append(None), y.append(None), bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(x, pa.int64()),
                        pa.array(y, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "x", "y", "bands"],
                )

    return base.mapInArrow(run, schema)


def with_sets(docs: DataFrame, lists: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, i, j, id, part, sketch, members): a row for each tile of each listed document; `part` is what it belongs to so far."""
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    # the lists grow with the corpus: never broadcast, at any size
    base = texts.join(lists.hint("merge"), "id").select("id", "t", "part", "tiles.key", "tiles.i", "tiles.j")
    schema = "key long, i long, j long, id long, part long, sketch binary, members binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for piece in slices(batch):
                seen = set()
                ids, parts_ = piece.column("id").to_pylist(), piece.column("part").to_pylist()
                for at, s in enumerate(shingle_sets(piece.column("t"), words)):
                    packed = to_bytes(s)
                    if not len(s) or (ids[at], packed) in seen:
                        continue  # repeated rows
                    seen.add((ids[at], packed))
                    sketch = odd_sketch(min_hashes(s, SAMPLES)).tobytes()
                    tiles = [piece.column(c)[at].values for c in ("key", "i", "j")]
                    step = max(1, (8 << 20) // len(packed))  # a large set goes out in several batches
                    for a in range(0, len(tiles[0]), step):
                        some = [t.slice(a, step) for t in tiles]
                        n = len(some[0])
                        yield pa.RecordBatch.from_arrays(
                            [
                                *some,
                                pa.array([ids[at]] * n, pa.int64()),
                                pa.array([parts_[at]] * n, pa.int64()),
                                pa.array([sketch] * n, pa.binary()),
                                pa.array([packed] * n, pa.binary()),
                            ],
                            names=["key", "i", "j", "id", "part", "sketch", "members"],
                        )

    return base.mapInArrow(run, schema)


def confirm(rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links of each tile as stars, a below its component's smallest member b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, below = [], []
        for tile in groups(batches):
            for a, b in tile_links(tile, similarity):
                above.append(a)
                below.append(b)
            if len(above) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(above, pa.int64()), pa.array(below, pa.int64())], names=["a", "b"])
                above, below = [], []
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(above, pa.int64()), pa.array(below, pa.int64())], names=["a", "b"])

    return by_tile(rows).mapInArrow(run, "a long, b long")


def tile_links(tile: pa.Table, similarity: int) -> list[tuple[int, int]]:
    ids, parts_ = tile.column("id").to_numpy(), tile.column("part").to_numpy()
    members, sketches = tile.column("members"), tile.column("sketch")
    rows, seen = [], set()
    for r in np.argsort(ids, kind="stable").tolist():  # a repeated row once, a key's different texts each
        mark = (ids[r], members[r].as_buffer().to_pybytes())
        if mark not in seen:
            seen.add(mark)
            rows.append(r)
    n = len(rows)
    if n < 2:
        return []
    seen.clear()
    ids, parts_ = ids[rows].tolist(), parts_[rows].tolist()
    sets = [from_bytes(members[r].as_buffer()) for r in rows]
    packed = np.stack([np.frombuffer(sketches[r].as_buffer(), np.uint8) for r in rows])
    signs = 1 - 2 * np.unpackbits(packed, axis=1).astype(np.float32)
    guess = estimate((BITS - signs @ signs.T) / 2)
    sizes = np.array([len(s) for s in sets], np.float64)
    fits = 100 * np.minimum.outer(sizes, sizes) >= similarity * np.maximum.outer(sizes, sizes)
    a, b = np.nonzero(np.triu(fits & (guess >= similarity / 100 - MARGIN), 1))
    best = np.argsort(-guess[a, b], kind="stable")
    forest, first = Forest(n), {}
    for i in range(n):  # connected from the start: one key, one part
        forest.join(i, first.setdefault(("key", ids[i]), i))
        forest.join(i, first.setdefault(("part", parts_[i]), i))
    for i, j in zip(a[best].tolist(), b[best].tolist()):
        if forest.root(i) != forest.root(j):
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= similarity * (len(both) - shared):
                forest.join(i, j)
    tops = [parts_[forest.root(i)] for i in range(n)]
    return list({(part, top) for part, top in zip(parts_, tops) if part != top})


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row. `similarity` in percent, from 50 upward."""
    signed = stash(signatures(docs, key, text, words), "signatures")
    # for a set of one shingle the digests hold the shingle itself: the size belongs to the class
    classes = (
        signed.where("x is not null and id is not null")
        .groupBy("x", "y", "n_shingles")
        .agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"))
    )
    classes = stash(classes, "classes")
    members = classes.select(F.explode("bands").alias("key"), "id").distinct()
    members, sizes, lists = mixed_lists(members, BLOCK, MIXES)
    links = stash(confirm(with_sets(docs, stash(lists, "tile-lists"), key, text, words), similarity), "links")
    linked = components(links)
    lists = stash(unsettled_lists(members, sizes, linked, BLOCK), "open-lists")
    if not lists.limit(1).isEmpty():
        # few documents: they are picked before their texts move
        some = docs.join(lists.select(F.col("id").alias("__open")).distinct(), docs[key].cast("long") == F.col("__open"), "left_semi")
        more = stash(confirm(with_sets(some, lists, key, text, words), similarity), "more-links")
        if not more.limit(1).isEmpty():  # the components so far are stars
            stars = linked.where("node > component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            linked = components(stars.unionByName(more))
    placed = classes.select("x", "y", "n_shingles", F.col("id").alias("node")).join(linked, "node", "left")
    placed = placed.select("x", "y", F.col("n_shingles").alias("n"), F.coalesce("component", "node").alias("component"))
    same = (F.col("s.x") == F.col("p.x")) & (F.col("s.y") == F.col("p.y")) & (F.col("s.n_shingles") == F.col("p.n"))
    out = signed.alias("s").join(placed.alias("p"), same, "left").select(
        "s.id", "s.n_shingles", F.when(F.col("s.id").isNotNull(), F.coalesce("p.component", "s.id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that another one of their group stands for."""
    found = near_duplicates(docs, key, text, words, similarity)
    dropped = found.where("not kept").select(F.col("id").alias("__dropped")).distinct()
    rows = docs.select(carried(docs), docs[key].cast("long").alias("__id"))
    return rows.join(dropped, F.col("__id") == F.col("__dropped"), "left_anti").select(f"{ROW}.*")
