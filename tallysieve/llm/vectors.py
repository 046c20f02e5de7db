"""Near-duplicate vectors by lattice hashing.

A vector is normalised and turned by fixed random rotations; its coordinates, in runs of
eight, are scaled and decoded to the nearest points of the lattice E8. A table takes
POINTS runs; the lattice points are the vector's home cell there. There are TABLES tables, from as many
rotations as that takes; the scale follows from the width and the threshold, so that a pair at the threshold lies
SPREAD apart in a table, whatever they are. PROBES neighbouring cells
are looked up as well: those that differ in one lattice point by one of its 240 shortest vectors
and lie closest. Two vectors meet if one's home is the other's home or probe in some table;
pairs that meet are linked if their cosine in double precision reaches the threshold.
A pair exactly at the threshold meets in one table with probability 0.5 or more (random pairs of 2 to 128 dimensions,
thresholds 0.5 to 0.98), so all tables miss less than 1 in 1,000 of such pairs; nearer pairs are missed less.

Equal vectors form a class with one representative. Cells are cut into tiles of bounded size;
a row carries all its cells, so that a pair which meets in several places is counted in the first
of them only. A tile gives one row per vector: how many it is linked with, and the smallest
vector of its component there. No pair list is built.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are
linked with nothing, vectors of different length not with each other; a null key is
linked with nothing; rows with the same key and vector count once per row; of different vectors with the
same key one, by digest, takes part, others follow it only if they equal a vector that does; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import stash
from tallysieve.llm.graph import components
from tallysieve.llm.tiles import Forest, by_tile, groups, tile_lists

SPREAD, POINTS, PROBES, TABLES = 0.632, 2, 3, 12
BLOCK = 128
SEED = 77


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) / 2 for v in product((1, -1), repeat=8) if np.prod(v) > 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(x[odd] - near[odd]).argmax(1)
    off = x[odd, worst] - near[odd, worst]
    near[odd, worst] += np.where(off >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even-sum integer points and the same moved by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


@cache
def rotation(dims: int, turn: int) -> np.ndarray:
    """A fixed random rotation, as many columns of it as are used; dimensions are filled up with zeros to whole tables."""
    full = filled(dims)
    wide = min(full, TABLES * 8 * POINTS)
    return np.linalg.qr(np.random.default_rng((SEED, turn)).standard_normal((full, wide)))[0][:dims]


def filled(dims: int) -> int:
    return -(-dims // (8 * POINTS)) * 8 * POINTS


def scale(dims: int, cosine: float) -> float:
    """What makes a pair at the threshold SPREAD apart in a table, on average."""
    return SPREAD / np.sqrt(2 * max(1 - cosine, 1e-6) * 8 * POINTS / filled(dims))


def cells(unit: np.ndarray, cosine: float) -> np.ndarray:
    """[n, tables, 1 + PROBES] cell keys of unit vectors: home, then the closest neighbouring cells."""
    from tallysieve.llm.arrow import R, mix

    n, tables, dims = len(unit), TABLES, unit.shape[1]
    turns = -(-tables // (filled(dims) // (8 * POINTS)))
    turned = np.concatenate([unit @ rotation(dims, r) for r in range(turns)], 1) * scale(dims, cosine)
    out = np.empty((n, tables, 1 + PROBES), np.int64)
    pick = np.arange(n)[:, None]

    def key(points: list[np.ndarray], table: int) -> np.ndarray:
        h = np.full(n, table + 1, np.uint64) + np.uint64(unit.shape[1] << 8)
        for p in points:
            for c in np.rint(2 * p).astype(np.int64).view(np.uint64).T:
                h = mix((h + c) * R)
        return h.view(np.int64)

    for t in range(tables):
        runs = [turned[:, 8 * (t * POINTS + k) : 8 * (t * POINTS + k + 1)] for k in range(POINTS)]
        home = [nearest_point(r) for r in runs]
        out[:, t, 0] = key(home, t)
        # squared distance grows by |root|^2 - 2 <rest, root> when a point moves by a root
        gain = np.concatenate([(r - p) @ roots().T for r, p in zip(runs, home)], 1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        best = best[pick, np.argsort(-gain[pick, best], axis=1, kind="stable")]
        for q in range(PROBES):
            run, root = np.divmod(best[:, q], len(roots()))
            moved = [p + roots()[root] * (run == k)[:, None] for k, p in enumerate(home)]
            out[:, t, 1 + q] = key(moved, t)
    return out


def with_cells(vectors: DataFrame, key: str, vector: str, cosine: float) -> DataFrame:
    """(id, digest, home, probe, keys, v): cell keys by table and as bytes, v the unit vector; null where there is none."""
    plain = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    schema = "id long, digest binary, home array<long>, probe array<long>, keys binary, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            lists = batch.column("v")
            rows = [np.array(x, np.float64) if x and None not in x else None for x in lists.to_pylist()]
            fine = {}
            for at, x in enumerate(rows):
                if x is not None and np.isfinite(x).all():
                    top = np.abs(x).max()
                    if top > 0:
                        fine.setdefault(len(x), []).append((at, x / top))
            out: list[list] = [[None] * len(rows) for _ in range(5)]
            for found in fine.values():
                unit = np.stack([x for _, x in found])
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                for (at, _), u, c in zip(found, unit, cells(unit, cosine)):
                    data = (u + 0.0).tobytes()
                    values = (hashlib.md5(data).digest(), c[:, 0], c[:, 1:].ravel(), c.tobytes(), data)
                    for column, value in zip(out, values):
                        column[at] = value
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                names=["id", "digest", "home", "probe", "keys", "v"],
            )

    return plain.mapInArrow(run, schema)


def count_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): per tile and vector a, rows it is newly linked with, and the smallest vector b of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches):
            a, b, links = tile_links(tile, cosine)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])

    return by_tile(rows).mapInArrow(run, "a long, b long, links long")


def tile_links(tile: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, copies = tile.column("id").to_numpy(), tile.column("copies").to_numpy()
    home, block = tile.column("home").to_numpy(), tile.column("block").to_numpy()
    at, (i, j) = tile.column("key")[0].as_py(), (tile.column(c)[0].as_py() for c in ("i", "j"))
    unit = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in tile.column("v")])
    keys = np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in tile.column("keys")]).reshape(len(ids), -1, 1 + PROBES)
    a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    keep = home[a] | home[b]
    if i != j:  # pairs within a block meet in that block's own tile
        keep &= block[a] != block[b]
    a, b = a[keep], b[keep]
    # the first cell, by table and key, where the pair meets: in [pairs, tables], the smaller of both ways
    none = np.iinfo(np.int64).max
    to_a = (keys[b] == keys[a][:, :, :1]).any(2)
    to_b = (keys[a] == keys[b][:, :, :1]).any(2)
    where = np.minimum(np.where(to_a, keys[a][:, :, 0], none), np.where(to_b, keys[b][:, :, 0], none))
    first = where[np.arange(len(a)), (to_a | to_b).argmax(1)]
    a, b = a[first == at], b[first == at]
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    order = np.argsort(ids)
    rank = np.argsort(order)
    forest = Forest(len(ids))
    for x, y in zip(rank[a].tolist(), rank[b].tolist()):
        forest.join(x, y)
    linked = np.flatnonzero(links)
    low = [ids[order[forest.root(r)]] for r in rank[linked].tolist()]
    return ids[linked], np.array(low, np.int64), links[linked].astype(np.int64)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    placed = stash(with_cells(vectors, key, vector, cosine), "cells")
    usable = placed.where("digest is not null and id is not null").select("id", "digest")
    usable = usable.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    usable = usable.groupBy("id").agg(F.min(F.struct("digest", "copies")).alias("one")).select("id", "one.*")
    classes = usable.groupBy("digest").agg(F.min("id").alias("id"), F.sum("copies").alias("copies"))
    classes = stash(classes, "vector-classes")
    sides = placed.select("id", "digest", "home", "probe", "keys", "v").dropDuplicates(["id", "digest"])
    chosen = stash(sides.join(classes, ["id", "digest"]), "chosen")
    members = chosen.select(F.explode("home").alias("key"), "id", F.lit(True).alias("home")).unionByName(
        chosen.select(F.explode("probe").alias("key"), "id", F.lit(False).alias("home"))
    )
    members = members.groupBy("key", "id").agg(F.max("home").alias("home"))
    lists = tile_lists(members, BLOCK, same_once=False, home=F.col("home"))
    tiles = (
        chosen.join(lists, "id")
        .select("id", "copies", "keys", "v", F.explode("tiles").alias("t"))
        .select("t.key", "t.i", "t.j", "t.home", "t.block", "id", "copies", "keys", "v")
    )
    links = stash(count_links(tiles, cosine), "links")
    linked = components(links.where("a <> b").select("a", "b"))
    counted = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    done = (
        classes.join(counted, "id", "left")
        .join(linked, F.col("id") == F.col("node"), "left")
        .select(
            F.col("digest").alias("d"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    known = F.col("id").isNotNull()
    out = placed.select("id", "digest").join(done, F.col("digest") == F.col("d"), "left")
    out = out.select(
        "id",
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component", "id")).alias("component_id"),
    )
    return out.withColumn("kept", ~known | (F.col("id") == F.col("component_id")))
