"""Buckets of candidates as tiles of bounded size.

A bucket with more than `block` members is cut into blocks by a hash of the member, and every
pair of blocks makes a tile: a tile holds at most two blocks, whatever the bucket's size, and
every pair of members of a bucket meets in exactly one tile, or in one per block if in the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import parts, stash


def tile_lists(members: DataFrame, block: int, same_once: bool, home: Column | None = None) -> DataFrame:
    """(id, tiles): the tiles (key, i, j, home, own block) that each member of a bucket takes part in.

    `members` has (key, id), each pair once. Buckets of one member are left out, and those
    without a member for which `home` holds. With `same_once`, buckets with the same members
    (by a 128-bit digest) give one tile list.
    """
    home = F.lit(True) if home is None else home
    members = members.select("key", "id", home.alias("home"))
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.max("home").alias("any_home"),
    )
    sizes = sizes.where("n > 1 and any_home")
    if same_once:
        sizes = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(
            F.col("key"),
            F.least("mine", x).alias("i"),
            F.greatest("mine", x).alias("j"),
            F.col("home"),
            F.col("mine").alias("block"),
        ),
    )
    return (
        members.join(sizes.select("key", blocks.alias("blocks")), "key")
        .withColumn("mine", mine)
        .select("id", tiles.alias("tiles"))
        .groupBy("id")
        .agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
    )


def bucket_sizes(members: DataFrame) -> DataFrame:
    """(key, n) of the buckets (key, id) with several members; of those with the same members (by a 128-bit digest), one."""
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    )
    return sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")


def mixed_lists(members: DataFrame, block: int, mixes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of buckets with several, sizes, lists): `lists` has (id, part, tiles), a tile (key, i, j) for each small bucket
    and, for those beyond `block` members, `mixes` tiles altogether: blocks of different buckets, or of one dealt in different
    ways. The rows grow with the members; what such blocks don't connect is left to the next round."""
    sizes = stash(bucket_sizes(members), "buckets")
    # the buckets grow with the corpus: never broadcast, at any size
    kept = stash(members.join(sizes.hint("merge"), "key"), "bucket-members")
    blocks = F.ceil(F.col("n") / F.lit(block))
    mix = lambda k: F.struct("key", k.cast("long").alias("i"), F.pmod(F.xxhash64("id", "key", k), blocks).alias("j"))
    several = F.transform(F.array(*[F.lit(k) for k in range(mixes)]), mix)
    one = F.struct("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    listed = kept.groupBy("id").agg(
        F.collect_list(F.when(F.col("n") <= block, one)).alias("small"),
        F.flatten(F.collect_list(F.when(F.col("n") > block, several))).alias("large"),  # bands times mixes at most
    )
    # every bucket's first deal before any second one; the same buckets for all their members
    turn = F.array_sort(F.transform("large", lambda t: F.struct(t["i"].alias("a"), F.xxhash64(t["key"]).alias("b"), t.alias("t"))))
    chosen = F.transform(F.slice(turn, 1, mixes), lambda t: t["t"])
    return kept, sizes, listed.select("id", F.col("id").alias("part"), F.concat("small", chosen).alias("tiles"))


def unsettled_lists(members: DataFrame, sizes: DataFrame, linked: DataFrame, block: int) -> DataFrame:
    """(id, part, tiles) for the buckets beyond `block` members that hold several components of `linked` (node, component).

    A component of `block` members or more has blocks of its own, the others share blocks. Each pair of blocks is
    a tile, but for two of the same component.
    """
    # the links grow with the corpus: never broadcast, at any size
    known = members.where(F.col("n") > block).join(linked.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    known = stash(known.select("key", "id", F.coalesce("component", "id").alias("part")), "bucket-parts")
    counts = known.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    own = F.when(F.col("m") >= block, F.col("part"))
    open_ = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        # a bucket of n members has n / block of these at most
        F.collect_list(F.when(F.col("m") >= block, F.struct("part", F.ceil(F.col("m") / block).alias("blocks")))).alias("large"),
        F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("rest"),
    )
    open_ = open_.where("parts > 1").drop("parts")
    mine = known.join(counts.select("key", "part", own.alias("own"), "m").hint("merge"), ["key", "part"])
    mine = mine.join(open_.hint("merge"), "key")
    shared = F.ceil(F.col("rest") / block)
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("m") / block))).otherwise(
        F.pmod(F.xxhash64("part", "key"), shared)
    )
    name = lambda part, k: F.xxhash64(F.coalesce(part, F.lit(-1).cast("long")), part.isNull(), k.cast("long"))
    others = F.flatten(
        F.transform(
            F.filter("large", lambda x: F.col("own").isNull() | (x["part"] != F.col("own"))),
            lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda k: name(x["part"], k)),
        )
    )
    small = F.when(
        F.col("rest") > 0, F.transform(F.sequence(F.lit(0).cast("long"), shared - 1), lambda k: name(F.lit(None).cast("long"), k))
    ).otherwise(F.array().cast("array<long>"))
    listed = mine.select("key", "id", "part", name(F.col("own"), number).alias("mine"), F.concat(others, small).alias("others"))
    tiles = F.transform(
        "others", lambda x: F.struct("key", F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j"))
    )
    return (
        listed.select("id", "part", tiles.alias("tiles"))
        .groupBy("id", "part")
        .agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
    )


def by_tile(rows: DataFrame) -> DataFrame:
    """Rows (key, i, j, ...) dealt and sorted by tile."""
    return rows.repartition(parts(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after the other, from batches sorted by (key, i, j)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1)
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:]):
            tile = tuple(ids[a])
            if held and tile != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tile
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the members of one tile; the smallest number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
