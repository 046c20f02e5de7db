"""Equi-join whose hot keys are split into tiles.

A key holding more than `1/share` of a side (and more than `min_rows`) is hot. By
counting, a side has at most `share` hot keys, so the hot-key table holds at most
2 * share rows and is safe to broadcast at any scale. A hot left key is cut into
tiles by a hash of the row, the matching right rows are copied once per tile, and
vice versa; every (left, right) combination still meets exactly once. All other
keys join untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.session import materialise, shuffled, store

SHARE = 1000
MIN_ROWS = 100_000
KEY_BUCKETS = 65_536
MOST_BITS = 28


def heavy_keys(df: DataFrame, on: Sequence[str], share: int = SHARE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(on..., _n, _room): keys of more than _room rows, which is `min_rows` or 1/share of all; at most `share` keys.

    Rows are counted by hash bucket first. A heavy key makes its bucket heavy, and only rows of heavy buckets,
    usually none, are counted by key: light keys are never shuffled.
    """
    bucketed = df.select(*on).withColumn("_b", F.pmod(F.xxhash64(*on), F.lit(KEY_BUCKETS)))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    room = F.greatest(F.lit(float(min_rows)), F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0)) / share)
    full = counts.withColumn("_room", room).where(F.col("_n") > F.col("_room")).select("_b", "_room")
    return (
        bucketed.join(F.broadcast(full), "_b")
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_room").alias("_room"))
        .where(F.col("_n") > F.col("_room"))
    )


def hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], share: int = SHARE, min_rows: int = MIN_ROWS):
    """(on..., _lt, _rt): tile counts of the keys to split; at most 2 * share rows."""
    on = list(on)
    tiles = F.ceil(F.col("_n") / F.col("_room")).cast("int")
    heavy = (
        heavy_keys(left, on, share, min_rows)
        .select(*on, tiles.alias("_lt"), F.lit(1).alias("_rt"))
        .unionByName(heavy_keys(right, on, share, min_rows).select(*on, F.lit(1).alias("_lt"), tiles.alias("_rt")))
    )
    return heavy.groupBy(*on).agg(F.max("_lt").alias("_lt"), F.max("_rt").alias("_rt"))


def may_meet(rows: DataFrame, others: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose 64-bit hash `key` occurs in `others`, and some more.

    A bitmap tells, of sixteen bits a row of `others` but no more than 2 ** `most_bits` (32 MB), so that it can be broadcast
    whatever the size; when it fills, more rows pass. For rows to be joined on `key`, before they are shuffled.
    """
    bits = min(most_bits, max(16, (16 * others.count()).bit_length()))
    at = F.pmod(F.col(key), F.lit(1 << bits))
    place = [F.shiftright(at, 16).alias("_chunk"), F.shiftright(at, 6).bitwiseAND(1023).cast("int").alias("_word"), at.bitwiseAND(63).cast("int").alias("_bit")]
    marks = others.select(*place).select("_chunk", "_word", F.expr("shiftleft(1L, _bit)").alias("_bits"))
    slots = F.col("id")
    none = rows.sparkSession.range(1 << (bits - 6)).select(
        F.shiftright(slots, 10).alias("_chunk"), slots.bitwiseAND(1023).cast("int").alias("_word"), F.lit(0).cast("bigint").alias("_bits")
    )
    words = marks.unionByName(none).groupBy("_chunk", "_word").agg(F.bit_or("_bits").alias("_bits"))
    ordered = words.groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_o"))
    bitmap = ordered.select("_chunk", F.transform("_o", lambda x: x["_bits"]).alias("_map"))
    known = rows.select("*", *place).join(F.broadcast(bitmap), "_chunk")
    return known.where(F.expr("shiftright(_map[_word], _bit) & 1") == 1).select(*rows.columns)


def split_hot_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_id: str,
    right_id: str,
    condition: Column | None = None,
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join on `on` plus a residual `condition`; sides share no other column name.

    Both sides are written once: counting the keys and joining read the same rows, so what
    lies before is planned and computed a single time. With the `hot_keys` given, sides that are
    cheap to read from a written table are not written again.
    """
    on = list(on)
    if hot is None:
        left, right = store(left), store(right)
        hot = hot_keys(left, right, on, share, min_rows)
    hot = F.broadcast(hot)
    l = (
        left.join(hot, on, "left")
        .withColumn("_li", F.when(F.col("_lt") > 1, F.pmod(F.xxhash64(left_id), F.col("_lt"))).otherwise(F.lit(0)))
        .withColumn("_ri", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_rt"), F.lit(1)) - 1)))
        .withColumn("_li", F.col("_li").cast("int"))
        .drop("_lt", "_rt")
    )
    r = (
        right.join(hot, on, "left")
        .withColumn("_ri", F.when(F.col("_rt") > 1, F.pmod(F.xxhash64(right_id), F.col("_rt"))).otherwise(F.lit(0)))
        .withColumn("_li", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_lt"), F.lit(1)) - 1)))
        .withColumn("_ri", F.col("_ri").cast("int"))
        .drop("_lt", "_rt")
    )
    renamed = r
    for name in (*on, "_li", "_ri"):
        renamed = renamed.withColumnRenamed(name, f"__r_{name}")
    match = F.lit(True)
    for name in (*on, "_li", "_ri"):
        match = match & (F.col(name) == F.col(f"__r_{name}"))
    if condition is not None:
        match = match & condition
    return l.join(shuffled(renamed), match, "inner").drop("_li", "_ri", *[f"__r_{n}" for n in (*on, "_li", "_ri")])


def split_hot_lookup(
    fact: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    row_id: str,
    weight: str,
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Inner join to a table with one row per key that knows its own row count (`weight`).

    Keys heavier than 1/share of all rows (at most `share` of them) are spread over
    salts on the fact side and copied on the table side.
    """
    on = list(on)
    table = materialise(table)
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    room = max(float(min_rows), (total or 0) / share)
    if (most or 0) <= room:  # nothing to split, and no broadcast for a list of no keys
        return fact.join(shuffled(table), on)
    room = F.lit(room)
    sized = table.withColumn("_room", room).withColumn(
        "_tiles", F.greatest(F.ceil(F.col(weight) / F.col("_room")).cast("int"), F.lit(1))
    )
    hot = F.broadcast(sized.where("_tiles > 1").select(*on, "_tiles"))
    salted = fact.join(hot, on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_tiles")), F.lit(0)).cast("int")
    )
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    # the table grows with the input, and Spark would take it for small by its compressed size
    return salted.drop("_tiles").join(shuffled(copies.drop("_tiles", "_room")), [*on, "_salt"]).drop("_salt")
