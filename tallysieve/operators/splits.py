"""Leakage-safe splits and reproducible samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.functions.hashing import order_hash
from tallysieve.operators.ordering import hash_row_number
from tallysieve.session import store


def hash_sample(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    """The n rows of lowest seeded hash: independent of file order and partitioning."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    return df.withColumn("_h", order_hash(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def hash_slice(df: DataFrame, offset: int, length: int | None, seed: int | str, key: str) -> DataFrame:
    """Rows offset..offset+length of the seeded order (a reproducible shard)."""
    numbered = hash_row_number(df, "_n", order_hash(seed, key), key)
    chosen = F.col("_n") >= offset
    if length is not None:
        chosen = chosen & (F.col("_n") < offset + length)
    return numbered.where(chosen).drop("_n")


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int | str, key: str) -> DataFrame:
    """n rows of lowest seeded hash per stratum.

    Few strata may hold all rows, so no task orders a stratum: rows are written and counted by stratum and
    first digits of the hash, and only those up to the digits that hold the n-th row are ordered.
    """
    rows = store(df)
    h, digits = order_hash(seed, key), [*strata, "_d"]
    counted = rows.withColumn("_d", F.substring(h, 1, 3)).groupBy(*digits).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*strata).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).where(F.col("_before") < n)
    last = store(before.groupBy(*strata).agg(F.max("_d").alias("_last")))
    names = [f"_s{i}" for i in range(len(strata))]
    last = last.select(*[F.col(c).alias(x) for c, x in zip(strata, names)], "_last")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(strata, names)], F.lit(True))
    near = rows.withColumn("_h", h).join(last, same & (F.substring("_h", 1, 3) <= F.col("_last"))).drop(*names, "_last")
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_h")


def group_holdout(df: DataFrame, group: str, fraction: float, seed: int | str) -> DataFrame:
    """Adds `heldout`: max(1, min(n - 1, round(n * fraction))) of the n groups, in seeded order.

    The round is half-to-even.
    """
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1))).scalar()
    numbered = hash_row_number(groups, "_n", order_hash(seed, group), group)
    held = F.greatest(F.lit(1), F.least(F.col("_total") - 1, F.bround(F.col("_total") * F.lit(float(fraction)), 0)))
    chosen = numbered.withColumn("_total", total).where(F.col("_n") < held).select(
        group, F.lit(True).alias("heldout")
    )
    return df.join(chosen, group, "left").withColumn("heldout", F.coalesce("heldout", F.lit(False)))


def shard_bounds(total: Column, shards: int) -> Column:
    """Array of (shard, start, stop) with start = total * i div shards."""
    edge = lambda i: F.floor(total * i / F.lit(shards)).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.struct(i.alias("shard"), edge(i).alias("start"), edge(i + 1).alias("stop")),
    )


def shard_of(row_id: Column, total: Column, shards: int) -> Column:
    """Index of the contiguous shard that holds a row id: the inverse of `shard_bounds`."""
    return (F.floor(((row_id + 1) * shards - 1) / total)).cast("int")


def split_violations(members: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys (entities or groups) that occur in more than one split."""
    return members.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def rekey_groups(df: DataFrame, group: str, rekey, name: str = "group_key") -> DataFrame:
    """Apply `rekey(Column) -> Column` once per distinct group and join the result back."""
    mapping = df.select(group).distinct().withColumn("_new", rekey(F.col(group)))
    return df.join(mapping, group, "left").drop(group).withColumnRenamed("_new", name)
