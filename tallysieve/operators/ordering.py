"""Global order without a single-task window.

Ranks, running sums and exact quantiles over a whole table need a total order. A
window without partition keys would pull every row into one task, so rows go into
ordered buckets, bucket totals (a few thousand rows) are accumulated, and each
bucket adds its offset to a window of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.session import ensure_checkpoint_dir, materialise, shuffled, store

# rows that one task orders; buckets follow from it, up to the size of a driver array
ROWS_PER_BUCKET, MOST_BUCKETS = 100_000, 16_384


def _partition(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _splits(values: DataFrame, value: str, buckets: int | None) -> list[float]:
    """Bucket edges near equal row counts; any edges give the same result."""
    wanted = buckets or max(2, min(MOST_BUCKETS, -(-values.count() // ROWS_PER_BUCKET)))
    quantiles = F.percentile_approx(F.col(value).cast("double"), [i / wanted for i in range(1, wanted)], 10_000)
    edges = values.select(quantiles).first()[0] or [0.0]
    return [float("-inf"), *sorted(set(edges)), float("inf")]


def running_totals(
    values: DataFrame,
    value: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    with_next: bool = False,
    buckets: int | None = None,
    ready: bool = False,
) -> DataFrame:
    """Inclusive running sums of `sums[out] = column` in order of `value`.

    `values` has one row per (by, value): aggregate first. It is written once (unless it is
    `ready`), since edges, bucket totals and result each read it; quantile edges cut the value range
    into buckets that grow in number with the rows. `with_next` adds `next_value`, the following
    value inside the same `by` group.
    """
    by = list(by)
    values = values if ready else materialise(values)
    splits = _splits(values, value, buckets)
    order = F.col(value).desc() if descending else F.col(value).asc()
    keyed = values.withColumn("_v", F.col(value).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(keyed).drop("_v")
    totals = bucketed.groupBy(*by, "_b").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    )
    across = _partition(by).orderBy(F.col("_b").desc() if descending else F.col("_b").asc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_b",
        F.lead("_hi" if descending else "_lo").over(across).alias("_edge"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    within = Window.partitionBy(*by, "_b").orderBy(order)
    rows = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = [F.coalesce(F.lead(value).over(within), F.col("_edge")).alias("next_value")] if with_next else []
    return bucketed.join(offsets, [*by, "_b"]).select(
        *values.columns, *[(F.sum(c).over(rows) + F.col(f"_o_{o}")).alias(o) for o, c in sums.items()], *extra
    )


def hash_row_number(
    df: DataFrame, name: str, digest: Column, tie: str, by: Sequence[str] = (), start: int = 0, digits: int | None = None
) -> DataFrame:
    """Consecutive row numbers in order of a hex digest.

    Buckets are the first hex digits, as many as the largest group asks for, even because the
    digest is uniform. The rows are written once, since sizes and numbers both read them; groups that
    one task can order need neither (`df` is then read twice, for the largest group and the numbers).
    """
    by = list(by)
    if by and digits is None:
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        if largest <= ROWS_PER_BUCKET:
            whole = Window.partitionBy(*by).orderBy("_h", tie)
            return df.withColumn("_h", digest).withColumn(name, (F.row_number().over(whole) - 1 + start).cast("bigint")).drop("_h")
        digits = max(1, math.ceil(math.log(largest / ROWS_PER_BUCKET, 16)))
    written = store(df)  # without the digest, which does not compress and is soon computed again
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, written.count()) / ROWS_PER_BUCKET, 16)))
    hashed = written.withColumn("_b", F.substring(digest, 1, digits)).withColumn("_h", F.unhex(digest))
    sizes = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = _partition(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*by, "_b").orderBy("_h", tie)
    return (
        hashed.join(shuffled(offsets) if by else offsets, [*by, "_b"])
        .withColumn(name, F.col("_off") + F.row_number().over(within) - 1 + start)
        .drop("_h", "_b", "_off")
    )


def global_row_number(df: DataFrame, name: str, order: Sequence[Column], start: int = 1) -> DataFrame:
    """Consecutive row numbers in any total order.

    Range partitions are drawn by sampling, so they are fixed by a reliable checkpoint
    before their sizes are used as offsets.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = fixed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = _partition(()).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_p").orderBy(*order)
    # one row per partition: bounded by spark.sql.shuffle.partitions
    return (
        fixed.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_off") + F.row_number().over(within) - 1 + start)
        .drop("_p", "_off")
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), **options) -> DataFrame:
    """One row per distinct value: n and the average rank (1-based) of its ties."""
    ranked = running_totals(value_counts(df, value, by), value, {"_upto": "n"}, by, **options)
    return ranked.select(*by, value, "n", (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"))


def exact_quantiles(
    df: DataFrame, value: str, named: Mapping[str, float], by: Sequence[str] = (), **options
) -> DataFrame:
    """Linear-interpolated quantiles, exact, without holding all values in one task."""
    return counted_quantiles(materialise(value_counts(df, value, by)), value, "n", named, by, **options)


def counted_quantiles(
    counts: DataFrame, value: str, n: str, named: Mapping[str, float], by: Sequence[str] = (), **options
) -> DataFrame:
    """The same from a written table of values and how often each occurs."""
    by = list(by)
    ranked = running_totals(counts, value, {"_upto": n}, by, ready=True, **options)
    totals = counts.groupBy(*by).agg(F.sum(n).alias("_total"))
    sized = ranked.join(totals, by) if by else ranked.withColumn("_total", totals.scalar())
    x = F.col(value).cast("double")
    picks = []
    for name, p in named.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (index >= F.col("_upto") - F.col(n)) & (index < F.col("_upto"))
            picks.append(F.max(F.when(inside, x)).alias(f"_{side}_{name}"))
    found = sized.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    result = []
    for name, p in named.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*by, *result)
