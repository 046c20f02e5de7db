"""One-to-one nearest matching without replacement, as deferred acceptance in rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.hashing import order_hash
from tallysieve.operators.ordering import hash_row_number
from tallysieve.session import ensure_checkpoint_dir, materialise, shuffled


def standardised(df: DataFrame, features: Sequence[str], base: DataFrame) -> DataFrame:
    """Features centred and scaled by mean and population deviation of `base` (0 becomes 1)."""
    stats = base.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    )
    for f in features:
        spread = stats.select(f"s_{f}").scalar()
        df = df.withColumn(
            f"z_{f}", (F.col(f) - stats.select(f"m_{f}").scalar()) / F.when(spread == 0, 1.0).otherwise(spread)
        )
    return df


def matched_controls(
    positives: DataFrame, negatives: DataFrame, features: Sequence[str], key: str, seed: int
) -> DataFrame:
    """Each positive, in seeded order, gets its nearest free negative (ties: smaller key).

    Positives propose to their nearest negative that has not refused them; a negative
    holds the proposer that comes first in the order and may drop it later. The end
    state equals the serial loop over positives. A proposal looks only at negatives in
    adjacent cells of a feature grid; a positive that finds none within reach doubles
    its cell width, so no all-pairs table is built. One checkpoint per round.

    Result: positive_key, negative_key, squared_distance.
    """
    ensure_checkpoint_dir(positives.sparkSession)
    k = len(features)
    numbered = hash_row_number(positives, "turn", order_hash(seed, key), key)
    z = [f"z_{f}" for f in features]
    p = standardised(numbered, features, negatives).select(F.col(key).alias("p"), "turn", F.array(*z).alias("pf"))
    n = materialise(standardised(negatives, features, negatives).select(F.col(key).alias("n"), F.array(*z).alias("nf")))
    key_type = n.schema["n"].dataType
    state = materialise(
        p.select(
            "p", "turn", "pf",
            F.lit(None).cast(key_type).alias("n"), F.lit(None).cast("double").alias("d2"),
            F.lit(None).cast(key_type).alias("n0"), F.lit(-1.0).alias("d0"), F.lit(1).alias("scale"),
        )
    )
    edge = lambda v: F.max(F.greatest(*[F.abs(F.col(v)[i]) for i in range(k)], F.lit(0.0)))
    size, span = n.agg(F.count(F.lit(1)), edge("nf")).first()
    count, reach = state.agg(F.count(F.lit(1)), edge("pf")).first()
    if count > size:
        raise ValueError("more positives than negatives")
    span = max(span or 0.0, reach or 0.0, 1e-9)
    base = 2 * span * min(1.0, (8 / max(size, 1)) ** (1 / k))

    def gridded(df: DataFrame, vector: str, width: float) -> DataFrame:
        return df.withColumn("cell", F.transform(vector, lambda x: F.floor(x / width)))

    def around(df: DataFrame) -> DataFrame:
        for i in range(k):
            df = df.withColumn(f"_d{i}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        shifted = F.array(*[F.col("cell")[i] + F.col(f"_d{i}") for i in range(k)])
        return df.withColumn("cell", shifted).drop(*[f"_d{i}" for i in range(k)])

    distance = F.aggregate(F.zip_with("pf", "nf", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    while True:  # each round settles or refuses at least one proposal for good
        open_rows = state.where("n is null")
        scales = [r[0] for r in open_rows.select("scale").distinct().collect()]
        if not scales:
            break
        holders = state.where("n is not null").select(F.col("n").alias("_n"), F.col("turn").alias("held_turn"))
        offers = None
        for scale in scales:
            width = base * scale
            mine = around(gridded(open_rows.where(F.col("scale") == scale).select("p", "turn", "pf", "n0", "d0"), "pf", width))
            near = mine.join(shuffled(gridded(n, "nf", width)), "cell").withColumn("d2", distance)
            # adjacent cells are complete up to `width`; rows farther off wait for a wider pass
            if width <= 2 * span:
                near = near.where(F.col("d2") <= width * width)
            later = (F.col("d2") > F.col("d0")) | ((F.col("d2") == F.col("d0")) & (F.col("n") > F.col("n0")))
            near = near.where(later).select("p", "turn", "n", "d2")
            offers = near if offers is None else offers.unionByName(near)
        # a negative held by an earlier turn refuses for good
        free = offers.join(shuffled(holders), F.col("n") == F.col("_n"), "left").where("held_turn is null or held_turn > turn")
        best = free.groupBy("p").agg(F.min(F.struct("d2", "n")).alias("o"))
        asked = state.join(shuffled(best), "p", "left").select(
            "p", "turn", "pf", "n0", "d0", "scale",
            F.coalesce("n", "o.n").alias("n"), F.coalesce("d2", "o.d2").alias("d2"),
        )
        first = asked.where("n is not null").groupBy("n").agg(F.min("turn").alias("_first"))
        judged = asked.join(shuffled(first), "n", "left")
        wins, silent = F.col("turn") == F.col("_first"), F.col("n").isNull()
        refused = ~silent & ~wins
        state = materialise(
            judged.select(
                "p", "turn", "pf",
                F.when(wins, F.col("n")).alias("n"), F.when(wins, F.col("d2")).alias("d2"),
                F.when(refused, F.col("n")).otherwise(F.col("n0")).alias("n0"),
                F.when(refused, F.col("d2")).otherwise(F.col("d0")).alias("d0"),
                F.when(silent, F.col("scale") * 2).otherwise(F.col("scale")).alias("scale"),
            )
        )
    return state.select(F.col("p").alias("positive_key"), F.col("n").alias("negative_key"), F.col("d2").alias("squared_distance"))
