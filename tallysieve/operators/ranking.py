"""Ranks, fusion, diversity-capped selection, batches and set comparisons of rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.operators.ordering import global_row_number, running_totals, value_counts
from tallysieve.operators.skew import split_hot_lookup


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "catalog_id") -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(k)


def head_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def percentile_rank(scores: DataFrame, key: str = "catalog_id", score: str = "score", name: str = "rank") -> DataFrame:
    """Dense rank of the score divided by the number of distinct scores: (0, 1], ties equal.

    Only distinct scores are ranked; a score shared by many rows is joined back in salted parts.
    """
    distinct = value_counts(scores, score).withColumn("one", F.lit(1).cast("bigint"))
    total = distinct.agg(F.count(F.lit(1))).scalar()
    ranked = running_totals(distinct, score, {"_position": "one"}).select(
        F.col(score).alias("_score"), "n", (F.col("_position") / total).alias(name)
    )
    return split_hot_lookup(scores.withColumn("_score", F.col(score)), ranked, ["_score"], key, "n").drop("_score", "n")


def fuse(
    panel: DataFrame, ranks: Mapping[str, DataFrame], weights: Mapping[str, float], key: str = "catalog_id"
) -> DataFrame:
    """Weighted mean of percentile ranks; a missing source adds 0; counts the sources present.

    `ranks[name]` holds (key, name). Only sources of positive weight count.
    """
    enabled = {n: float(w) for n, w in weights.items() if w > 0 and n in ranks}
    if not enabled:
        raise ValueError("no score source has positive weight")
    fused = panel
    for name in enabled:
        fused = fused.join(ranks[name].select(key, name), key, "left")
    score, present = F.lit(0.0), F.lit(0)
    for name, weight in enabled.items():
        score = score + weight * F.coalesce(name, F.lit(0.0))
        present = present + F.col(name).isNotNull().cast("int")
    return fused.select(
        *panel.columns,
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in enabled],
        present.alias("sources"),
        (score / sum(enabled.values())).alias("fusion_score"),
    )


def eligibility_rank(
    fused: DataFrame, eligible: str = "eligible", score: str = "fusion_score", key: str = "catalog_id",
    name: str = "fusion_rank",
) -> DataFrame:
    """Rank 1..n: eligible first, then score descending, then key."""
    return global_row_number(fused, name, [F.col(eligible).desc(), F.col(score).desc(), F.col(key).asc()])


def select_diverse(df: DataFrame, group: str, cap: int, size: int, order: Sequence[Column]) -> DataFrame:
    """Greedy selection in rank order with at most `cap` rows per group.

    The greedy rule equals: keep each group's first `cap` rows, then take the first `size`.
    """
    if cap <= 0 or size <= 0:
        raise ValueError("cap and size must be positive")
    return head_per_group(df, [group], order, cap).orderBy(*order).limit(size)


def first_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of the order with one row per group, and the rank before the filter kept."""
    return select_diverse(df, group, 1, n, order)


def every_nth(df: DataFrame, row_id: str, stride: int, limit: int | None = None) -> DataFrame:
    chosen = df.where(F.col(row_id) % stride == 0)
    return chosen if limit is None else chosen.orderBy(row_id).limit(limit)


def rank_change(df: DataFrame, keep: Column, order: Sequence[Column]) -> DataFrame:
    """Rows passing `keep` with their rank before (`rank_before`) and after (`rank_after`) the filter."""
    before = global_row_number(df, "rank_before", order)
    return global_row_number(before.where(keep), "rank_after", [F.col("rank_before").asc()])


def best_epoch(history: DataFrame, run: Sequence[str], metric: str, epoch: str = "epoch") -> DataFrame:
    """Best epoch per run; a tie keeps the earlier, NaN never wins."""
    usable = history.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return head_per_group(usable, run, [F.desc(metric), F.asc(epoch)], 1)


def improvements(history: DataFrame, run: Sequence[str], loss: str, epoch: str = "epoch") -> DataFrame:
    """Adds `improved`: strictly below every earlier finite loss of the run."""
    finite = F.when(~F.isnan(loss), F.col(loss))
    w = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.min(finite).over(w)
    return history.withColumn("improved", finite.isNotNull() & (earlier.isNull() | (finite < earlier)))


def assign_batches(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], size: int, tail: str) -> DataFrame:
    """Cut each group into batches of `size` in order: adds `position`, `batch`.

    Groups must be bounded (shards are). A tail of one row is dropped (`tail="drop"`)
    or joins the batch before it (`tail="merge"`).
    """
    if size < 2:
        raise ValueError("ranking needs at least two rows per batch")
    ordered = Window.partitionBy(*groups).orderBy(*order)
    whole = Window.partitionBy(*groups)
    numbered = df.withColumn("position", F.row_number().over(ordered) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    alone = (F.col("_n") % size == 1) & (F.col("position") == F.col("_n") - 1)
    batch = F.floor(F.col("position") / size).cast("int")
    if tail == "merge":
        kept = numbered.where("_n >= 2").withColumn("batch", F.when(alone, batch - 1).otherwise(batch))
    elif tail == "drop":
        kept = numbered.where(~alone).withColumn("batch", batch)
    else:
        raise ValueError("tail must be drop or merge")
    return kept.drop("_n")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables, and in each."""
    tag = lambda df, n: df.select(key).distinct().select(key, F.lit(n).alias("side"))
    sides = tag(a, 1).unionByName(tag(b, 2)).groupBy(key).agg(F.sum("side").alias("s"))
    return sides.agg(
        F.count_if(F.col("s") != 2).alias("keys_a"),
        F.count_if(F.col("s") != 1).alias("keys_b"),
        F.count_if(F.col("s") == 3).alias("shared"),
    )


def coverage_gap(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys missing from or extra in `found`."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = found.select(key).distinct().withColumn("_f", F.lit(True))
    return (
        a.join(b, key, "full")
        .where(F.col("_e").isNull() | F.col("_f").isNull())
        .select(key, F.when(F.col("_f").isNull(), "missing").otherwise("extra").alias("gap"))
    )


def top_overlap(a: DataFrame, b: DataFrame, n: int, key: str = "catalog_id", score: str = "score") -> DataFrame:
    shared = top_k(a, n, score, key).select(key).join(top_k(b, n, score, key).select(key), key, "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared"))


def expand_runs(selected: DataFrame, templates: Sequence[str], key: str = "catalog_id") -> DataFrame:
    """Every selected row with every template of a short list, plus a run name."""
    return selected.withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates]))).withColumn(
        "run_name", F.format_string("%s__%s", F.col(key).cast("string"), F.col("template"))
    )


def score_difference(a: DataFrame, b: DataFrame, key: str = "catalog_id", score: str = "score") -> DataFrame:
    """Target score, off-target score and their difference per shared id."""
    left = a.select(key, F.col(score).alias("target_score"))
    right = b.select(key, F.col(score).alias("off_target_score"))
    return left.join(right, key).withColumn("delta", F.col("target_score") - F.col("off_target_score"))
