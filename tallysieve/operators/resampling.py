"""Permutation null and bootstrap of ranking metrics, drawn by counts instead of rows.

A resample of a table matters only through how many positives and negatives it has at each distinct score. These
counts are drawn directly, down a tree of two levels: first over at most BUCKETS ranges of scores, for all
replicates of a chunk at once, then within each range over its distinct scores. A permutation splits the
positives like balls drawn without replacement (hypergeometric), a class-wise bootstrap draws
multinomial counts by binomial splitting. The range totals of a replicate also say what lies above and
below a range, so ranges need not see each other. Cost is distinct scores times replicates; no row is copied.

Draws are numpy's, seeded by (seed, range, chunk): a task that is run again draws the same. One draw without
replacement takes fewer than 10^9 rows of a class (a limit of the sampler).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.operators.metric import numbers, streamed
from tallysieve.operators.metrics import auroc, unpivot
from tallysieve.operators.ordering import exact_quantiles
from tallysieve.session import materialise

BUCKETS, SCORES = 1024, 512
CHUNK = 256
FIELDS = "bucket int, chunk int, replicate array<int>, pos array<long>, neg array<long>, below_neg array<long>, above_pos array<long>, above_neg array<long>"


def score_counts(df: DataFrame, label: str, score: str) -> tuple[DataFrame, list]:
    """(score, pos, neg, bucket) of each distinct score, and the totals (bucket, pos, neg) in order: at most BUCKETS."""
    table = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
    )
    table = materialise(table)
    count = min(BUCKETS, max(1, table.count() // SCORES))
    cuts = F.array_distinct(F.percentile_approx("score", [k / count for k in range(1, count)] or [0.5], 10_000))
    cuts = table.agg(cuts.alias("c")).first()["c"] if count > 1 else []
    low = F.lit(0)
    if cuts:
        low = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("score")))
    table = table.withColumn("bucket", low.cast("int"))
    totals = table.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy("bucket").collect()
    return table, totals


def _split(rng: np.random.Generator, pos: np.ndarray, neg: np.ndarray, total: np.ndarray, permute: bool, negatives: np.ndarray):
    """Counts (positive, negative) [parts, replicates] of `total` positives and `negatives` over parts with the given counts."""
    if permute:
        size = pos + neg
        left, rest, out = total.copy(), int(size.sum()), np.zeros((len(size), len(total)), np.int64)
        for k, n in enumerate(size.tolist()):
            rest -= n
            out[k] = rng.hypergeometric(n, rest, left) if rest else left
            left = left - out[k]
        return out, size[:, None] - out
    return _multinomial(rng, pos, total), _multinomial(rng, neg, negatives)


def _multinomial(rng: np.random.Generator, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    left, rest, out = total.copy(), int(weight.sum()), np.zeros((len(weight), len(total)), np.int64)
    for k, w in enumerate(weight.tolist()):
        out[k] = rng.binomial(left, w / rest) if rest else 0
        left = left - out[k]
        rest -= w
    return out


def resampled_metrics(
    df: DataFrame, replicates: int, seed: int, permute: bool, label: str = "label", score: str = "score"
) -> DataFrame:
    """(replicate, auroc, average_precision) of seeded relabellings (`permute`) or class-wise bootstrap samples."""
    table, totals = score_counts(df, label, score)
    spark = df.sparkSession
    P, N = sum(r["pos"] for r in totals), sum(r["neg"] for r in totals)
    names = np.array([r["bucket"] for r in totals], np.int32)
    pos, neg = (np.array([r[c] for r in totals], np.int64) for c in ("pos", "neg"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in numbers(batch, "chunk").tolist():
                which = np.arange(chunk * CHUNK, min(replicates, (chunk + 1) * CHUNK), dtype=np.int32)
                rng = np.random.default_rng([seed, len(names), chunk])
                p, n = _split(rng, pos, neg, np.full(len(which), P), permute, np.full(len(which), N))
                above_p, above_n = P - np.cumsum(p, 0), N - np.cumsum(n, 0)
                below = np.cumsum(n, 0) - n
                lists = lambda m: pa.array(list(m), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names), pa.array(np.full(len(names), chunk, np.int32)),
                        pa.array([which] * len(names), pa.list_(pa.int32())), *map(lists, (p, n, below, above_p, above_n)),
                    ],
                    names=[f.split(" ")[0] for f in FIELDS.split(", ")],
                )

    chunks = spark.range(-(-replicates // CHUNK)).select(F.col("id").cast("int").alias("chunk"))
    asked = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").mapInArrow(top, FIELDS)

    def start(held: pa.Table | None):
        held = held.sort_by("score")
        own_pos, own_neg = numbers(held, "w_pos"), numbers(held, "w_neg")

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for k in range(batch.num_rows):
                value = {c: batch.column(c)[k].values.to_numpy() for c in ("replicate", "pos", "neg", "below_neg", "above_pos", "above_neg")}
                rng = np.random.default_rng([seed, 1 + int(batch.column("bucket")[k].as_py()), int(batch.column("chunk")[k].as_py())])
                p, n = _split(rng, own_pos, own_neg, value["pos"], permute, value["neg"])
                area = (p * (value["below_neg"] + np.cumsum(n, 0) - n / 2)).sum(0)  # ties count half
                tp = value["above_pos"] + np.cumsum(p[::-1], 0)[::-1]
                fp = value["above_neg"] + np.cumsum(n[::-1], 0)[::-1]
                precise = (p * tp / np.maximum(tp + fp, 1)).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value["replicate"]), pa.array(area.astype(float)), pa.array(precise)], names=["replicate", "area", "precise"]
                )

        return step

    held = table.select("bucket", "score", F.col("pos").alias("w_pos"), F.col("neg").alias("w_neg"))
    # the ranges of one chunk are one more key: a range is copied once for each chunk of replicates
    each = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // CHUNK) - 1))).alias("chunk")
    found = streamed(held.select("*", each), asked, ["bucket", "chunk"], "replicate int, area double, precise double", start)
    summed = found.groupBy("replicate").agg(F.sum("area").alias("area"), F.sum("precise").alias("precise"))
    both = F.lit(float(P) * N) if P and N else F.lit(None).cast("double")
    return summed.select(
        (F.col("replicate") + 1).alias("replicate"),
        (F.col("area") / both).alias("auroc"),
        F.when(F.lit(bool(P and N)), F.col("precise") / F.lit(float(max(P, 1)))).alias("average_precision"),
    )


def permutation_p(df: DataFrame, replicates: int, seed: int, label: str = "label", score: str = "score") -> DataFrame:
    """(auroc, p_value): (1 + relabellings at least as good) / (1 + replicates)."""
    df = df.select(label, score)
    null = resampled_metrics(df, replicates, seed, True, label, score).withColumn("_o", auroc(df, label, score).scalar())
    at_least = F.count_if(F.col("auroc") >= F.col("_o") - 1e-12)
    return null.agg(F.max("_o").alias("auroc"), ((at_least + 1) / F.lit(float(replicates + 1))).alias("p_value"))


def bootstrap_ci(
    df: DataFrame, replicates: int, seed: int, confidence: float = 0.95, label: str = "label", score: str = "score"
) -> DataFrame:
    """Percentile intervals (metric, low, high) of class-wise bootstrap samples."""
    tail = (1 - confidence) / 2
    found = resampled_metrics(df.select(label, score), replicates, seed, False, label, score)
    long = unpivot(found, ["auroc", "average_precision"], [], "metric", "value")
    return exact_quantiles(long, "value", {"low": tail, "high": 1 - tail}, ["metric"])
