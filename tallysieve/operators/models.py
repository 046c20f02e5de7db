"""Models that are data work on Spark, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysieve.functions import columns as C
from tallysieve.functions.hashing import hash_bucket
from tallysieve.operators.metrics import MARGIN_SLACK, auroc
from tallysieve.operators.ordering import hash_row_number
from tallysieve.operators.skew import split_hot_lookup
from tallysieve.session import materialise, store


def folded_vector(bits: Column | str, width: int = 64) -> Column:
    """Set bits folded to `width` counts: a cheap dense feature vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fold(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: np.bincount(np.asarray(b, np.int64) % width, minlength=width).astype(float))

    return array_to_vector(fold(C.as_col(bits)))


def pointwise_ranker(
    pairs: DataFrame, features: DataFrame, panel: DataFrame, key: str = "entity_key", iterations: int = 50
) -> DataFrame:
    """Weighted logistic model of winners against losers; scores the panel.

    `features` and `panel` carry the key and a vector column `features`.
    """
    side = lambda name, label: pairs.select(
        F.col(f"{name}_key").alias(key), F.col("pair_weight").alias("weight"), F.lit(float(label)).alias("label")
    )
    rows = side("positive", 1).unionByName(side("negative", 0)).groupBy(key, "label").agg(F.sum("weight").alias("weight"))
    train = rows.join(features.select(key, "features"), key)
    model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-3).fit(train)
    scored = model.transform(panel)
    return scored.select(key, vector_to_array("rawPrediction")[1].alias("score"))


def paired_in_turn(left: DataFrame, right: DataFrame, by: Sequence[str], left_key: str, right_key: str) -> DataFrame:
    """(by..., left_key, right_key): rows of a group paired in seeded order, the shorter side over again; no row is left out.

    Rows whose group is null or has no other side go in turn with the other side's rows of all groups, under their own group.
    """
    by = list(by)
    sides = []
    for side, key, name in ((left, left_key, "l"), (right, right_key, "r")):
        numbered = hash_row_number(side.select(*by, key), f"_{name}", F.sha2(F.col(key).cast("string"), 256), key, by)
        sizes = side.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_{name}n"))
        sides.append((numbered, sizes))
    (ls, ln), (rs, rn) = sides
    sizes = materialise(ln.join(rn, by))
    # the rows of the larger side are numbered already; each takes the other side's row in turn
    more = split_hot_lookup(ls, sizes.where("_ln >= _rn"), by, left_key, "_ln").withColumn("_r", F.col("_l") % F.col("_rn"))
    fewer = split_hot_lookup(rs, sizes.where("_ln < _rn"), by, right_key, "_rn").withColumn("_l", F.col("_r") % F.col("_ln"))
    out = more.join(rs, [*by, "_r"]).select(*by, left_key, right_key)
    out = out.unionByName(fewer.join(ls, [*by, "_l"]).select(*by, left_key, right_key))
    for side, key, other, other_key in ((left, left_key, right, right_key), (right, right_key, left, left_key)):
        total = other.count()
        if total:
            lone = side.select(*by, key).join(other.select(*by).distinct(), by, "left_anti")
            lone = hash_row_number(lone, "_l", F.sha2(F.col(key).cast("string"), 256), key).withColumn("_r", F.col("_l") % total)
            others = hash_row_number(other.select(other_key), "_r", F.sha2(F.col(other_key).cast("string"), 256), other_key)
            out = out.unionByName(lone.join(others, "_r").select(*by, left_key, right_key))
    return out


def pair_ranker(
    batched: DataFrame, groups: Sequence[str], temperature: float = 0.1, margin: float = C.LN2, iterations: int = 50,
    columns: int | None = None,
) -> list[float]:
    """Coefficients of a linear score under the batch pair loss: Newton steps from zero to the full-batch optimum.

    softplus(-difference / T) is the logistic loss of a model without intercept on the
    difference vector. The batches are written once, a list of rows each; a step reads them, forms the pairs of a
    few batches at a time in memory and sums loss, gradient and curvature, so no pair is ever written.
    Rows carry proxy, confidence and x (array<double>) of `columns` numbers; without any pair all coefficients are 0.
    """
    usable = batched.where((F.col("confidence") > 0) & F.col("proxy").isNotNull())
    rows = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("proxy", "confidence")], "x")).alias("rows")
    packed = store(usable.groupBy(*groups, "batch").agg(rows).where(F.size("rows") > 1).select("rows"))
    if columns is None:
        seen = packed.select(F.size(F.col("rows")[0]["x"])).first()
        columns = seen[0] if seen else 0
    best, at = None, np.zeros(columns)
    for _ in range(iterations):
        found = packed.mapInArrow(_pair_sums(at, temperature, margin), "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
        sums = np.zeros(2 + columns + columns * columns)
        for k, v in found.collect():
            sums[k] = v
        if sums[0] == 0:
            break  # no pair
        loss, *slopes = sums[1:] / sums[0]
        if best is not None and not loss <= best[0] * (1 + 1e-12):
            at = (at + best[1]) / 2  # too far: half the way back
            continue
        best = loss, at
        gradient, curvature = np.array(slopes[:columns]), np.array(slopes[columns:]).reshape(columns, columns)
        step = np.linalg.lstsq(curvature, -gradient, rcond=1e-12)[0]
        at = at + step
        if -gradient @ step < 1e-10 * loss:  # the next step would be about the square of this one
            return at.tolist()
    return (np.zeros(columns) if best is None else best[1]).tolist()


def _pair_sums(at: np.ndarray, temperature: float, margin: float):
    """Sums over a task's pairs (k, v): 0 the weight, 1 the loss, then gradient and curvature at `at`."""
    width = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + width + width * width)
        for batch in batches:
            lists = batch.column("rows")
            flat = lists.flatten()
            proxy, confidence = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("proxy", "confidence"))
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            sizes = lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                i, j = np.triu_indices(size, 1)
                alike = starts[sizes == size]
                few = max(1, 65_536 // len(i))
                for k in range(0, len(alike), few):
                    a, b = (alike[k : k + few, None] + i).ravel(), (alike[k : k + few, None] + j).ravel()
                    delta = proxy[a] - proxy[b]
                    kept = np.abs(delta) >= margin - MARGIN_SLACK
                    a, b, delta = a[kept], b[kept], delta[kept]
                    d = (x[a] - x[b]) * (np.sign(delta) / temperature)[:, None]
                    weight = np.minimum(confidence[a], confidence[b])
                    z = d @ at
                    lost = np.exp(-np.logaddexp(0, z))  # the loss falls by this for a unit of z
                    sums[0] += weight.sum()
                    sums[1] += weight @ np.logaddexp(0, -z)
                    sums[2 : 2 + width] -= (weight * lost) @ d
                    sums[2 + width :] += (d.T @ (d * (weight * lost * (1 - lost))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["k", "v"])

    return run


def multi_target(
    index: DataFrame, scope: Column, inputs: Sequence[str] | str, key: str = "entity_key", iterations: int = 20
) -> DataFrame:
    """Nine Huber regressions on scaled targets, combined to an active score per row.

    `inputs` is a vector column or numeric columns to assemble.
    """
    targets = C.raw_targets()
    ready = index.withColumns(targets).withColumn("weight", C.evidence_weight())
    if not isinstance(inputs, str):
        ready = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(ready)
    elif inputs != "features":
        ready = ready.withColumn("features", F.col(inputs))
    train = ready.where(scope)
    stats = train.agg(
        *[F.avg(n).alias(f"m_{n}") for n in targets], *[F.stddev_pop(n).alias(f"s_{n}") for n in targets]
    ).first()
    scored = ready
    for name in targets:
        mean, scale = stats[f"m_{name}"], stats[f"s_{name}"]
        scale = 1.0 if scale is None or scale < 1e-6 else scale
        label = train.withColumn("label", (F.col(name) - mean) / scale)
        model = LinearRegression(loss="huber", weightCol="weight", maxIter=iterations, predictionCol=f"p_{name}").fit(label)
        scored = model.transform(scored).withColumn(f"p_{name}", F.col(f"p_{name}") * scale + mean)
    return scored.select(key, C.active_score(lambda n: F.col(f"p_{n}")).alias("predicted_active_score"))


def domain_classifier_auc(
    df: DataFrame, in_comparison: Column, features: Sequence[str], key: str, folds: int = 5, seed: str = "fold",
    iterations: int = 50,
) -> DataFrame:
    """Cross-validated AUROC of telling two samples apart: (fold, auroc).

    Folds come from a hash of the key; scaling and class weights are fitted inside the fold.
    """
    data = df.select(
        key, in_comparison.cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]
    ).withColumn("fold", hash_bucket(F.col(key).cast("string"), seed, folds))
    data, parts = materialise(data), None
    for fold in range(folds):
        train = data.where(F.col("fold") != fold)
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        total = sum(counts.values())
        if len(counts) < 2:
            continue  # one class only: nothing to tell apart
        weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
        pipeline = Pipeline(
            stages=[
                VectorAssembler(inputCols=list(features), outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                LogisticRegression(weightCol="w", regParam=0.01, maxIter=iterations),
            ]
        )
        model = pipeline.fit(train.withColumn("w", weight))
        test = model.transform(data.where(F.col("fold") == fold).withColumn("w", F.lit(1.0)))
        scored = test.select("fold", "label", vector_to_array("rawPrediction")[1].alias("score"))
        parts = scored if parts is None else parts.unionByName(scored)
    if parts is None:
        parts = data.select("fold", "label", F.lit(None).cast("double").alias("score"))
    return auroc(parts, "label", "score", ["fold"])


def visit_counts(batched: DataFrame, key: str = "entity_key") -> DataFrame:
    """How often a training schedule visits each entity."""
    return batched.groupBy(key).agg(F.count(F.lit(1)).alias("visits"))
