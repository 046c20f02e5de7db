"""Models fitted on batches, and what they and the index write."""

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.operators import metrics as M
from tallysieve.operators import models as ML
from tallysieve.operators import ranking as R


def batched(spark, n=150, seed=4):
    rng = np.random.default_rng(seed)
    rows = [
        (k, k // 70, float(p), float(c), [float(v) for v in x])
        for k, (p, c, x) in enumerate(zip(rng.normal(size=n), rng.choice([0.0, 0.5, 1.0], n), rng.normal(size=(n, 3))))
    ]
    df = spark.createDataFrame(rows, "id long, shard int, proxy double, confidence double, x array<double>")
    return rows, R.assign_batches(df, ["shard"], ["id"], 32, "merge")


def test_pair_ranker_reaches_the_optimum_and_writes_batches_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ML, "store", lambda df: written.append(df.count()) or df, raising=False)
    rows, cut = batched(spark)
    fitted = np.array(ML.pair_ranker(cut, ["shard"], columns=3))
    found = cut.select("shard", "batch", "id").collect()
    assert written == [len({(r.shard, r.batch) for r in found})]
    gradient, total = np.zeros(3), 0.0
    place = {r.id: (r.shard, r.batch) for r in found}
    for (i, _, p, c, x), (j, _, q, e, y) in itertools.combinations(rows, 2):
        if place[i] == place[j] and abs(p - q) >= C.LN2 - M.MARGIN_SLACK and min(c, e) > 0:
            d = (np.array(x) - np.array(y)) * math.copysign(10.0, p - q)
            gradient -= min(c, e) * d / (1 + math.exp(d @ fitted))
            total += min(c, e)
    assert total > 0 and np.abs(gradient / total).max() < 1e-6


def test_pair_ranker_without_pairs(spark):
    _, cut = batched(spark)
    assert ML.pair_ranker(cut.withColumn("proxy", F.lit(1.0)), ["shard"]) == [0.0, 0.0, 0.0]


def test_numbering_writes_what_is_kept_and_no_digest(spark, sf, monkeypatch):
    from tallysieve.operators import ordering as O
    from tallysieve.plans import fixtures as X
    from tallysieve.plans import queries_metrics as Q

    written, store = [], O.store
    monkeypatch.setattr(O, "store", lambda df: written.append(df.columns) or store(df), raising=False)
    index, channels = Q._channels(spark, sf)
    assert written == [["entity_key", *Q.CHANNEL_INPUTS]]
    whole = X.index(spark, sf, row_ids=True).orderBy("entity_id").select("entity_id", "entity_key").collect()
    assert [(r.entity_id, r.entity_key) for r in index.orderBy("entity_id").select("entity_id", "entity_key").collect()] == whole
    assert [r.entity_key for r in sorted(whole, key=lambda r: hashlib.sha256(r.entity_key.encode()).hexdigest())] == [r.entity_key for r in whole]


def test_stratified_sample_orders_few_rows(spark, monkeypatch):
    from tallysieve.functions.hashing import order_hash
    from tallysieve.operators import splits as L

    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("s"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("t"))
    found = L.stratified_sample(df, ["s", "t"], 7, 11, "id")
    assert "_last" in found._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for r in df.withColumn("h", order_hash(11, "id")).collect():
        best.setdefault((r.s, r.t), []).append((r.h, r.id))
    assert {(r.s, r.t, r.id) for r in found.collect()} == {(*k, i) for k, v in best.items() for _, i in sorted(v)[:7]}
    assert L.stratified_sample(df.where("id < 4"), ["s"], 7, 11, "id").count() == 4


def test_lookup_broadcasts_no_table_that_grows(spark):
    from tallysieve.operators.skew import split_hot_lookup

    fact = spark.range(900).select("id", (F.col("id") % 30).alias("k"))
    table = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for room, broadcasts in ((100, 0), (10, 1)):
        found = split_hot_lookup(fact, table, ["k"], "id", "n", 1000, room)
        assert {(r.id, r.k, r.n) for r in found.collect()} == {(i, i % 30, 30) for i in range(900)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("BroadcastHashJoin") == broadcasts and "SortMergeJoin" in plan


def test_components_hand_no_plan_on(spark):
    from tallysieve.operators import similarity as S

    links = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    found = S.components(links)
    assert "LogicalRDD" not in found._jdf.queryExecution().logical().toString()
    assert {(r.u, r.v) for r in found.collect()} == {(i, 0) for i in range(1, 40)}
