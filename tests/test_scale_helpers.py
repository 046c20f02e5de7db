"""The distributed paths (buckets, tiles, salts) give what the plain path gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.operators import metrics as M
from tallysieve.operators import ordering as O
from tallysieve.operators import shift as D
from tallysieve.operators.skew import split_hot_join, split_hot_lookup


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), round(rng.gauss(0, 3), 1), rng.random() < 0.3) for i in range(600)]
    return spark.createDataFrame(rows, "id long, g string, v double, l boolean").withColumn(
        "label", F.col("l").cast("int")
    ).cache()


def as_set(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_in_buckets(numbers, by, descending):
    counts = O.value_counts(numbers, "v", by)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("v") if descending else F.asc("v"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = counts.select("*", F.sum("n").over(upto).alias("c"), F.lead("v").over(order).alias("next_value"))
    cut = O.running_totals(counts, "v", {"c": "n"}, by, descending, with_next=True, buckets=7)
    assert as_set(plain) == as_set(cut.select(*plain.columns))


def test_metrics_in_buckets_equal_brute_force(numbers):
    rows = numbers.collect()
    pos = np.array([r.v for r in rows if r.label]), np.array([r.v for r in rows if not r.label])
    brute = ((pos[0][:, None] > pos[1]) + 0.5 * (pos[0][:, None] == pos[1])).mean()
    for options in ({}, {"buckets": 9}):
        assert M.auroc(numbers, "label", "v", **options).first()[0] == pytest.approx(brute)
    order = sorted({r.v for r in rows}, reverse=True)
    ap, total = 0.0, len(pos[0])
    for v in order:
        tp, n = sum(r.v >= v and r.l for r in rows), sum(r.v >= v for r in rows)
        ap += sum(r.v == v and r.l for r in rows) / total * tp / n
    assert M.average_precision(numbers, "label", "v", buckets=5).first()[0] == pytest.approx(ap)
    assert M.auroc(numbers.where("label = 1"), "label", "v").first()[0] is None


def test_quantiles_exact(numbers):
    values = np.array([r.v for r in numbers.collect()])
    got = O.exact_quantiles(numbers, "v", {"a": 0.1, "b": 0.5, "c": 0.97}, buckets=6).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.97])))


def test_spearman_ties_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 2.0, 5.0), (3.0, 1.0, 5.0), (3.0, 0.0, 5.0)], "x double, y double, k double")
    ranks = np.array([1, 2, 3.5, 3.5]), np.array([3.5, 3.5, 2, 1])
    assert M.spearman(df, "x", "y").first()[0] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert M.spearman(df, "x", "k").first()[0] is None
    assert M.spearman(df.limit(1), "x", "y").first()[0] is None


def test_ks_wasserstein_psi(numbers):
    a = np.sort([r.v for r in numbers.collect() if r.g == "a"])
    b = np.sort([r.v for r in numbers.collect() if r.g == "b"])
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = np.searchsorted(a, grid, "right") / len(a), np.searchsorted(b, grid, "right") / len(b)
    counts = D.sample_counts(numbers, "v", F.col("g") == "a")
    got = D.ks_and_wasserstein(counts, buckets=8).first()
    assert got.ks_statistic == pytest.approx(np.abs(fa - fb).max())
    assert got.wasserstein == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    share = [np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (a, b)]
    assert D.psi(counts).first()[0] == pytest.approx(((share[1] - share[0]) * np.log(share[1] / share[0])).sum())
    constant = numbers.withColumn("v", F.lit(1.0))
    assert D.psi(D.sample_counts(constant, "v", F.col("g") == "a")).first()[0] == 0


def test_row_numbers(numbers):
    digest = F.sha2(F.col("id").cast("string"), 256)
    got = O.hash_row_number(numbers, "n", digest, "id").select("id", "n")
    want = numbers.select("id", (F.row_number().over(Window.orderBy(digest)) - 1).alias("n"))
    assert as_set(got) == as_set(want)
    ranked = O.global_row_number(numbers, "r", [F.desc("v"), F.asc("id")]).select("id", "r")
    plain = numbers.select("id", F.row_number().over(Window.orderBy(F.desc("v"), F.asc("id"))).alias("r"))
    assert as_set(ranked) == as_set(plain)


def test_hot_keys_are_split_without_changing_the_join(spark):
    # one key holds a third of the left side and more of the right
    left = spark.range(900).select(F.col("id").alias("lid"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(300).select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    condition = (F.col("lid") + F.col("rid")) % 7 == 0
    want = left.join(right, "k").where(condition).select("k", "lid", "rid")
    for share, least in ((1000, 100_000), (20, 10)):
        got = split_hot_join(left, right, ["k"], "lid", "rid", condition, share, least).select("k", "lid", "rid")
        assert as_set(got) == as_set(want)
    table = left.groupBy("k").agg(F.count("*").alias("n"))
    got = split_hot_lookup(left, table, ["k"], "lid", "n", 20, 10).select("lid", "n")
    assert as_set(got) == as_set(left.join(table, "k").select("lid", "n"))
