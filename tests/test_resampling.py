"""Resampling by counts against all relabellings of a small table, and against draws of rows."""

import itertools
from collections import Counter

import numpy as np
import pytest

from tallysieve.operators import resampling as RS

SCORES = [1, 1, 2, 2, 2, 3, 5, 5, 7, 8, 8, 9]
LABELS = [0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 1, 0]
SCHEMA = "label int, score double"


def area(labels, scores):
    p = [s for s, l in zip(scores, labels) if l == 1]
    n = [s for s, l in zip(scores, labels) if l != 1]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def precision(labels, scores):
    total, out = sum(labels), 0.0
    for t in set(scores):
        above = [l for l, s in zip(labels, scores) if s >= t]
        out += sum(l for l, s in zip(labels, scores) if s == t) * sum(above) / len(above)
    return out / total


@pytest.mark.parametrize("per_range", [512, 2])
def test_relabellings_have_the_exact_distribution(spark, monkeypatch, per_range):
    monkeypatch.setattr(RS, "SCORES", per_range)
    df = spark.createDataFrame(list(zip(LABELS, map(float, SCORES))), SCHEMA)
    rows = RS.resampled_metrics(df, 6000, 7, True).collect()
    assert sorted(r.replicate for r in rows) == list(range(1, 6001))
    n, p = len(LABELS), sum(LABELS)
    exact = Counter()
    for chosen in itertools.combinations(range(n), p):
        labels = [int(i in chosen) for i in range(n)]
        exact[round(area(labels, SCORES), 9), round(precision(labels, SCORES), 9)] += 1
    total = sum(exact.values())
    got = Counter((round(r.auroc, 9), round(r.average_precision, 9)) for r in rows)
    assert set(got) <= set(exact)
    areas = lambda c: np.array(sorted(v[0] for v in c.elements()))
    assert abs(areas(got).mean() - areas(exact).mean()) < 0.01 and abs(areas(got).std() - areas(exact).std()) < 0.01
    common = [k for k in exact if exact[k] / total > 0.01]
    assert all(abs(got[k] / 6000 - exact[k] / total) < 4 * np.sqrt(exact[k] / total / 6000) for k in common)
    again = {r.replicate: r.auroc for r in RS.resampled_metrics(df.repartition(3), 6000, 7, True).collect()}
    assert again == {r.replicate: r.auroc for r in rows}
    observed, p_value = RS.permutation_p(df, 6000, 7).first()
    tail = sum(c for (a, _), c in exact.items() if a >= area(LABELS, SCORES) - 1e-9) / total
    assert observed == pytest.approx(area(LABELS, SCORES)) and abs(p_value - tail) < 0.03


def test_bootstrap_by_counts(spark, monkeypatch):
    monkeypatch.setattr(RS, "SCORES", 3)
    df = spark.createDataFrame(list(zip(LABELS, map(float, SCORES))), SCHEMA)
    rows = RS.resampled_metrics(df, 3000, 1, False).collect()
    draw = np.random.default_rng(0)
    p, n = ([s for s, l in zip(SCORES, LABELS) if l == k] for k in (1, 0))
    labels, plain = [1] * len(p) + [0] * len(n), []
    for _ in range(3000):
        scores = [*draw.choice(p, len(p)), *draw.choice(n, len(n))]
        plain.append((area(labels, scores), precision(labels, scores)))
    got, plain = np.array([(r.auroc, r.average_precision) for r in rows]), np.array(plain)
    assert np.abs(got.mean(0) - plain.mean(0)).max() < 0.015 and np.abs(got.std(0) - plain.std(0)).max() < 0.015
    assert np.abs(np.quantile(got, [0.1, 0.9], 0) - np.quantile(plain, [0.1, 0.9], 0)).max() < 0.04


def test_resampling_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (1, 2.0)], SCHEMA)
    assert all(r.auroc is None and r.average_precision is None for r in RS.resampled_metrics(df, 5, 1, True).collect())
    assert RS.resampled_metrics(df.limit(0), 5, 1, True).count() == 0


@pytest.mark.parametrize("band", [0.0, 0.5, 6.0])
def test_relabelling_by_hash_equals_the_plain_order(spark, band):
    import hashlib

    from tallysieve.operators import metrics as M

    rows = [(100 + i, l, float(s)) for i, (l, s) in enumerate(zip(LABELS * 5, SCORES * 5))]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    got = {r.replicate: r.auroc for r in M.permutation_aurocs(df, 40, 7, "id", band=band).collect()}
    digest = lambda k, i: hashlib.sha256(f"7|{k}|{i}".encode()).hexdigest()
    for k in range(1, 41):
        first = sorted((digest(k, i), s) for i, _, s in rows)[: sum(LABELS) * 5]
        marked = {h for h, _ in first}
        assert got[k] == pytest.approx(area([int(digest(k, i) in marked) for i, _, _ in rows], [s for _, _, s in rows]))
    assert len(got) == 40


def test_few_rows_of_a_relabelling_are_put_in_order(spark, monkeypatch):
    """Of 4,000 rows in 5 replicates, those near the last marked one, not all 20,000."""
    from tallysieve.operators import metrics as M

    df = spark.range(4000).selectExpr("id", "cast(id % 2 as int) label", "cast(id % 97 as double) score")
    monkeypatch.setattr(M, "hash_row_number", None)
    assert M.permutation_aurocs(df, 5, 7, "id").count() == 5


@pytest.mark.parametrize("size, draws, chunk", [(1 << 16, 1 << 15, 100), (4, 7, 3)])
def test_bootstrap_by_hash_equals_plain_draws(spark, monkeypatch, size, draws, chunk):
    """Also with several ranges, blocks and chunks; rows without a score are drawn and left out, those without a class are not."""
    import hashlib

    from tallysieve.operators import draws as DR
    from tallysieve.operators import metrics as M

    for name, value in (("RANGE", size), ("DRAWS", draws), ("CHUNK", chunk)):
        monkeypatch.setattr(DR, name, value)
    rows = [(100 + i, l, float(s)) for i, (l, s) in enumerate(zip(LABELS * 5, SCORES * 5))]
    rows += [(7, 1, None), (8, 0, None), (9, None, 3.0), (10, 0, float("nan"))]
    df = spark.createDataFrame(rows, "class long, n int, place double")  # names that the operator uses inside
    got = {r.replicate: r for r in M.bootstrap_metrics(df, 20, 9, "class", "n", "place").collect()}
    assert sorted(got) == list(range(1, 21))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for k in range(1, 21):
        labels, scores = [], []
        for c in (0, 1):
            slots = sorted((digest(str(i)), s) for i, l, s in rows if l == c)
            for slot in range(len(slots)):
                s = slots[int(digest(f"9|{k}|{c}|{slot}")[:15], 16) % len(slots)][1]
                if s is not None:
                    labels.append(c)
                    scores.append(100.0 if s != s else s)  # NaN is above all
        assert got[k].auroc == pytest.approx(area(labels, scores))
        assert got[k].average_precision == pytest.approx(precision(labels, scores))


def test_bootstrap_by_hash_with_one_class_or_without_rows(spark):
    from tallysieve.operators import metrics as M

    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 2.0)], "id long, label int, score double")
    rows = M.bootstrap_metrics(df, 5, 1, "id").collect()
    assert len(rows) == 5 and all(r.auroc is None and r.average_precision is None for r in rows)
    assert M.bootstrap_metrics(df.limit(0), 5, 1, "id").count() == 0
    assert M.bootstrap_metrics(df.withColumn("score", df["score"] * None), 5, 1, "id").count() == 0


def test_bootstrap_writes_no_draws(spark, monkeypatch):
    """Of 4,000 rows in 5 replicates, at most a row per replicate, not one per score and replicate."""
    from tallysieve.operators import metrics as M

    written, materialise = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    df = spark.range(4000).selectExpr("id", "cast(id % 2 as int) label", "cast(id % 97 as double) score")
    assert M.bootstrap_metrics(df, 5, 7, "id").count() == 5
    assert max(t.count() for t in written) <= 5
