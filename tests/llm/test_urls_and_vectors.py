"""URL filter and lattice hashing against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysieve.llm import graph, tiles, urls, vectors
from tallysieve.llm.common import ROW
from tallysieve.llm.queries import URL_RULES


def test_url_rules_and_list(spark):
    pages = [
        (1, "http://www.example.com/en/x?y=1"),
        (2, "https://a.EXAMPLE.com/en/1"),
        (3, "http://other.org/list/"),
        (4, "http://www.other.org/list#f"),
        (5, "http://b.net/es/1"),
        (6, "no scheme"),
        (7, None),
        (8, "http://example.com"),
        (9, "http://notexample.com/en/"),
        (3, "http://other.org/list/"),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("other.org/list",), (None,), ("other.org/list",)], "url string")
    rows = urls.judge(pages, listed, URL_RULES).select(f"{ROW}.page_id", "host", "path", "rule", "verdict", "listed").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == 10
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow", False)
    assert got[2] == ("a.example.com", "/en/1", "example.com/en/", "block", False)
    assert got[3] == ("other.org", "/list/", None, "block", True) and got[4][3:] == ("block", True)
    assert got[5][2:4] == ("net/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow", False)
    assert got[8] == ("example.com", "", None, "allow", False)
    assert got[9][2:4] == ("com/", "allow")
    nothing = urls.judge(pages, listed.limit(0), URL_RULES)
    assert nothing.where("listed").count() == 0 and nothing.count() == 10
    assert urls.judge(pages.limit(0), listed, URL_RULES).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    listed = spark.range(500).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    pages = spark.range(5000).select("id", F.concat(F.lit("http://h.org/"), "id").alias("url"))
    out = urls.judge(pages, listed, [])
    assert out.where("listed").count() == 500 and out.where("listed and not maybe_listed").count() == 0
    assert out.where("maybe_listed and not listed").count() < 500


def brute(rows, cosine):
    units = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0:
            units[i] = np.array(v) / np.linalg.norm(v)
    links = {i: set() for i, _ in rows}
    for a, u in units.items():
        for b, v in units.items():
            if a != b and len(u) == len(v) and u @ v >= cosine:
                links[a].add(b)
    low = {i: i for i in links}
    for _ in links:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


@pytest.mark.parametrize("block", [4, 128])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    draw = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = draw.standard_normal(64)
        for k in range(1 + 3 * c):
            rows.append((len(rows), (centre + 0.02 * (k % 7) * draw.standard_normal(64)).tolist()))
    rows += [(len(rows) + k, rows[40][1]) for k in range(6)]
    rows += [(300, None), (301, []), (302, [0.0] * 64), (303, [1.0, None]), (304, [float("nan")] * 64), (305, [1.0] * 8), (306, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    want = brute(rows, 0.95)
    assert sum(n for n, _, _ in got.values()) >= 0.97 * sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and set(got) == set(want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97
    assert vectors.near_vectors(df.limit(0)).count() == 0
    twice = df.unionByName(df.where("vec_id = 305").withColumn("vec_id", F.lit(3).cast("long")))
    assert vectors.near_vectors(twice).count() == len(rows) + 1


@pytest.mark.parametrize("dims, cosine", [(8, 0.95), (16, 0.95), (32, 0.95), (48, 0.96), (64, 0.95), (64, 0.85), (16, 0.98)])
def test_pairs_at_the_threshold_are_found(spark, dims, cosine):
    draw = np.random.default_rng(6)
    a = draw.standard_normal((600, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.standard_normal(a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = cosine + (1 - cosine) * 0.2 * draw.random(len(a))[:, None] + 1e-9
    rows = list(enumerate(np.concatenate([a, near * a + np.sqrt(1 - near**2) * b]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r["id"]: r["n_links"] for r in vectors.near_vectors(df, cosine=cosine).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= cosine).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.995 * want.sum()


def test_lattice_points_are_nearest():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((200, 8)) * 3
    near = vectors.nearest_point(x)
    assert len(vectors.roots()) == 240 and np.allclose((vectors.roots() ** 2).sum(1), 2)
    own = ((x - near) ** 2).sum(1)
    other = ((x[:, None] - near[:, None] - vectors.roots()[None]) ** 2).sum(2).min(1)
    assert (own <= other + 1e-9).all() and (own <= 1 + 1e-9).all()


def test_components(spark):
    draw = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2)) if a != b] + [(k, k + 1) for k in range(400, 450)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs + pairs[:20], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {n: root(n) for n in {x for p in pairs for x in p}}
    assert graph.components(df.limit(0)).count() == 0


def test_every_pair_of_a_bucket_meets(spark):
    members = spark.range(50).select(F.lit(1).cast("long").alias("key"), "id")
    rows = tiles.tile_lists(members, 7, same_once=True).select("id", F.explode("tiles").alias("t")).collect()
    places = {}
    for r in rows:
        places.setdefault((r["t"]["i"], r["t"]["j"]), set()).add(r["id"])
    assert all(any({a, b} <= p for p in places.values()) for a in range(50) for b in range(a))
    assert max(map(len, places.values())) < 50
