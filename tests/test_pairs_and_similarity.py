"""Mining and similarity against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.functions import fingerprints as FP
from tallysieve.operators import matching as MT
from tallysieve.operators import pairs as P
from tallysieve.operators import similarity as S
from tallysieve.operators.ordering import hash_row_number
from tallysieve.functions.hashing import order_hash
from tallysieve.session import materialise


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def bits(spark):
    rng = random.Random(1)
    base = [sorted(rng.sample(range(2048), 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        row = set(rng.choice(base))
        for _ in range(rng.randint(0, 14)):
            row.discard(rng.choice(sorted(row)))
            row.add(rng.randrange(2048))
        rows.append((i, sorted(row)))
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a third of all rows are copies
    rows.append((300, []))
    df = spark.createDataFrame(rows, "entity_id long, fp_bits array<int>")
    return materialise(df.withColumn("fp_size", F.size("fp_bits")).withColumn("fp_words", FP.pack_words("fp_bits"))), dict(rows)


def sided(df, p):
    return df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])


@pytest.mark.parametrize("tile", [16, 2048])
def test_similar_pairs(bits, tile):
    df, data = bits
    distinct = materialise(S.distinct_fingerprints(df))
    assert distinct.where("copies = 61").count() == 1
    got = {(r[0], r[1]): r[2] for r in S.similar_pairs(distinct, 0.5, leaf_rows=tile).collect()}
    ids = [r.entity_id for r in distinct.collect()]
    want = {
        (a, b): jaccard(data[a], data[b]) for a in ids for b in ids if a < b and jaccard(data[a], data[b]) >= 0.5
    }
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("hot", [(1000, 100_000), (10, 5)])
def test_prefix_join_equals_brute_force(bits, hot):
    df, data = bits
    left, right = df.where("entity_id < 60"), df.where("entity_id >= 60")
    got = {
        (r.l_entity_id, r.r_entity_id): r.similarity
        for r in S.tanimoto_join(sided(left, "l_"), sided(right, "r_"), 0.6, "l_", "r_", key="entity_id", share=hot[0], min_rows=hot[1]).collect()
    }
    want = {
        (a, b): jaccard(data[a], data[b])
        for a in data for b in data if a < 60 <= b and jaccard(data[a], data[b]) >= 0.6
    }
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("k,tile", [(1, 16), (3, 16), (3, 2048)])
def test_nearest_tanimoto(bits, k, tile):
    df, data = bits
    left, right = df.where("entity_id < 40 or entity_id = 300"), df.where("entity_id between 40 and 299")
    got = {}
    for r in S.nearest_tanimoto(sided(left, "q_"), sided(right, "r_"), "q_", "r_", k, "entity_id", leaf_rows=tile).collect():
        got.setdefault(r.q_entity_id, []).append((r["rank"], r.r_entity_id))
    refs = [i for i in data if 40 <= i < 300]
    for q in [i for i in data if i < 40 or i == 300]:
        want = sorted(refs, key=lambda r: (-jaccard(data[q], data[r]), r))[:k]
        assert [r for _, r in sorted(got[q])] == want


def plain_series(data, threshold):
    parent = {i: i for i in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in parent:
        for b in parent:
            if a < b and data[a] and data[b] and jaccard(data[a], data[b]) >= threshold:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("leaf", [4, 32, 2048])
def test_series_components(bits, leaf):
    df, data = bits
    rows = S.series_components(df, 0.5, leaf_rows=leaf).collect()
    assert len(rows) == df.count() and {r.entity_id: r.series_id for r in rows} == plain_series(data, 0.5)


def test_series_write_few_links(spark, monkeypatch):
    """300 near copies: at most 299 links leave the tasks, in both rounds together."""
    rng = random.Random(4)
    base = list(range(0, 1200, 4))
    rows = [(i, sorted(set(rng.sample(base, 290)) | {1201 + i % 7})) for i in range(300)] + [(900, [5, 6, 7])]
    df = spark.createDataFrame(rows, "entity_id long, fp_bits array<int>")
    df = df.withColumn("fp_size", F.size("fp_bits")).withColumn("fp_words", FP.pack_words("fp_bits"))
    seen = []
    plain = S.components
    monkeypatch.setattr(S, "components", lambda links: (seen.append(links.count()), plain(links))[1])
    got = {r.entity_id: r.series_id for r in S.series_components(df, 0.6, leaf_rows=16).collect()}
    assert got == plain_series(dict(rows), 0.6) and sum(seen) <= 299


@pytest.mark.parametrize("tile", [8, 2048])
@pytest.mark.parametrize("minimum", [-1.0, 0.3])
def test_cosine_knn(spark, tile, minimum):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = materialise(
        spark.createDataFrame([(i, str(i % 2), [float(v) for v in x[i]]) for i in range(90)], "entity_id long, library string, embedding array<double>")
    )
    got = {}
    for r in S.cosine_knn(df.where("entity_id < 30"), df.where("entity_id >= 30"), 4, minimum=minimum, leaf_rows=tile).collect():
        got.setdefault(r.query_key, []).append((r["rank"], r.ref_key))
    for q in range(30):
        refs = [(-(x[q] @ x[r]), r) for r in range(30, 90) if r % 2 == q % 2 and x[q] @ x[r] >= minimum]
        assert [r for _, r in sorted(got.get(q, []))] == [r for _, r in sorted(refs)[:4]]


def entities(spark, n=140, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rng.randrange(3), rng.randrange(3), rng.randrange(6)]
        fp = {(p * 97 + v * 13 + j) % 2048 for p, v in enumerate(parts) for j in range(12)} | {1000 + j for j in range(8)}
        if rng.random() < 0.4:
            fp.add(1500 + i)
        rows.append((f"e{i:03d}", "L-%d-%d-%d" % tuple(parts), rng.randint(1, 30), rng.randint(0, 12), rng.randint(0, 2), rng.randint(0, 5), sorted(fp)))
    df = spark.createDataFrame(
        rows, "entity_key string, code string, count_target int, count_competitor int, control_evidence int, historic_hits int, fp_bits array<int>"
    )
    ready = df.withColumns(C.part_columns(C.code_fields("code"))).withColumn("fp_size", F.size("fp_bits")).withColumn("fp_words", FP.pack_words("fp_bits"))
    return materialise(ready), {r[0]: r for r in rows}


def shared(a, b):
    x, y = a[1].split("-")[1:], b[1].split("-")[1:]
    return sum(p == q for p, q in zip(x, y)) >= 2


def test_competition_pairs_brute_force(spark):
    df, rows = entities(spark)
    anchors, binders = df.where(C.competition_sensitive(0.3)), df.where(C.competition_retained(0.4))
    pos = [rows[r.entity_key] for r in anchors.collect()]
    neg = [rows[r.entity_key] for r in binders.collect()]
    got = {(r.positive_key, r.negative_key) for r in P.competition_pairs(anchors, binders, 0.5, 2.0, 2).collect()}
    want = set()
    ratio = lambda e: np.log((e[2] + 0.5) / (e[3] + 0.5))
    for n in neg:
        found = []
        for p in pos:
            fold = max(p[2] / n[2], n[2] / p[2])
            sim, margin = jaccard(p[6], n[6]), ratio(p) - ratio(n)
            if shared(p, n) and fold <= 2 and sim >= 0.5 and margin > 0:
                found.append((-sim, fold, -margin, p[0]))
        want |= {(f[3], n[0]) for f in sorted(found)[:2]}
    assert got == want and want


def test_matched_pairs_brute_force(spark):
    df, rows = entities(spark, seed=8)
    hits, others = df.where(C.competition_sensitive(0.3)), df.where(~C.competition_sensitive(0.3) & C.counter_evidence())
    pos = [rows[r.entity_key] for r in hits.collect()]
    neg = [rows[r.entity_key] for r in others.collect()]
    got = {(r.positive_key, r.negative_key) for r in P.matched_pairs(hits, others, 0.5, 2).collect()}
    want = set()
    for p in pos:
        found = [
            (-jaccard(p[6], n[6]), n[2], n[0]) for n in neg
            if shared(p, n) and p[2] > n[2] and p[3] <= n[3] and p[4] <= n[4] and jaccard(p[6], n[6]) >= 0.5
        ]
        want |= {(p[0], f[2]) for f in sorted(found)[:2]}
    assert got == want and want


def test_broad_pairs(spark):
    df, rows = entities(spark, seed=5)
    positives, pool, low = df.where("count_target > 20"), df.where("count_target between 4 and 20"), df.where("count_target <= 3")
    got = P.broad_pairs(positives, pool, low, 1, 2).collect()
    pool_rows = [rows[r.entity_key] for r in pool.collect()]
    for r in got:
        p, n = rows[r.positive_key], rows[r.negative_key]
        assert p[2] > n[2] and p[3] <= n[3] and p[4] <= n[4]
        assert r.pair_weight == (1.0 if n[3] > 0 or n[4] > 0 else 0.35)
        if r.negative_source == "local_counter":
            best = min(pool_rows, key=lambda e: (-jaccard(p[6], e[6]), e[0]))
            assert n[0] == best[0]
    assert {r.negative_source for r in got} == {"local_counter", "global_low_target"}


def test_matching_equals_serial_loop(spark):
    rng = random.Random(2)
    pos = [(i, rng.uniform(0, 6), rng.uniform(0, 3)) for i in range(25)]
    neg = [(100 + i, rng.uniform(0, 6), rng.uniform(0, 3)) for i in range(30)]
    neg += [(200 + i, *neg[i][1:]) for i in range(12)]  # equal features: the smaller key goes first
    schema = "id long, a double, b double"
    p, n = spark.createDataFrame(pos, schema), spark.createDataFrame(neg, schema)
    got = {r.positive_key: r.negative_key for r in MT.matched_controls(p, n, ["a", "b"], "id", 7).collect()}
    turns = {r.id: r.t for r in hash_row_number(p, "t", order_hash(7, "id"), "id").collect()}
    feats = np.array([x[1:] for x in neg])
    mean, sd = feats.mean(0), feats.std(0)
    z = lambda x: (np.array(x[1:]) - mean) / sd
    free, want = dict((x[0], z(x)) for x in neg), {}
    for x in sorted(pos, key=lambda x: turns[x[0]]):
        best = min(free, key=lambda k: (round(float(((free[k] - z(x)) ** 2).sum()), 12), k))
        want[x[0]] = best
        del free[best]
    assert len(got) == len(want) == len(set(got.values()))
    assert got == want


def test_unobserved_pairs_broadcast_nothing_that_grows(spark, tmp_path):
    entities(spark, seed=6)[0].write.parquet(f"{tmp_path}/e")
    df = spark.read.parquet(f"{tmp_path}/e")  # a small file, from which Spark guesses all sizes
    nobody = df.where("false").select("entity_key")
    found = P.unobserved_pairs(df.where("count_target > 20"), df, df.where("count_target > 20"), nobody)
    assert found.count() > 0
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [0, 10_000])
def test_shared_part_rows_are_slim_and_copies_dropped_in_crowded_keys(spark, monkeypatch, crowd):
    df, rows = entities(spark, n=60, seed=9)
    copies = df.where("entity_key < 'e030'")
    right = copies.unionByName(copies.withColumn("entity_key", F.concat("entity_key", F.lit("x"))))
    sides, plain = [], P.split_hot_join
    monkeypatch.setattr(P, "split_hot_join", lambda l, r, *a: (sides.extend([l, r]), plain(l, r, *a))[1])
    left = df.where("entity_key >= 'e030'")
    found = P.shared_part_join(left, right, "l_", "r_", None, 1, crowd=crowd).collect()
    assert not any("fp_" in c for side in sides for c in side.columns)
    got = {(r.l_entity_key, r.r_entity_key): r.similarity for r in found}
    want = {
        (a, b + x): jaccard(rows[a][6], rows[b][6])
        for a in rows for b in rows for x in ("", "x")[: 2 if crowd else 1] if b < "e030" <= a and shared(rows[a], rows[b])
    }
    best = lambda pairs: {k: v for k, v in pairs.items() if not k[1].endswith("x")}
    assert len(got) == len(found) and best(got) == pytest.approx(best(want)) and want
    assert crowd == 0 or got == pytest.approx(want)


def test_code_similarity_is_that_of_the_fingerprints(spark):
    from tallysieve.plans import fixtures as X

    df = X.with_code_fingerprint(X.with_parts(spark.createDataFrame([(f"lib{i % 2}-{i % 3}-{i}-{i % 5}",) for i in range(12)], "code string")))
    a, b = (df.select(*[F.col(c).alias(p + c) for c in ("code", "fp_words", "fp_size")]) for p in "ab")
    plain = FP.tanimoto("afp_words", "bfp_words", F.col("afp_size"), F.col("bfp_size"))
    both = a.crossJoin(b).select(plain.alias("x"), X.code_similarity("acode", "bcode").alias("y"))
    assert both.where("x <> y").count() == 0 and both.count() == 144


@pytest.mark.parametrize("tile", [7, 8192])
def test_fallback_pairs_brute_force(spark, monkeypatch, tile):
    df, rows = entities(spark, seed=11)
    anchors, binders = df.where(C.competition_sensitive(0.3)), df.where(C.competition_retained(0.4))
    covered = P.competition_pairs(anchors, binders, 0.75, 2.0, 1)
    plain = P.best_in_block
    monkeypatch.setattr(P, "best_in_block", lambda *a: plain(*a, tile_rows=tile, passing_rows=tile))
    monkeypatch.setattr(P, "split_hot_join", None)  # no join on single bits
    done = {r.negative_key for r in covered.collect()} if tile > 7 else set()
    if tile == 7:
        covered = covered.limit(0)
    pos = [rows[r.entity_key] for r in anchors.collect()]
    neg = [rows[r.entity_key] for r in binders.collect() if r.entity_key not in done]
    ratio = lambda e: np.log((e[2] + 0.5) / (e[3] + 0.5))
    want = set()
    for n in neg:
        found = []
        for p in pos:
            fold, sim, margin = max(p[2] / n[2], n[2] / p[2]), jaccard(p[6], n[6]), ratio(p) - ratio(n)
            if fold <= 2 and sim >= 0.3 and margin > 0:
                found.append((-sim, fold, -margin, p[0]))
        want |= {(f[3], n[0]) for f in sorted(found)[:1]}
    got = P.competition_pairs_fallback(anchors, binders, covered, 0.3).collect()
    assert {(r.positive_key, r.negative_key) for r in got} == want and want and len(got) == len(want)


def test_best_reference_equal_weighted_scores_are_ties(spark):
    """9/10 and 1.5 * 6/10 are equal; 6/10 * 1.5 falls short by a rounding."""
    df = spark.createDataFrame([("e", list(range(9)))], "entity_key string, fp_bits array<int>")
    references = [("low", [*range(9), 100], 1.0), ("wide", [*range(6), 200], 1.5)]
    assert S.best_reference(df, references).first()[1:] == (0.9, "wide")


def test_pairs_by_bins_equal_all_pairs_and_few_pass_the_bins(monkeypatch):
    import numpy as np
    from tallysieve.operators import similarity as S

    rng = np.random.default_rng(5)
    rows = lambda n: np.packbits(rng.random((n, 2048)) < 0.045, axis=1, bitorder="little").view("<i8")
    q, r = rows(400), rows(600)
    q[0] = r[0] = 0
    r[1:40] = q[1:40]
    want = S._jaccard(q, r)
    wide = []
    matrix = S._bit_matrix
    monkeypatch.setattr(S, "_bit_matrix", lambda words: wide.append(len(words)) or matrix(words))
    for least in (0.0, 0.05, 0.5, 1.0):
        asking = np.arange(0, 400, 2) if least == 0.5 else np.arange(400)
        found = S._jaccard_pairs(q)(r, asking, np.full(len(asking), least - 1e-6))
        got = {(a, b): s for part in found for a, b, s in zip(*part)}
        assert got == {(a, b): want[a, b] for a in asking for b in range(600) if want[a, b] >= least - 1e-6}
        if least == 0.5:
            wide.clear()
    assert not wide  # at a high similarity no full product is made


def test_bound_comes_from_several_groups_of_a_cell(spark):
    """One group in turn missed the nearest leaf of most queries."""
    import numpy as np
    from tallysieve.operators import metric as M, similarity as S

    rng = np.random.default_rng(7)
    base = rng.random((40, 2048)) < 0.045
    rows = [(i, (base[i % 40] ^ (rng.random(2048) < 0.001))) for i in range(800)]
    pack = lambda m: [int(x) for x in np.packbits(m, bitorder="little").view("<i8")]
    df = spark.createDataFrame([(i, "", pack(m), int(m.sum())) for i, m in rows], "id long, block string, vec array<long>, size int")
    index = M.Index.build(df, S.JACCARD, leaf_rows=8)
    home = index.at_home(df, 1.0, 1)
    bounds = [row.bound for row in index.tightened(home, 1).collect()]
    assert len(bounds) == 800
    assert np.mean(np.array(bounds) < 0.2) > 0.95


def test_matched_controls_broadcast_no_table_that_grows(spark, monkeypatch):
    from tallysieve.operators import matching as MT

    plans, plain = [], MT.materialise
    run = lambda df: (plain(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0]
    monkeypatch.setattr(MT, "materialise", run)
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = MT.matched_controls(df.where("id < 20"), df.where("id >= 20"), ["a", "b"], "id", 7).collect()
    rounds = [p for p in plans if "held_turn" in p]
    assert len(got) == 20 and rounds and not any("BroadcastHashJoin" in p for p in rounds)


def coded(spark, n, seed, alone=0):
    """Entities named by their code: parts are few, so that most share two with others; `alone` more share less."""
    from tallysieve.plans import fixtures as X

    rng = random.Random(seed)
    codes = {"lib%d-%d-%d-%d" % (s % 2, rng.randrange(4), rng.randrange(12), s) for s in (rng.randrange(12) for _ in range(n))}
    codes |= {f"lib{i % 2}-{50 + i}-{90 + i}-{70 + i}" for i in range(alone)}
    rows = [(c, c, rng.randint(1, 30), rng.randint(0, 9), rng.randint(0, 2), rng.randint(0, 5)) for c in sorted(codes)]
    df = spark.createDataFrame(rows, "entity_key string, code string, count_target int, count_competitor int, control_evidence int, historic_hits int")
    ready = materialise(X.with_code_fingerprint(X.with_parts(df)))
    return ready, {r.entity_key: r for r in ready.collect()}


@pytest.mark.parametrize("alone", [0, 3])
def test_broad_pairs_of_composed_fingerprints_compare_few_rows(spark, monkeypatch, alone):
    from tallysieve.plans import fixtures as X

    df, rows = coded(spark, 260, 12, alone)
    searched = []
    monkeypatch.setattr(P, "nearest_tanimoto", None)  # no search of the whole pool
    plain = P.nearest_of_few
    monkeypatch.setattr(P, "nearest_of_few", lambda q, *a: (searched.append(q.count()), plain(q, *a))[1])
    slim = materialise(df.drop("fp_bits", "fp_size", "fp_words"))
    positives, pool = "count_target > 22 or code like 'lib_-5_-%'", "count_target between 4 and 22 and code not like 'lib_-5_-%'"
    got = P.broad_pairs(slim.where(positives), slim.where(pool), slim.where("count_target <= 3"), made=X.CODE_PARTS).collect()
    near = {r.positive_key: (r.negative_key, r.similarity) for r in got if r.negative_source == "local_counter"}
    members = [r.entity_key for r in df.where(pool).collect()]
    asked = [r.entity_key for r in df.where(positives).collect()]
    compared = 0
    for p in asked:
        s, n = min((-jaccard(rows[p].fp_bits, rows[n].fp_bits), n) for n in members)
        if p in near:
            assert near[p] == (n, pytest.approx(-s))
            compared += 1
    assert compared > 10 and len(members) > 60
    assert sum(searched) < len(asked) / 3 and (not alone or sum(searched) >= alone)


def test_common_bits_with_other_parts(spark):
    from tallysieve.operators import composed as K
    from tallysieve.plans import fixtures as X

    df, rows = coded(spark, 60, 4)
    left, right = df.where("count_target > 15"), df.where("count_target <= 15")
    got = {r.entity_key: r for r in K.common_with_others(left, right, X.CODE_PARTS, held_parts=5, passing_rows=7).collect()}
    assert got.keys() == {r.entity_key for r in left.collect()}
    others = [r for r in right.collect()]
    for key, found in got.items():
        mine, bits = rows[key], set(rows[key].fp_bits)
        assert found.size == len(bits)
        for k, column in enumerate(X.CODE_PARTS.columns):
            part = lambda v: set(X.CODE_PARTS.bits(column, v).tolist())
            assert found.own[k] == len(part(mine[column]))
            assert found.others[k] == max((len(bits & part(o[column])) for o in others if o[column] != mine[column]), default=0)
            assert bool(found.abroad[k]) == any(o[column] == mine[column] and o.library != mine.library for o in others)


@pytest.mark.parametrize("tile_rows", [10, 40])
def test_search_over_several_tiles_and_turns(bits, monkeypatch, tile_rows):
    from tallysieve.operators import metric as M

    monkeypatch.setattr(M, "LEAST_TILE_ROWS", tile_rows)
    monkeypatch.setattr(M, "LEAST_ASK_ROWS", tile_rows)
    monkeypatch.setattr(M, "HELD_PAIRS", 50)
    df, data = bits
    distinct = materialise(S.distinct_fingerprints(df))
    ids = [r.entity_id for r in distinct.collect()]
    near = {(a, b): jaccard(data[a], data[b]) for a in ids for b in ids if a < b and jaccard(data[a], data[b]) >= 0.5}
    got = [(tuple(r[:2]), r[2]) for r in S.similar_pairs(distinct, 0.5, leaf_rows=4).collect()]
    assert len(got) == len(dict(got)) and dict(got) == pytest.approx(near)
    assert {r.entity_id: r.series_id for r in S.series_components(df, 0.5, leaf_rows=4).collect()} == plain_series(data, 0.5)
    left, right = df.where("entity_id < 40 or entity_id = 300"), df.where("entity_id between 40 and 299")
    found = {}
    for r in S.nearest_tanimoto(sided(left, "q_"), sided(right, "r_"), "q_", "r_", 3, "entity_id", leaf_rows=4).collect():
        found.setdefault(r.q_entity_id, []).append((r["rank"], r.r_entity_id))
    refs = [i for i in data if 40 <= i < 300]
    for q in [i for i in data if i < 40 or i == 300]:
        assert [r for _, r in sorted(found[q])] == sorted(refs, key=lambda r: (-jaccard(data[q], data[r]), r))[:3]


def test_queries_are_copied_by_tiles_not_by_groups(bits):
    """Each of many small groups in reach took a copy of a query."""
    from tallysieve.operators import metric as M

    df, _ = bits
    index = M.Index.build(M.side(df, "entity_id", "fp_words", "fp_size", None), S.JACCARD, leaf_rows=2)
    queries = M._queries(M.side(df, "entity_id", "fp_words", "fp_size", None))
    home = materialise(index.tightened(materialise(index.at_home(queries, 1.0, 1)), 1))
    groups = index.rows.select("cell", "group").distinct().count()
    asked, _ = index.asked(home.withColumn("bound", F.lit(1.0)))
    assert groups > 8 and asked.count() == home.count()


def test_fallback_of_composed_fingerprints_compares_a_library_for_few(spark, monkeypatch):
    from tallysieve.plans import fixtures as X

    df, _ = coded(spark, 260, 14, alone=4)
    df = materialise(df.withColumn("historic_hits", F.lit(0)).withColumn("count_target", F.when(F.col("code").like("lib_-5_-%"), 12).otherwise(F.col("count_target"))))
    df = materialise(df.withColumn("count_competitor", F.when(F.col("code").like("lib_-5_-%"), 9).otherwise(F.col("count_competitor"))))
    anchors, binders = df.where("count_competitor <= 2"), df.where("count_competitor >= 6")
    nobody = df.select(F.col("entity_key").alias("negative_key")).where("false")
    asked, plain = [], P.best_in_block
    monkeypatch.setattr(P, "best_in_block", lambda q, *a, **k: (asked.append(q), plain(q, *a, **k))[1])
    want = P.competition_pairs_fallback(anchors, binders, nobody, 0.15).collect()
    whole = asked.pop().count()
    slim = lambda side: side.drop("fp_bits", "fp_size", "fp_words")
    got = P.competition_pairs_fallback(slim(anchors), slim(binders), nobody, 0.15, made=X.CODE_PARTS).collect()
    assert sorted(got) == sorted(want) and len(got) > 40
    assert len(asked) == 2 and 4 <= asked[1].count() < whole / 2  # only those for which shared parts are not enough
    assert any(r.negative_key.startswith(("lib0-5", "lib1-5")) for r in got)


def test_coded_rows_meet_by_hash_and_others_stay_out(spark, monkeypatch):
    from tallysieve.operators.skew import may_meet
    from tallysieve.plans import fixtures as X

    df, _ = coded(spark, 200, 21, alone=30)
    left, right = df.where("count_target > 24"), df.where("count_target <= 24")
    want = P.shared_part_join(left, right, "l_", "r_", C.dominates("l_", "r_")).collect()
    sides, plain = [], P.split_hot_join
    monkeypatch.setattr(P, "split_hot_join", lambda l, r, *a: (sides.extend([l, r]), plain(l, r, *a))[1])
    got = P.shared_part_join(left, right, "l_", "r_", C.dominates("l_", "r_"), similarity=X.code_similarity("l_code", "r_code")).collect()
    fields = lambda rows: sorted((r.l_entity_key, r.r_entity_key, r.part_key, r.similarity) for r in rows)
    assert fields(got) == fields(want) and got
    # slim rows without the keys themselves, and none that meets nothing
    assert not {"part_key", "r_first"} & set(sides[1].columns)
    hashes = {(r.key_kind, r.key_hash) for r in sides[0].collect()}
    kept = [(r.key_kind, r.key_hash) for r in sides[1].collect()]
    assert hashes & set(kept) == {x for x in kept if x in hashes}
    assert len(kept) < 3 * right.count() and sum(x not in hashes for x in kept) < len(kept) / 4
    assert may_meet(sides[1], sides[0].limit(0), "key_hash").count() == 0
