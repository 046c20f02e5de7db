"""Sources, sinks, checks, nested data, contacts, streams, split and ranking rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallysieve.operators import checks as V
from tallysieve.operators import nested as G
from tallysieve.operators import ranking as R
from tallysieve.operators import splits as L
from tallysieve.plans import fixtures as X
from tallysieve.plans import registry
from tallysieve.sources import inventory as I
from tallysieve.sources import tables as T
from tallysieve.streaming import incremental as ST


def violations(df):
    return {r["check"]: r.violations for r in df.collect()}


def test_ranking_order_and_checks(spark):
    panel = spark.createDataFrame([("B",), ("A",), ("C",)], "catalog_id string")
    scores = spark.createDataFrame([("C", -3.0), ("B", -1.0), ("A", -1.0)], "catalog_id string, score double")
    assert [r.catalog_id for r in T.merge_scores(scores, panel).collect()] == ["A", "B", "C"]
    for bad in (scores.limit(2), scores.withColumn("score", F.lit(float("nan"))), scores.withColumn("catalog_id", F.lit("A"))):
        with pytest.raises(V.CheckFailed):
            T.merge_scores(bad, panel)


def test_panel_read_write_and_refuse_overwrite(spark, tmp_path):
    path = str(tmp_path / "panel.csv")
    (tmp_path / "panel.csv").write_text("catalog_id,entity_key\nC1,a\nC2,b\nC2, c\n")
    found = violations(T.panel_checks(T.read_panel(spark, path, check=False)))
    assert found["panel_duplicate_id"] == 1 and found["panel_untrimmed"] == 1
    with pytest.raises(V.CheckFailed):
        T.read_panel(spark, path)
    (tmp_path / "other.csv").write_text("id,entity_key\nC1,a\n")
    with pytest.raises(V.CheckFailed):
        T.read_panel(spark, str(tmp_path / "other.csv"))
    out = str(tmp_path / "out.parquet")
    T.write_table(spark.range(3), out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        T.write_table(spark.range(3), out)
    ids = spark.range(60).select(F.format_string("C%02d", "id").alias("catalog_id"), F.col("id").cast("double").alias("score"))
    T.write_top_ids(ids, str(tmp_path / "ids"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()]
    assert lines[0] == "C59" and len(lines) == 50
    with pytest.raises(V.CheckFailed):
        T.write_top_ids(ids.limit(20), str(tmp_path / "few"))
    assert T.read_scores(spark, str(tmp_path / "absent.csv"), "score").count() == 0
    (tmp_path / "scores.csv").write_text("catalog_id,score\nC1,1.5\nC2,oops\n")
    assert T.read_scores(spark, str(tmp_path / "scores.csv"), "score", check=False).count() == 2
    with pytest.raises(V.CheckFailed):
        T.read_scores(spark, str(tmp_path / "scores.csv"), "score")


def test_entity_hook_keeps_failures_as_rows(spark):
    def canonical(text):
        if text == "bad":
            raise ValueError("no key")
        return text.upper(), text[:1]

    got = T.with_entity_keys(spark.createDataFrame([("ab",), ("bad",), (" ",), (None,)], "t string"), "t", canonical).collect()
    assert [r.status for r in got] == ["ok", "failed", "blank", "blank"]
    assert got[0].entity_key == "AB" and "no key" in got[1].error


def test_inventory_and_duplicates(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    source = next((tmp_path / "a").glob("part-*.parquet"))
    (tmp_path / "line_1.parquet").write_bytes(source.read_bytes())
    (tmp_path / "line_2.parquet").write_bytes(source.read_bytes())
    (tmp_path / "broken.parquet").write_bytes(b"nothing")
    found = I.inventory(spark, str(tmp_path), [("line", "lines")], "[lb]*.parquet").collect()
    by = {r.file_name: r for r in found}
    assert by["broken.parquet"].error and by["line_1.parquet"].rows == 5 and by["line_1.parquet"].family == "lines"
    twins = I.duplicate_files(I.list_files(spark, str(tmp_path), "[lb]*.parquet")).collect()
    assert len({t.path for t in twins}) == 2 and len({t.sha256 for t in twins}) == 1 and all(t.files == 2 for t in twins)
    files = I.list_files(spark, str(tmp_path), "line*.parquet")
    recorded = spark.createDataFrame(I.digests(files).select("path", "sha256").collect())
    assert I.verify_digests(files, recorded).count() == 0
    stats = I.column_stats(spark.read.parquet(str(tmp_path / "line_1.parquet")), "id", ["id"], ["id"]).first()
    assert stats.distinct_keys == 5 and stats.max_id == 4 and stats.counts_id["0"] == 1


def test_stream_resume_and_counters(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(10).coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    run = lambda: T and ST.ingest(
        ST.stream_parts(spark, str(folder), schema), lambda d: d.withColumn("x", F.col("id") * 2),
        str(tmp_path / "out"), str(tmp_path / "state"),
    ).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(str(folder))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_streamed_coverage_equals_batch(spark, sf):
    got = registry.load()[0]["stream_coverage"](spark, sf)
    want = X.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    assert {(r.user_id, r.events) for r in got.collect()} == {(r.user_id, r.events) for r in want.collect()}


def test_contacts_brute_force(spark):
    rng = random.Random(6)
    rows = [("s%d" % (i % 2), "A", i, i, rng.choice(["protein", "protein", "ligand"]), *[rng.uniform(-6, 6) for _ in range(3)]) for i in range(80)]
    atoms = spark.createDataFrame(rows, "structure string, chain string, residue long, atom long, role string, x double, y double, z double")
    got = {(r.structure, r.ligand_residue, r.residue): r.min_distance for r in G.contacts(atoms, 4.0).collect()}
    want = {}
    for a in rows:
        for b in rows:
            d = math.dist(a[5:], b[5:])
            if a[0] == b[0] and a[4] == "protein" and b[4] == "ligand" and d <= 4.0:
                want[(a[0], b[2], a[2])] = round(d, 3)
    assert got == want
    union = G.contact_union(G.contacts(atoms, 4.0), 2.0).collect()
    assert {r.residue for r in union} == {k[2] for k in want}
    subsites = spark.createDataFrame([(k[2], "core") for k in want], "residue long, subsite string").distinct()
    assert G.subsite_contacts(G.contacts(atoms, 4.0), subsites).where("subsite = 'core'").count() == 2


def test_batches_keep_or_drop_single_tails(spark):
    df = spark.range(65).select(F.lit(0).alias("g"), "id")
    sizes = lambda tail: sorted(r["count"] for r in R.assign_batches(df, ["g"], ["id"], 32, tail).groupBy("batch").count().collect())
    assert sizes("merge") == [32, 33] and sizes("drop") == [32, 32]


def test_shard_of_inverts_bounds(spark):
    total, shards = 103, 7
    bounds = spark.range(1).select(F.inline(L.shard_bounds(F.lit(total), shards))).collect()
    got = {r.id: r.s for r in spark.range(total).select("id", L.shard_of(F.col("id"), F.lit(total), shards).alias("s")).collect()}
    assert all(got[i] == b.shard for b in bounds for i in range(b.start, b.stop))
    ranges = spark.createDataFrame(bounds)
    assert set(violations(V.contiguous(ranges, F.lit(total))).values()) == {0}
    assert violations(V.contiguous(ranges.where("shard <> 3"), F.lit(total)))["range_gap"] == 1


def test_selection_rules(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3 if i < 6 else 0], float(-i)) for i in range(12)], "catalog_id long, g string, score double")
    order = [F.desc("score"), F.asc("catalog_id")]
    chosen = [r.catalog_id for r in R.select_diverse(rows, "g", 2, 5, order).orderBy(*order).collect()]
    assert chosen == [0, 1, 2, 3, 4]
    history = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7), ("r", 4, float("nan"))], "run string, epoch int, m double")
    assert R.best_epoch(history, ["run"], "m").first().epoch == 2
    flags = [r.improved for r in R.improvements(history, ["run"], "m").orderBy("epoch").collect()]
    assert flags == [True, False, False, False]


def test_digest_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 3)
    a = V.content_digest(df, ["id", "x"]).first()
    assert a == V.content_digest(df.orderBy(F.desc("id")).repartition(3), ["id", "x"]).first()
    assert a != V.content_digest(df.where("id > 0"), ["id", "x"]).first()


def test_same_result_for_other_partition_counts(spark, sf):
    build = registry.load()[0]["matched_pairs"]
    first = sorted(map(tuple, build(spark, sf).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, build(spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scan_is_pruned_and_partially_aggregated(spark, sf):
    plan = X.dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
    counts = X.dedup(spark, sf).drop("code")._jdf.queryExecution().executedPlan().toString()
    assert counts.count("HashAggregate") == 2 and counts.count("Exchange") == 1
    top = R.head_per_group(X.dedup(spark, sf), ["historic_hits"], ["entity_key"], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_zip_lines(spark, tmp_path):
    import zipfile

    from tallysieve.sources import tables as T

    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.writestr("a.csv", f"{name},1\r\nlast,é")
            archive.writestr("empty.csv", "")
            archive.writestr("other.csv", "no")
    rows = T.zip_lines(spark, str(tmp_path / "*.zip"), ["a.csv", "empty.csv", "missing.csv"]).collect()
    got = sorted((r.archive.rsplit("/", 1)[1], r.member, r.line_no, r.line) for r in rows)
    assert got == [(f"{n}.zip", "a.csv", k, line) for n in ("one", "two") for k, line in ((0, f"{n},1"), (1, "last,é"))]


def test_reports_stay_small(spark, tmp_path, monkeypatch):
    import pytest

    from tallysieve.operators.checks import CheckFailed
    from tallysieve.sources import tables as T

    T.write_report(spark.range(3), str(tmp_path / "r"))
    assert T.read_report(spark, str(tmp_path / "r"), "id long").count() == 3
    monkeypatch.setattr(T, "REPORT_ROWS", 2)
    with pytest.raises(CheckFailed):
        T.write_report(spark.range(3), str(tmp_path / "s"))


def test_pairing_in_turn_leaves_nobody_out(spark):
    from tallysieve.operators.models import paired_in_turn

    left = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 9)], "g string, l long")
    right = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(4)], "g string, r long")
    rows = paired_in_turn(left, right, ["g"], "l", "r").collect()
    assert len(rows) == 7 + 4
    assert {(r.g, r.l) for r in rows} == {("a", i) for i in range(7)} | {("b", 9)}
    assert {(r.g, r.r) for r in rows} == {("a", i) for i in range(3)} | {("b", i) for i in range(4)}


def test_pairing_in_turn_keeps_one_sided_groups(spark):
    from tallysieve.operators.models import paired_in_turn

    left = spark.createDataFrame([("a", 0), ("a", 1), ("c", 2), (None, 3)], "g string, l long")
    right = spark.createDataFrame([("a", 0), *[("d", k) for k in range(1, 8)], (None, 8)], "g string, r long")
    rows = paired_in_turn(left, right, ["g"], "l", "r").collect()
    assert {r.l for r in rows} == set(range(4)) and {r.r for r in rows} == set(range(9))
    assert {(r.g, r.r) for r in rows} >= {("d", k) for k in range(1, 8)} and len(rows) == 2 + 2 + 8
    assert paired_in_turn(left, right.limit(0), ["g"], "l", "r").count() == 0


def test_benchmark_runs_as_many_permutations_as_permutation_p(monkeypatch):
    from tallysieve.plans import queries_metrics as Q

    asked = []
    monkeypatch.setattr(Q.X, "labelled", lambda spark, sf: None)
    monkeypatch.setattr(Q.M, "benchmark", lambda df, replicates, *rest: asked.append(replicates))
    Q.benchmark_metrics(None, "")
    assert asked == [10_000]


def test_contacts_get_more_tasks_as_pairs_grow(spark, monkeypatch):
    from tallysieve.operators import nested as G

    rows = [(1, "A", i, "protein" if i % 2 else "ligand", (i % 7) * 0.3, (i % 5) * 0.3, 0.0) for i in range(80)]
    atoms = spark.createDataFrame(rows, "structure long, chain string, residue long, role string, x double, y double, z double")
    plain = {tuple(r) for r in G.contacts(atoms, 1.0).collect()}
    monkeypatch.setattr(G, "PAIRS_OF_A_TASK", 50)
    found = G.contacts(atoms, 1.0)
    assert {tuple(r) for r in found.collect()} == plain and found.rdd.getNumPartitions() > 8
