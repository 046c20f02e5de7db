"""Evidence rules on literal frames with hand-computed values."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.functions import fingerprints as FP
from tallysieve.functions.hashing import hash_bucket
from tallysieve.operators import evidence as E


def test_code_parts_strict_and_loose(spark):
    rows = spark.createDataFrame(
        [("L3-172-977-552",), ("L13-20-159-91",), ("L1-2-3",), ("L1-2-3-4-5",), ("L1--3-4",)], "code string"
    )
    got = rows.select("code", C.code_fields("code").alias("s"), C.code_fields_loose("code").alias("l")).collect()
    by = {r.code: r for r in got}
    assert by["L3-172-977-552"].s == ["L3", "172", "977", "552"]
    assert by["L1-2-3"].s is None and by["L1-2-3"].l is None
    assert by["L1-2-3-4-5"].s is None and by["L1-2-3-4-5"].l[3] == "4-5"
    assert by["L1--3-4"].s is None
    keys = rows.limit(1).withColumns(C.part_columns(C.code_fields("code"))).first()
    assert (keys.k12, keys.k13, keys.k23) == ("L3:172:977", "L3:172:552", "L3:977:552")


INTERVAL_ROWS = [
    # rows, supp rows, target, competitor, control, supplement, history
    (1, 1, 20, 10, 0, 0, 0),
    (1, 1, 20, 0, 0, 0, 0),
    (1, 1, 4, 0, 0, 0, 0),
    (1, 1, 20, 0, 20, 0, 0),
    (1, 1, 20, 0, 0, 0, 9),
]
SCHEMA = (
    "source_rows int, supplement_rows int, count_target int, count_competitor int, count_control int, "
    "count_control_supplement int, historic_hits int"
)


def test_zero_control_is_never_evidence(spark):
    rows = spark.createDataFrame(INTERVAL_ROWS, SCHEMA)
    got = E.with_observed_evidence(rows).collect()
    assert got[0].proxy_0 == pytest.approx(math.log1p(20) - math.log1p(10))
    assert got[0].confidence_0 == pytest.approx(0.5 * 10 / 15)
    assert all(r.confidence_0 == 0 and r.proxy_0 == 0 for r in got[1:])
    assert got[3].confidence_1 == pytest.approx(0.5 * 20 / 25)


def test_interval_caps(spark):
    rows = E.with_observed_evidence(spark.createDataFrame(INTERVAL_ROWS, SCHEMA))
    none = E.with_intervals(rows, 0).collect()
    assert [r.interval_confidence_0 for r in none] == [r.confidence_0 for r in none]
    five = E.with_intervals(rows, 5).collect()
    assert five[1].upper_0 == pytest.approx(math.log1p(20))
    assert five[1].lower_0 == pytest.approx(math.log1p(20) - math.log1p(5))
    assert five[1].interval_confidence_0 == pytest.approx(0.025)
    assert five[2].interval_confidence_0 == 0  # target below five
    assert five[3].interval_confidence_0 == pytest.approx(0.025 / 2)  # background equals target
    assert five[4].interval_confidence_0 == pytest.approx(0.0025)
    assert all(r.lower_0 <= r.upper_0 for r in five)
    with pytest.raises(ValueError):
        C.evidence_intervals(2)


def test_bad_counts_fail(spark):
    rows = spark.createDataFrame([(1, 1, -5, 0, 0, 0, 0)], SCHEMA)
    with pytest.raises(Exception, match="negative or non-finite"):
        E.with_observed_evidence(rows).collect()


def test_dedup_sums_and_stouffer(spark):
    rows = spark.createDataFrame(
        [
            ("a", "c2", 2, 1, 0, 1.0, 2.0, 3.0, 1),
            ("a", "c1", 4, 0, 5, 3.0, 2.0, 1.0, 7),
            ("b", "c3", 1, 1, 1, 0.5, None, 0.0, 0),
            ("", "c4", 9, 9, 9, 0.0, 0.0, 0.0, 9),
            (None, "c5", 9, 9, 9, 0.0, 0.0, 0.0, 9),
        ],
        "entity_key string, code string, count_target int, count_competitor int, count_control int, z_target double, "
        "z_competitor double, z_control double, historic_hits int",
    )
    got = {r.entity_key: r for r in E.dedup_evidence(rows).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].code, got["a"].source_rows, got["a"].count_target, got["a"].historic_hits) == ("c1", 2, 6, 7)
    assert got["a"].z_target == pytest.approx(4 / math.sqrt(2))
    assert got["b"].z_competitor == 0


def test_split_bucket_equals_python(spark):
    groups = [f"g{i}" for i in range(200)]
    rows = spark.createDataFrame([(g,) for g in groups], "g string")
    got = {r.g: r.b for r in rows.select("g", hash_bucket("g", "salt:").alias("b")).collect()}
    for g in groups:
        digest = hashlib.sha256(f"salt:{g}".encode()).digest()
        assert got[g] == int.from_bytes(digest[:8], "little") % 1000


def test_pair_rules(spark):
    rows = spark.createDataFrame(
        [(5, 0, 0, 3, 1, 0), (5, 0, 0, 3, 0, 0), (3, 0, 0, 3, 1, 0), (5, 2, 0, 3, 1, 0)],
        "positive_count_target int, positive_count_competitor int, positive_control_evidence int, "
        "negative_count_target int, negative_count_competitor int, negative_control_evidence int",
    )
    got = rows.select(C.dominates().alias("d"), C.pair_class().alias("c")).collect()
    assert [r.d for r in got] == [True, False, False, False]
    assert [r.c for r in got] == [
        "control_confirmed_dominance", "target_dominance_without_control_confirmation", None, None,
    ]


def test_packed_words_round_trip(spark):
    bits = [0, 1, 63, 64, 500, 2047]
    row = spark.createDataFrame([(bits, [1, 63, 65])], "a array<int>, b array<int>").select(
        FP.pack_words("a").alias("wa"), FP.pack_words("b").alias("wb"), "a", "b"
    )
    got = row.select(
        "wa", FP.common_bits("wa", "wb").alias("k"), FP.tanimoto("wa", "wb", F.size("a"), F.size("b")).alias("t"),
        FP.tanimoto_bits("a", "b").alias("tb"),
    ).first()
    restored = [w * 64 + i for w, v in enumerate(got.wa) for i in range(64) if (v >> i) & 1]
    assert restored == bits and got.k == 2 and got.t == pytest.approx(2 / 7) == got.tb
    packed = spark.createDataFrame([(bytearray([0b00000101, 0b10000000]),)], "p binary")
    assert packed.select(FP.unpack_bytes("p").alias("u")).first().u == [0, 2, 15]


def test_small_functions(spark):
    row = spark.createDataFrame([("3;5;9", [1, 2, 3], [2, 3, 4])], "t string, a array<int>, b array<int>")
    got = row.select(
        C.integer_set("t").alias("s"), C.join_list("a").alias("j"), C.jaccard("a", "b").alias("i"),
        C.multi_part_valid("t", lambda x: x.rlike("^[0-9]+$")).alias("v"), C.softplus(F.lit(800.0)).alias("p"),
        C.softplus(F.lit(-800.0)).alias("q"), C.count_fold(F.lit(4), F.lit(8)).alias("f"),
    ).first()
    assert (got.s, got.j, got.i, got.v, got.p, got.q, got.f) == ([3, 5, 9], "1;2;3", 0.5, True, 800.0, 0.0, 2.0)


def test_coverage_on_four_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, 0, 0, 0, 0), (1, 1, 10, 1, 0, 1, 0), (2, 1, 40, 2, 0, 0, 0), (1, 1, 10, 10, 2, 0, 1)], SCHEMA
    ).withColumn("split", F.lit("train"))
    got = {(r.mark, r.support): r.entities for r in E.evidence_coverage(rows).collect()}
    bands = {r.band: r.entities for r in E.target_bands(rows).collect()}
    assert (got["every", 0], got["merged", 0], bands["le1"], bands["ge20"]) == (4, 1, 1, 1)
    assert (got["competitor_seen", 0], got["background_seen", 0], got["two_sided", 0]) == (3, 2, 2)
    assert got["held", 5] == 1 and got["displaced_calm", 10] == 2
    parts = E.merge_partials([E.manifest_counts(rows.limit(4)), E.manifest_counts(rows.limit(4))], ["split"]).first()
    assert parts.entities == 8
