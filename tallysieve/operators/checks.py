"""Data-quality checks as (check, violations) rows, one pass per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class CheckFailed(ValueError):
    """At least one check has violations."""


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Column set check before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    extra = [c for c in df.columns if c not in columns] if exact else []
    if missing or extra:
        raise CheckFailed(f"missing columns {missing}, unexpected columns {extra}")
    return df


def row_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """`rules[name]` is true on a bad row; counts bad rows of all rules in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(rows))


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def untrimmed(column: str) -> Column:
    return F.trim(F.col(column)) != F.col(column)


def not_finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def negative(column: str) -> Column:
    return F.col(column) < 0


def duplicates(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first per key."""
    keys = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def coverage(expected: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """Ids missing from and extra in `found`, as two checks."""
    from tallysieve.operators.ranking import coverage_gap

    gap = coverage_gap(expected, found, key).agg(
        F.count_if(F.col("gap") == "missing").alias("missing"), F.count_if(F.col("gap") == "extra").alias("extra")
    )
    return gap.select(
        F.inline(
            F.array(
                F.struct(F.lit(f"{name}_missing").alias("check"), F.col("missing").alias("violations")),
                F.struct(F.lit(f"{name}_extra").alias("check"), F.col("extra").alias("violations")),
            )
        )
    )


def outside(found: DataFrame, expected: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of `found` whose key is not in `expected`."""
    extra = found.join(expected.select(key).distinct(), key, "left_anti")
    return extra.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Shared keys whose values differ."""
    joined = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return joined.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def lookup_check(required: DataFrame, table: DataFrame, key: str, value: str, expected: str, name: str) -> DataFrame:
    """Required keys missing from a lookup, and keys where it disagrees."""
    joined = required.select(key, F.col(expected).alias("_e")).join(
        table.select(key, F.col(value).alias("_v"), F.lit(True).alias("_hit")), key, "left"
    )
    return row_checks(
        joined,
        {
            f"{name}_missing": F.col("_hit").isNull(),
            f"{name}_mismatch": F.col("_hit").isNotNull() & ~F.col("_v").eqNullSafe(F.col("_e")),
        },
    )


def pair_checks(pairs: DataFrame, panel_keys: DataFrame | None = None) -> DataFrame:
    """Self pairs, weights not above zero, duplicate pairs, panel overlap."""
    parts = [
        row_checks(
            pairs,
            {
                "pair_self": F.col("positive_key") == F.col("negative_key"),
                "pair_weight_not_positive": ~(F.col("pair_weight") > 0) | not_finite("pair_weight"),
            },
        ),
        duplicates(pairs, ["positive_key", "negative_key"], "pair_duplicate"),
    ]
    if panel_keys is not None:
        sides = pairs.select(F.explode(F.array("positive_key", "negative_key")).alias("entity_key"))
        hit = sides.join(panel_keys.select("entity_key").distinct(), "entity_key", "left_semi")
        parts.append(
            hit.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit("pair_in_blind_panel").alias("check"), "violations"
            )
        )
    return all_checks(parts)


def contiguous(ranges: DataFrame, total: Column, name: str = "range") -> DataFrame:
    """Shard ranges (start, stop) must follow on each other from 0 to total. One row per shard."""
    w = Window.partitionBy(F.lit(0)).orderBy("start")
    linked = ranges.withColumn("_before", F.coalesce(F.lag("stop").over(w), F.lit(0))).withColumn("_total", total)
    gaps = linked.agg(
        F.count_if(F.col("start") != F.col("_before")).alias("gaps"),
        F.when(F.max("stop") == F.max("_total"), 0).otherwise(1).cast("bigint").alias("short"),
    )
    return gaps.select(
        F.inline(
            F.array(
                F.struct(F.lit(f"{name}_gap").alias("check"), F.col("gaps").alias("violations")),
                F.struct(F.lit(f"{name}_total").alias("check"), F.col("short").alias("violations")),
            )
        )
    )


def same_identity(reports: DataFrame, column: str, name: str) -> DataFrame:
    """All runs or shards must carry one value."""
    return reports.agg((F.greatest(F.count_distinct(column), F.lit(1)) - 1).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def totals_match(counts: DataFrame, manifest: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Group totals equal those of a manifest, groups present on both sides."""
    a = counts.select(*keys, F.col(column).alias("_a"))
    b = manifest.select(*keys, F.col(column).alias("_b"))
    return a.join(b, list(keys), "full").agg(
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("violations")
    ).select(F.lit(name).alias("check"), "violations")


def reproduces(metrics: DataFrame, saved: DataFrame, atol: float = 1e-8, rtol: float = 1e-5, name: str = "metric") -> DataFrame:
    """(metric, value) rows within tolerance of the saved report."""
    joined = metrics.select("metric", F.col("value").alias("_a")).join(
        saved.select("metric", F.col("value").alias("_b")), "metric", "full"
    )
    close = F.abs(F.col("_a") - F.col("_b")) <= atol + rtol * F.abs(F.col("_b"))
    return joined.agg(F.count_if(~F.coalesce(close, F.lit(False))).alias("violations")).select(
        F.lit(f"{name}_not_reproduced").alias("check"), "violations"
    )


def score_drift(a: DataFrame, b: DataFrame, tolerance: float, key: str = "catalog_id", score: str = "score") -> DataFrame:
    """Rows whose score moved by more than the tolerance."""
    joined = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key)
    return joined.agg(F.count_if(F.abs(F.col("_a") - F.col("_b")) > tolerance).alias("violations")).select(
        F.lit("score_drift").alias("check"), "violations"
    )


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-independent digest of a table: row count plus xor and sum of row hashes."""
    text = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    number = F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")
    return df.select(number.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("digest_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
    )


def submission_checks(ids: DataFrame, key: str = "catalog_id", size: int = 50) -> DataFrame:
    """Exactly `size` unique non-empty ids."""
    return ids.agg(
        F.abs(F.count(F.lit(1)) - size).alias("wrong_size"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated"),
        F.count_if(blank(key)).alias("empty"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"submission_{n}").alias("check"), F.col(n).alias("violations"))
                    for n in ("wrong_size", "repeated", "empty")
                ]
            )
        )
    )


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    cast = [p.select("check", F.col("violations").cast("bigint").alias("violations")) for p in parts]
    return reduce(DataFrame.unionByName, cast)


def assert_ok(checks: DataFrame) -> None:
    """Raise when any check has violations (one row per check reaches the driver)."""
    failed = checks.where("violations > 0").collect()
    if failed:
        raise CheckFailed(", ".join(f"{r['check']}: {r['violations']}" for r in failed))
