"""Reading and writing tables: Parquet, panel CSVs, score chunks, ranked outputs."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysieve.functions import columns as C
from tallysieve.operators import checks as V
from tallysieve.operators import ranking as R

PANEL_SCHEMA = "catalog_id string, entity_key string"


def scan_table(spark: SparkSession, *paths: str, columns: Sequence[str] = ()) -> DataFrame:
    """One file, several parts or a glob; only the asked columns are read."""
    df = spark.read.parquet(*paths)
    return df.select(*V.require_columns(df, columns).select(*columns).columns) if columns else df


def scan_batches(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str):
    """Column-pruned batches through a pandas function."""
    return df.mapInPandas(run, schema)


def zip_lines(spark: SparkSession, path: str, members: Sequence[str]) -> DataFrame:
    """(archive, member, line_no, line): text lines of the named members of zip archives.

    Archives are read and unpacked on the executors, from any store that Spark reads; a glob or
    folder spreads over tasks by archive.
    """
    wanted = set(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    for member in sorted(wanted & set(opened.namelist())):
                        with opened.open(member) as lines:
                            text = enumerate(line.rstrip("\r\n") for line in io.TextIOWrapper(lines, "utf-8"))
                            while block := list(itertools.islice(text, 50_000)):
                                found = pd.DataFrame(block, columns=["line_no", "line"])
                                yield found.assign(archive=archive, member=member)[["archive", "member", "line_no", "line"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, line_no long, line string")


def read_panel(
    spark: SparkSession, path: str, header: Sequence[str] = ("catalog_id", "entity_key"), check: bool = True
) -> DataFrame:
    """Panel CSV with exactly this header; columns are renamed to catalog_id, entity_key.

    Repeated, blank or untrimmed ids and keys are refused, unless `check` is off.
    """
    found = spark.read.option("header", True).csv(path).columns
    if list(found) != list(header):
        raise V.CheckFailed(f"panel header {found}, expected {list(header)}")
    panel = spark.read.option("header", True).schema(PANEL_SCHEMA).csv(path)
    if check:
        V.assert_ok(panel_checks(panel))
    return panel


def panel_checks(panel: DataFrame) -> DataFrame:
    """Ids and keys unique, non-blank, trimmed."""
    return V.all_checks(
        [
            V.duplicates(panel, ["catalog_id"], "panel_duplicate_id"),
            V.duplicates(panel, ["entity_key"], "panel_duplicate_key"),
            V.row_checks(
                panel,
                {
                    "panel_blank": V.blank("catalog_id") | V.blank("entity_key"),
                    "panel_untrimmed": V.untrimmed("catalog_id") | V.untrimmed("entity_key"),
                },
            ),
        ]
    )


def read_scores(
    spark: SparkSession, path: str | None, column: str, key: str = "catalog_id", check: bool = True
) -> DataFrame:
    """(catalog_id, score) from CSV; a missing optional file is an empty source.

    Repeated ids and scores that are malformed or not finite are refused, unless `check` is off.
    """
    empty = spark.createDataFrame([], "catalog_id string, score double")
    if path is None:
        return empty
    try:
        df = spark.read.option("header", True).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    V.require_columns(df, [key, column])
    scores = df.select(F.trim(key).alias("catalog_id"), F.col(column).try_cast("double").alias("score"))
    if check:
        V.assert_ok(score_checks(scores))
    return scores


def score_checks(scores: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    parts = [
        V.duplicates(scores, ["catalog_id"], "score_duplicate_id"),
        V.row_checks(scores, {"score_not_finite": V.not_finite("score")}),
    ]
    if panel is not None:
        parts.append(V.outside(scores, panel, "catalog_id", "score_outside_panel"))
    return V.all_checks(parts)


def read_chunks(spark: SparkSession, pattern: str, columns: Sequence[str], schema: str | None = None) -> DataFrame:
    """All chunk files of a pattern, CSV or Parquet, with an exact column set."""
    if pattern.endswith(".parquet"):
        df = spark.read.parquet(pattern)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(pattern)
    return V.require_columns(df, columns, exact=True)


def merge_scores(chunks: DataFrame, panel: DataFrame, key: str = "catalog_id") -> DataFrame:
    """Checked full ranking: every panel id once, finite scores, best first, ties by id."""
    V.assert_ok(
        V.all_checks([score_checks(chunks), V.coverage(panel, chunks, key, "panel")])
    )
    return chunks.orderBy(F.desc("score"), key)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """zstd Parquet; the commit protocol makes it atomic, an existing target is an error."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_ranked(df: DataFrame, path: str, score: str = "score", key: str = "catalog_id") -> None:
    df.orderBy(F.desc(score), key).write.mode("errorifexists").option("header", True).csv(path)


def write_top_ids(df: DataFrame, path: str, size: int = 50, score: str = "score", key: str = "catalog_id") -> None:
    """Exactly `size` unique non-empty ids, best first, one per line."""
    top = R.top_k(df, size, score, key)
    V.assert_ok(V.submission_checks(top, key, size))
    ordered = top.orderBy(F.desc(score), key).select(F.col(key).cast("string").alias("value"))
    ordered.coalesce(1).write.mode("errorifexists").text(path)  # `size` lines


REPORT_ROWS = 100_000


def write_report(df: DataFrame, path: str) -> None:
    """Small report table as JSON lines, one file; larger tables belong in write_table."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise V.CheckFailed(f"a report has at most {REPORT_ROWS} rows")
    df.coalesce(1).write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("entity_key", T.StringType()),
        T.StructField("group_key", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def with_entity_keys(df: DataFrame, column: str, canonical: Callable[[str], tuple[str, str]]) -> DataFrame:
    """Run a user's key function on a text column; failures become status rows.

    `canonical(text)` returns (entity_key, group_key) or raises. Each distinct text of an
    Arrow batch is computed once.
    """

    def one(text) -> tuple:
        if text is None or not str(text).strip():
            return (None, None, "blank", None)
        try:
            entity, group = canonical(text)
        except Exception as error:  # a bad row is data, not a failed job
            return (None, None, "failed", f"{type(error).__name__}: {error}")
        return (entity, group, "ok", None)

    def run(batch: pd.Series) -> pd.DataFrame:
        known = {text: one(text) for text in batch.unique()}
        return pd.DataFrame([known[t] for t in batch], columns=ENTITY_SCHEMA.names)

    udf = F.pandas_udf(run, ENTITY_SCHEMA)
    return df.withColumn("_k", udf(F.col(column))).select("*", "_k.*").drop("_k")
