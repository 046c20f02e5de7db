"""Inventory of data files: footers, schema groups, duplicates, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.operators.skew import split_hot_lookup
from tallysieve.session import materialise

FOOTER_SCHEMA = (
    "path string, file_name string, size_bytes bigint, rows bigint, row_groups int, columns array<string>, "
    "schema_signature string, error string"
)
CHUNK = 8 << 20


def _open(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return system, local


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, size_bytes) of matching files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"))


def footers(files: DataFrame) -> DataFrame:
    """Row counts and schema signature from the file footers; unreadable files keep their error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size_bytes"]):
                row = {"path": path, "file_name": path.rsplit("/", 1)[-1], "size_bytes": size}
                try:
                    system, local = _open(path)
                    with system.open_input_file(local) as handle:
                        opened = pq.ParquetFile(handle)
                        fields = [(f.name, str(f.type)) for f in opened.schema_arrow]
                        row |= {
                            "rows": opened.metadata.num_rows,
                            "row_groups": opened.metadata.num_row_groups,
                            "columns": [name for name, _ in fields],
                            "schema_signature": hashlib.sha256(json.dumps(fields).encode()).hexdigest()[:12],
                            "error": None,
                        }
                except Exception as error:  # keep the failure in the report
                    row |= {"rows": None, "row_groups": None, "columns": None, "schema_signature": None, "error": repr(error)}
                rows.append(row)
            frame = pd.DataFrame(rows)
            frame["rows"] = frame["rows"].astype("Int64")
            frame["row_groups"] = frame["row_groups"].astype("Int32")
            yield frame

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores, "path").mapInPandas(run, FOOTER_SCHEMA)


def family(file_name, rules: Sequence[tuple[str, str]], default: str = "other"):
    """Family of a file by the first matching name prefix."""
    result = F.lit(default)
    for prefix, name in reversed(list(rules)):
        result = F.when(file_name.startswith(prefix), name).otherwise(result)
    return result


def inventory(spark: SparkSession, folder: str, rules: Sequence[tuple[str, str]] = (), pattern: str = "*.parquet"):
    found = footers(list_files(spark, folder, pattern))
    return found.withColumn("family", family(F.col("file_name"), rules))


def column_stats(df: DataFrame, key: str, numeric: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Per source file: null and distinct keys, min/max/mean of numbers; label counts as a map."""
    # a native column read keeps the file name available after projection
    named = df.withColumn("file", F.input_file_name())
    stats = named.groupBy("file").agg(
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_distinct(key).alias("distinct_keys"),
        *[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )
    for label in labels:
        counts = named.groupBy("file", F.col(label).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        as_map = counts.where("v is not null").groupBy("file").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias(f"counts_{label}")
        )
        stats = stats.join(as_map, "file", "left")
    return stats


def schema_groups(found: DataFrame) -> DataFrame:
    return found.where("error is null").groupBy("schema_signature").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.min("path").alias("example")
    )


def family_totals(found: DataFrame) -> DataFrame:
    return found.where("error is null").groupBy("family").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")
    )


def digests(files: DataFrame) -> DataFrame:
    """SHA-256 per file, read in bounded chunks inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = []
            for path in batch["path"]:
                system, local = _open(path)
                digest = hashlib.sha256()
                with system.open_input_stream(local) as handle:
                    while block := handle.read(CHUNK):
                        digest.update(block)
                result.append(digest.hexdigest())
            yield batch.assign(sha256=result)

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "size_bytes").repartition(cores, "path").mapInPandas(
        run, "path string, size_bytes bigint, sha256 string"
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """(sha256, path, files): the members of each group of equal files, a row each; only files that share their size are hashed."""
    shared = files.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size_bytes")
    same = materialise(digests(files.join(shared, "size_bytes", "left_semi")).select("sha256", "path"))
    groups = same.groupBy("sha256").agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    # one digest (of empty files, say) may have most of the rows
    return split_hot_lookup(same, groups, ["sha256"], "path", "files")


def verify_digests(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded (path, sha256) rows whose file is gone or has changed."""
    now = digests(files.join(recorded.select("path"), "path", "left_semi"))
    return recorded.join(now.select("path", F.col("sha256").alias("found")), "path", "left").where(
        "found is null or found <> sha256"
    )
