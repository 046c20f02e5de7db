"""Incremental ingest and counters on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_parts(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parts of a folder as a stream; the checkpoint remembers finished parts across restarts."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def ingest(parts: DataFrame, transform, out: str, checkpoint: str) -> StreamingQuery:
    """Append transformed parts to a Parquet table exactly once; a rerun takes only new parts."""
    return (
        transform(parts)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counters(parts: DataFrame, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Streaming counters; group keys are few (splits, types), so state stays small."""
    return parts.groupBy(*by).agg(*aggregates)


def write_latest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode result of each trigger replaces the table at `out/<epoch>`; readers take the newest.

    Rewriting an epoch after a failure is idempotent.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch:010d}")

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    table = spark.read.parquet(out)
    newest = table.agg(F.max("epoch")).scalar()
    return table.where(F.col("epoch") == newest).drop("epoch")
