"""Session helpers: a tuned local builder and the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallysieve", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed.

    Python tasks import its modules. Spark's own file server hands the archive out.
    """
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # on the driver, which serves the file
        archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; invent one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Write an expensive intermediate once to the shared checkpoint folder and read it from there.

    For tables that several branches of one job use: column pruning makes the branches
    differ, so Spark would compute each from the source again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """Write a large intermediate as Parquet to the shared checkpoint folder and read it from there.

    Several times smaller than `materialise`, whose rows are not compressed unless the cluster says so, and its
    size on disk tells Spark how to join it. The files stay until the checkpoint folder is cleared.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a table that grows with the input as one never to broadcast.

    Spark guesses the size of derived tables from their source's files and takes exploded or aggregated ones for small.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the input has fewer splits than the cluster has cores.

    For CPU-heavy row work on a small table kept in a few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Keep all shuffle partitions for CPU-heavy row work.

    Adaptive execution merges small partitions by bytes; an explicit partition number is
    left alone, and the exchange replaces the one below when the keys agree.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
