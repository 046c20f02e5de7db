"""Shared folder, carried rows and partition counts of the operators in this folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.session import ensure_checkpoint_dir

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stash-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row, or the named columns of it, as one column: whatever they are called, they meet no other name."""
    return F.struct(*[df[f"`{c}`"] for c in (df.columns if columns is None else columns)]).alias(ROW)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the cluster sizes them to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
