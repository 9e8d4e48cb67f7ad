"""Intermediate tables in the shared folder: evaluated once, read again by every later job, kept through the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datamove.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
