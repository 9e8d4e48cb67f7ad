"""Latest row per key, top lists and other ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` values of every key (end the list with a unique column to break ties).

    The filter on row_number lets Spark keep one row per key in each input partition before the shuffle, so a hot key
    never gathers in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def top_by_total(df: DataFrame, keys: list[str], total: Column, n: int, name: str = "total") -> DataFrame:
    """The n keys with the greatest total, ties broken by key."""
    return df.groupBy(*keys).agg(total.alias(name)).orderBy(F.desc(name), *keys).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """ROWNUM <= n after an explicit order: Spark keeps n rows per partition, never a full sort."""
    return df.orderBy(*order).limit(n)
