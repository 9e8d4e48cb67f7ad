"""Checks on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SPREAD = 1024  # rows with a NULL key match nothing: they are spread over this many hash values


def complete(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def spread(keys: list[str], df: DataFrame) -> Column:
    """0 for complete keys; for keys with a NULL, a number from the row's other values, so such rows do not gather in one task."""
    others = [F.col(c) for c in df.columns if c not in keys] or [F.lit(0)]
    return F.when(complete(keys), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(*others), F.lit(SPREAD)))


HOT_FACTOR, MOST_HOT, TRACKED = 2, 1000, 1 << 14


def hot_keys(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that hold more than HOT_FACTOR times the rows of an average shuffle partition, at most MOST_HOT; found in one pass by a sketch of the
    most frequent values, which each task keeps at TRACKED entries."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.where(complete(keys)).select(F.xxhash64(*keys).alias("h"))
    n, top = hashed.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {MOST_HOT}, {TRACKED})")).first()
    return [t["item"] for t in top or [] if t["count"] * parts > HOT_FACTOR * n]


def single_rows(df: DataFrame, keys: list[str], also: str | None = None) -> DataFrame:
    """Add `_single` = true, and fail when a complete key occurs twice. The window needs the partitioning and order that a
    join on the same columns needs too, so next to such a join it costs no shuffle."""
    same_key = Window.partitionBy(*keys, *([also] if also else []))
    counted = df.withColumn("_n", F.count(F.lit(1)).over(same_key))
    problem = F.concat(F.lit("More than one source row for key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(complete(keys) & (F.col("_n") > 1), F.raise_error(problem).cast("bigint")).otherwise(F.col("_n"))
    return counted.withColumn("_single", checked >= 1).drop("_n")
