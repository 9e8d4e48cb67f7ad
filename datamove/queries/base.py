"""Registration of queries, and the few things they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datamove.session import scratch_path
from datamove.sources.tables import create_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = date(2001, 8, 1)  # the day after the last order; queries never use the clock
CANCELLED, OPEN, CLOSED = "P", "O", "F"


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def new_table(spark: SparkSession, name: str, schema, partitioned_by: str = "") -> str:
    """A new empty parquet table in the shared scratch folder."""
    unique = f"dm_{name}_{uuid.uuid4().hex[:12]}"
    return create_table(spark, unique, schema, scratch_path(spark, name), partitioned_by)


def dbl(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def changed_orders(orders: DataFrame) -> DataFrame:
    """The whole orders table as a faulty copy: some rows lost, some amounts and texts changed, some rows added."""
    k = F.col("o_orderkey")
    kept = (orders.where(k % 97 != 0)
            .withColumn("o_totalprice", F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
            .withColumn("o_orderpriority", F.when(k % 83 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))))
    return kept.unionByName(orders.where(k % 101 == 0).withColumn("o_orderkey", k + 1_000_000_000))


CHANGED_ORDERS_SQL = """
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, CASE WHEN o_orderkey % 83 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0
"""
