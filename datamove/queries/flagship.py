"""One answer end to end: move a table and prove the copy, then show that a faulty copy is caught."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from datamove.operators import reconcile
from datamove.plans import load
from datamove.queries.base import new_table, query, read
from datamove.sources.files import cast_to_target

COLUMNS = {"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus", "amount": "o_totalprice", "order_date": "o_orderdate"}
_AMOUNT = "CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE)"
_FAULTY = "copy = 'loaded' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 1000 = 7)"


@query("load_and_prove", f"""
WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS k, CAST(sum(o_custkey) AS DOUBLE) AS c, {_AMOUNT} AS a FROM orders),
v AS (SELECT * FROM (VALUES ('loaded'), ('faulty')) v(copy))
SELECT copy, 'row_count' AS "check", n AS source, n AS target, TRUE AS match FROM v, t UNION ALL SELECT copy, 'sum(order_id)', k, k, TRUE FROM v, t
UNION ALL SELECT copy, 'sum(customer_id)', c, c, TRUE FROM v, t UNION ALL SELECT copy, 'sum(amount)', a, a, TRUE FROM v, t
UNION ALL SELECT copy, 'row_checksum(5 columns)', NULL, NULL, {_FAULTY} FROM v""")
def load_and_prove(spark: SparkSession, folder: str) -> DataFrame:
    table = new_table(spark, "orders", "order_id bigint, customer_id bigint, status string, amount decimal(12,2), order_date date")
    source = cast_to_target(read(spark, folder, "orders"), spark.table(table).schema, COLUMNS)
    load.replace_by_name(source, table)
    faulty = spark.table(table).withColumn("status", F.when(F.col("order_id") % 1000 == 7, "X").otherwise(F.col("status")))
    both = (reconcile.compare_table(source, spark.table(table)).withColumn("copy", F.lit("loaded"))
            .unionByName(reconcile.compare_table(source, faulty).withColumn("copy", F.lit("faulty"))))
    shown = lambda c: F.when(~F.col("check").startswith("row_checksum"), F.col(c)).cast("double").alias(c)
    return both.select("copy", "check", shown("source"), shown("target"), "match")
