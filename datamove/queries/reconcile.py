"""Reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from datamove.operators import generate, reconcile
from datamove.plans import load
from datamove.queries.base import AS_OF, CHANGED_ORDERS_SQL, changed_orders, dbl, money, new_table, query, read
from datamove.queries.sources import _by_path, _named
from datamove.session import scratch_path
from datamove.sources import files
from datamove.spec import MoveSettings, TableMapping
from datamove.streaming.ingest import LOAD_COLUMNS, LOAD_PARTITION


def _rounded(checks: DataFrame) -> DataFrame:
    """Check rows without the checksum's value (its hash is Spark's own)."""
    hashed = F.col("check").startswith("row_checksum")
    keep = lambda c: F.when(~hashed, F.col(c)).cast("double").alias(c)
    return checks.select("check", keep("source"), keep("target"), "match")


@query("reconcile_row_count", f"""
WITH c AS ({CHANGED_ORDERS_SQL})
SELECT 'row_count' AS "check", CAST((SELECT count(*) FROM orders) AS DOUBLE) AS source, CAST((SELECT count(*) FROM c) AS DOUBLE) AS target,
       (SELECT count(*) FROM orders) = (SELECT count(*) FROM c) AS match""")
def reconcile_row_count(spark, folder):
    orders = read(spark, folder, "orders")
    return _rounded(reconcile.compare_table(orders, changed_orders(orders)).where("check = 'row_count'"))


_LINE_SUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_TARGET_SQL = "SELECT * REPLACE (l_quantity + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS l_quantity) FROM lineitem"


@query("reconcile_sums", "WITH t AS (" + _LINE_TARGET_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT 'sum({c})' AS \"check\", CAST(s AS DOUBLE) AS source, CAST(d AS DOUBLE) AS target, s = d AS match FROM "
    f"(SELECT sum(CAST({c} AS DECIMAL(38,6))) AS s FROM lineitem), (SELECT sum(CAST({c} AS DECIMAL(38,6))) AS d FROM t)" for c in _LINE_SUMS))
def reconcile_sums(spark, folder):
    lines = read(spark, folder, "lineitem")
    target = lines.withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0))
    return _rounded(reconcile.compare_table(lines, target, checksum=False).where("check like 'sum(%'"))


_SAME = "NOT EXISTS (SELECT * FROM ({a}) EXCEPT ALL SELECT * FROM ({b})) AND NOT EXISTS (SELECT * FROM ({b}) EXCEPT ALL SELECT * FROM ({a}))"
_A = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_CHECKSUM_CASES = {
    "reordered": "SELECT * FROM (" + _A + ") ORDER BY o_orderkey DESC",
    "widened": _A,
    "one_text_changed": _A.replace("o_orderpriority FROM", "CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'x' ELSE o_orderpriority END FROM"),
    "row_doubled": _A + " UNION ALL " + _A + " WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)",
    "moved_between_columns": _A.replace("o_orderstatus,", "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderstatus END,").replace("o_orderpriority FROM", "CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus ELSE NULL END FROM"),
}
_MOVED_SOURCE = _A.replace("o_orderpriority FROM", "CAST(NULL AS VARCHAR) FROM")


@query("reconcile_checksum", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS case_name, " + _SAME.format(a=_MOVED_SOURCE if name == "moved_between_columns" else _A, b=b) + " AS match"
    for name, b in _CHECKSUM_CASES.items()))
def reconcile_checksum(spark, folder):
    orders = read(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    marked = orders.join(F.broadcast(last), F.col("o_orderkey") == F.col("last"), "left")  # one row
    is_last, fiftieth = F.col("last").isNotNull(), F.col("o_orderkey") % 50 == 0
    bare = orders.withColumn("o_orderpriority", F.lit(None).cast("string"))
    cases = {
        "reordered": (orders, orders.repartition(16, "o_orderpriority")),
        "widened": (orders, orders.withColumn("o_custkey", F.col("o_custkey").cast("decimal(20,2)"))),
        "one_text_changed": (orders, marked.withColumn("o_orderpriority", F.when(is_last, "x").otherwise(F.col("o_orderpriority"))).drop("last")),
        "row_doubled": (orders, orders.unionByName(marked.where(is_last).drop("last"))),
        "moved_between_columns": (bare, bare.withColumn("o_orderpriority", F.when(fiftieth, F.col("o_orderstatus")))
                                  .withColumn("o_orderstatus", F.when(~fiftieth, F.col("o_orderstatus")))),
    }
    return reduce(DataFrame.unionByName, [
        reconcile.compare_table(a, b).where("check like 'row_checksum%'").select(F.lit(name).alias("case_name"), "match")
        for name, (a, b) in cases.items()])


@query("table_profile", """
SELECT count(*) AS row_count, CAST(sum(CAST(l_orderkey AS DECIMAL(38,6))) AS DOUBLE) AS sum_orderkey,
       CAST(sum(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS sum_quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(38,6))) AS DOUBLE) AS sum_extendedprice
FROM lineitem""")
def table_profile(spark, folder):
    lines = read(spark, folder, "lineitem")
    row = reconcile.profile(lines, ["l_orderkey", "l_quantity", "l_extendedprice"], [c.lower() for c in lines.columns], {"l_orderkey"})
    return row.select("row_count", dbl("sum_0").alias("sum_orderkey"), dbl("sum_1").alias("sum_quantity"), dbl("sum_2").alias("sum_extendedprice"))


_COMPARE_SQL = "WITH c AS (" + CHANGED_ORDERS_SQL + """), s AS (
  SELECT count(*) AS n, sum(CAST(o_orderkey AS DECIMAL(38,6))) AS k, sum(CAST(o_custkey AS DECIMAL(38,6))) AS u, sum(CAST(o_totalprice AS DECIMAL(38,6))) AS p FROM orders),
d AS (SELECT count(*) AS n, sum(CAST(o_orderkey AS DECIMAL(38,6))) AS k, sum(CAST(o_custkey AS DECIMAL(38,6))) AS u, sum(CAST(o_totalprice AS DECIMAL(38,6))) AS p FROM c)
SELECT 'row_count' AS "check", CAST(s.n AS DOUBLE) AS source, CAST(d.n AS DOUBLE) AS target, s.n = d.n AS match FROM s, d
UNION ALL SELECT 'sum(o_orderkey)', CAST(s.k AS DOUBLE), CAST(d.k AS DOUBLE), s.k = d.k FROM s, d
UNION ALL SELECT 'sum(o_custkey)', CAST(s.u AS DOUBLE), CAST(d.u AS DOUBLE), s.u = d.u FROM s, d
UNION ALL SELECT 'sum(o_totalprice)', CAST(s.p AS DOUBLE), CAST(d.p AS DOUBLE), s.p = d.p FROM s, d
UNION ALL SELECT 'cast_nulls', 0, 0, TRUE"""


@query("compare_table", _COMPARE_SQL + "\nUNION ALL SELECT 'row_checksum(6 columns)', NULL, NULL, NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM c)")
def compare_table(spark, folder):
    orders = read(spark, folder, "orders")
    return _rounded(reconcile.compare_table(orders, changed_orders(orders)))


@query("compare_light", _COMPARE_SQL)
def compare_light(spark, folder):
    orders = read(spark, folder, "orders")
    return _rounded(reconcile.compare_table(orders, changed_orders(orders), checksum=False))


def _four_comparisons(spark, folder):
    """Loaded copies: orders equal, part changed, supplier filtered and renamed, region missing."""
    part, supplier = read(spark, folder, "part"), read(spark, folder, "supplier")
    orders_t = new_table(spark, "c_orders", read(spark, folder, "orders").schema)
    part_t = new_table(spark, "c_part", part.schema)
    supplier_t = new_table(spark, "c_supplier", "supplier_id bigint, supplier_name string")
    supplier_map = {"supplier_id": "s_suppkey", "supplier_name": "s_name"}
    tables = (TableMapping(_by_path(folder, "orders"), orders_t), TableMapping(_by_path(folder, "part"), part_t),
              TableMapping(_by_path(folder, "supplier"), supplier_t, columns=supplier_map, where="s_acctbal > 0"),
              TableMapping(_by_path(folder, "region"), "no_such_region"))
    settings = MoveSettings(tables, mode="replace", source_catalog="parquet")
    loads = load.run_load(spark, settings)
    load.replace_by_name(part.withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_size") == 1, 0.5).otherwise(0)), part_t)
    labels = {orders_t: "orders", part_t: "part", supplier_t: "supplier", "no_such_region": "region"}
    return settings, loads, labels


@query("reconcile_summary", """
SELECT CAST(4 AS BIGINT) AS tables, count(*) FILTER (n = 0) + 2 AS matched, count(*) FILTER (n > 0) AS mismatched, CAST(1 AS BIGINT) AS errors
FROM (SELECT count(*) AS n FROM part WHERE p_size = 1)""")
def reconcile_summary(spark, folder):
    settings, _, _ = _four_comparisons(spark, folder)
    return load.reconcile_summary(load.run_reconcile(spark, settings))


@query("signoff_comparison", """
WITH s AS (SELECT sum(CAST(p_retailprice AS DECIMAL(38,6))) AS a, sum(CAST(p_retailprice + CASE WHEN p_size = 1 THEN 0.5 ELSE 0 END AS DECIMAL(38,6))) AS b FROM part)
SELECT 'orders' AS target, 'match' AS status, '' AS differences
UNION ALL SELECT 'part', 'mismatch', 'sum(p_retailprice): ' || CAST(a AS VARCHAR) || ' -> ' || CAST(b AS VARCHAR) FROM s
UNION ALL SELECT 'supplier', 'match', ''""")
def signoff_comparison(spark, folder):
    settings, _, labels = _four_comparisons(spark, folder)
    checks = load.run_reconcile(spark, settings).where("error is null and check not like 'row_checksum%'")
    return _named(reconcile.failing_checks_text(checks).withColumnRenamed("table_name", "target"), labels)


@query("migration_summary", """
SELECT CAST(3 AS BIGINT) AS tables_copied, (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS rows_copied,
       CAST(1 AS BIGINT) AS tables_failed, CAST(2 AS BIGINT) AS tables_matching""")
def migration_summary(spark, folder):
    settings, loads, _ = _four_comparisons(spark, folder)
    return load.migration_summary(loads, load.table_results(load.run_reconcile(spark, settings)))


@query("compare_export", """
SELECT 'row_count' AS "check", CAST(count(*) AS DOUBLE) AS source, CAST(count(*) AS DOUBLE) AS target, TRUE AS match FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT 'sum(order_id)', CAST(sum(l_orderkey) AS DOUBLE), CAST(sum(l_orderkey) AS DOUBLE), TRUE FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT 'sum(price)', CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE), CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE), TRUE FROM lineitem WHERE l_quantity >= 10
UNION ALL SELECT 'row_checksum(3 columns)', NULL, NULL, TRUE FROM (SELECT 1)""")
def compare_export(spark, folder):
    root = scratch_path(spark, "lines")
    files.write_export(read(spark, folder, "lineitem"), root, "lineitem")
    table = new_table(spark, "lines", f"order_id int, price decimal(12,2), shipped date, {LOAD_COLUMNS}", LOAD_PARTITION)
    mapping = TableMapping("sales.lineitem", table, columns={"order_id": "l_orderkey", "price": "l_extendedprice", "shipped": "l_shipdate"}, where="l_quantity >= 10")
    settings = MoveSettings((mapping,), method="files", files_root=root)
    load.run_load(spark, settings)
    return _rounded(load.run_reconcile(spark, settings))


@query("replace_then_append", """
SELECT name AS step, CAST(CASE WHEN name LIKE 'append%' THEN 0 ELSE n END AS BIGINT) AS copied, n AS rows, total FROM
(SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders),
(VALUES ('replace'), ('append after it'), ('replace again'), ('append again')) AS s(name)""")
def replace_then_append(spark, folder):
    """A replace from files enters them in the ledger: an append behind it adds nothing, another replace copies all again."""
    root = scratch_path(spark, "replaced")
    files.write_export(read(spark, folder, "orders"), root, "orders")
    table = new_table(spark, "replaced", f"o_orderkey bigint, o_totalprice decimal(18,2), {LOAD_COLUMNS}", LOAD_PARTITION)
    steps = []
    for name in ("replace", "append after it", "replace again", "append again"):
        settings = MoveSettings((TableMapping("sales.orders", table),), mode=name.split()[0], method="files", files_root=root)
        copied = load.run_load(spark, settings).select("rows").first()[0]
        rows, total = spark.table(table).agg(F.count(F.lit(1)), F.sum("o_totalprice").cast("double")).first()
        steps.append((name, copied, rows, total))
    return spark.createDataFrame(steps, "step string, copied bigint, rows bigint, total double")


@query("reconcile_rows", f"""
WITH c AS ({CHANGED_ORDERS_SQL})
SELECT coalesce(a.o_orderkey, c.o_orderkey) AS o_orderkey, CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS in_source, CAST(c.o_orderkey IS NOT NULL AS BIGINT) AS in_target,
       CASE WHEN c.o_orderkey IS NULL THEN 'missing_in_target' WHEN a.o_orderkey IS NULL THEN 'missing_in_source' ELSE 'changed' END AS difference
FROM orders a FULL JOIN c ON a.o_orderkey = c.o_orderkey
WHERE c.o_orderkey IS NULL OR a.o_orderkey IS NULL OR (a.o_custkey, a.o_orderstatus, a.o_totalprice, a.o_orderdate, a.o_orderpriority)
      IS DISTINCT FROM (c.o_custkey, c.o_orderstatus, c.o_totalprice, c.o_orderdate, c.o_orderpriority)""")
def reconcile_rows(spark, folder):
    orders = read(spark, folder, "orders")
    return reconcile.reconcile_rows(orders, changed_orders(orders), ["o_orderkey"])


_FEW_SQL = """
WITH e AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
c AS (SELECT o.* REPLACE (o_totalprice + CASE WHEN o_orderkey = hi THEN 1e-7 ELSE 0 END AS o_totalprice) FROM orders o, e WHERE o_orderkey <> lo
      UNION ALL SELECT o.* REPLACE (o_orderkey + 7 AS o_orderkey) FROM orders o, e WHERE o_orderkey = hi)
SELECT coalesce(a.o_orderkey, c.o_orderkey) AS o_orderkey, CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS in_source, CAST(c.o_orderkey IS NOT NULL AS BIGINT) AS in_target,
       CASE WHEN c.o_orderkey IS NULL THEN 'missing_in_target' WHEN a.o_orderkey IS NULL THEN 'missing_in_source' ELSE 'changed' END AS difference
FROM orders a FULL JOIN c ON a.o_orderkey = c.o_orderkey
WHERE c.o_orderkey IS NULL OR a.o_orderkey IS NULL OR (a.o_custkey, a.o_orderstatus, a.o_totalprice, a.o_orderdate, a.o_orderpriority)
      IS DISTINCT FROM (c.o_custkey, c.o_orderstatus, c.o_totalprice, c.o_orderdate, c.o_orderpriority)"""


@query("reconcile_descent", _FEW_SQL)
def reconcile_descent(spark, folder):
    """orders against a copy with one row lost, one changed in the seventh decimal, and one added."""
    orders = read(spark, folder, "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    key, last = F.col("o_orderkey"), F.col("o_orderkey") == high
    copy = orders.where(key != low).withColumn("o_totalprice", F.col("o_totalprice") + F.when(last, F.lit(1e-7)).otherwise(0.0))
    return reconcile.reconcile_descent(orders, copy.unionByName(orders.where(last).withColumn("o_orderkey", key + 7)), ["o_orderkey"], leaf_rows=1000)


@query("reconcile_exact", """
WITH c AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1e-8 ELSE 0 END AS DOUBLE) AS nudged FROM orders)
SELECT 'price' AS "column", count(*) FILTER (o_totalprice <> CAST(price AS DOUBLE)) AS mismatches FROM orders JOIN c USING (o_orderkey)
UNION ALL SELECT 'nudged', count(*) FILTER (o_totalprice <> nudged) FROM orders JOIN c USING (o_orderkey)""")
def reconcile_exact(spark, folder):
    """Doubles against decimals and against doubles that differ in the eighth decimal."""
    orders = read(spark, folder, "orders")
    amount = F.col("o_totalprice")
    source = orders.select("o_orderkey", amount.alias("price"), amount.alias("nudged"))
    target = orders.select("o_orderkey", amount.cast("decimal(18,2)").alias("price"), (amount + F.when(F.col("o_orderkey") % 7 == 0, F.lit(1e-8)).otherwise(0.0)).alias("nudged"))
    return reconcile.reconcile_columns(source, target, ["o_orderkey"])


_COMPARED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("reconcile_columns", f"WITH c AS ({CHANGED_ORDERS_SQL}), j AS (SELECT " + ", ".join(
    f"count(*) FILTER (a.{c} IS DISTINCT FROM c.{c}) AS {c}" for c in _COMPARED) + " FROM orders a JOIN c ON a.o_orderkey = c.o_orderkey)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {c} AS mismatches FROM j" for c in _COMPARED))
def reconcile_columns(spark, folder):
    orders = read(spark, folder, "orders")
    return reconcile.reconcile_columns(orders, changed_orders(orders), ["o_orderkey"])


@query("verify_totals", f"""
SELECT 'customer: rows, segments, ids' AS check_name, count(*) AS rows, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS total_1, CAST(sum(c_custkey) AS DOUBLE) AS total_2 FROM customer
UNION ALL SELECT 'part: rows, types, price', count(*), count(DISTINCT p_type), CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) FROM part
UNION ALL SELECT 'orders: rows, customers, amount', count(*), count(DISTINCT o_custkey), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders
UNION ALL SELECT 'archive: rows, customers, amount', count(*), coalesce(count(DISTINCT o_custkey), 0), CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE)
FROM orders WHERE o_orderdate > TIMESTAMP '{AS_OF}'""")
def verify_totals(spark, folder):
    def totals(df, name, first, second):
        return df.agg(F.count(F.lit(1)).alias("rows"), dbl(first).alias("total_1"), dbl(F.coalesce(second, F.lit(0))).alias("total_2")).select(
            F.lit(name).alias("check_name"), "rows", "total_1", "total_2")
    orders = read(spark, folder, "orders")
    archive = orders.where(F.col("o_orderdate") > F.lit(str(AS_OF)).cast("timestamp_ntz"))
    amount = F.sum(money("o_totalprice"))
    return reduce(DataFrame.unionByName, [
        totals(read(spark, folder, "customer"), "customer: rows, segments, ids", F.countDistinct("c_mktsegment"), F.sum("c_custkey")),
        totals(read(spark, folder, "part"), "part: rows, types, price", F.countDistinct("p_type"), F.sum(money("p_retailprice"))),
        totals(orders, "orders: rows, customers, amount", F.countDistinct("o_custkey"), amount),
        totals(archive, "archive: rows, customers, amount", F.countDistinct("o_custkey"), amount)])
