"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove.plans import load
from datamove.queries.base import AS_OF, dbl, money, new_table, query, read
from datamove.session import scratch_path
from datamove.sources import files, tables
from datamove.spec import MoveSettings, TableMapping


def _by_path(folder: str, table: str) -> str:
    return f"`{folder.rstrip('/')}/{table}.parquet`"


@query("read_source_whole", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_source_whole(spark, folder):
    return tables.read_source(spark, _by_path(folder, "nation"), "parquet")


@query("read_source", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def read_source(spark, folder):
    return tables.read_source(spark, _by_path(folder, "nation"), "parquet").where("n_regionkey = 1").select("n_nationkey", "n_name")


_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _round_trip(fmt):
    def run(spark, folder):
        orders = read(spark, folder, "orders")
        root = scratch_path(spark, f"export-{fmt}")
        files.write_export(orders, root, "orders", fmt)
        schema = None if fmt in ("parquet", "orc") else orders.schema
        return files.cast_to_target(files.read_export(spark, root, "sales.orders", fmt, schema), orders.schema)
    return run


query("read_export_csv", _ORDERS_SQL)(_round_trip("csv"))
query("read_export_json", _ORDERS_SQL)(_round_trip("json"))
query("read_export_orc", _ORDERS_SQL)(_round_trip("orc"))


@query("export_parquet", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS amount, o_orderdate FROM orders")
def export_parquet(spark, folder):
    root = scratch_path(spark, "export")
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), "o_orderdate")
    files.write_export(orders, root, "orders")
    return files.read_export(spark, root, "orders").withColumn("amount", F.col("amount").cast("string"))


@query("unload_directory", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0")
def unload_directory(spark, folder):
    place = scratch_path(spark, "unload")
    files.unload(read(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment"), place)
    return spark.read.parquet(place)


@query("ctas_customer_spend", """
SELECT c_custkey, c_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, count(*) AS order_count
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_custkey, c_name""")
def ctas_customer_spend(spark, folder):
    spend = (read(spark, folder, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey")
             .agg(F.sum(money("o_totalprice")).alias("total_spend"), F.count(F.lit(1)).alias("order_count")))
    joined = read(spark, folder, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"))
    place = scratch_path(spark, "ctas")
    made = tables.save_as_table(joined.select("c_custkey", "c_name", "total_spend", "order_count"), "dm_ctas_" + place[-12:], place)
    return made.withColumn("total_spend", dbl("total_spend"))


@query("load_append_by_name", """
SELECT n_name, n_nationkey, n_regionkey FROM nation UNION ALL SELECT s_name, s_nationkey, CAST(s_suppkey AS INTEGER) FROM supplier""")
def load_append_by_name(spark, folder):
    table = new_table(spark, "append", "n_name string, n_nationkey int, n_regionkey int")
    load.append_by_name(read(spark, folder, "nation").select("n_regionkey", "n_nationkey", "n_name"), table)
    load.append_by_name(read(spark, folder, "supplier").selectExpr("s_nationkey AS n_nationkey", "CAST(s_suppkey AS INT) AS n_regionkey", "s_name AS n_name"), table)
    return spark.table(table)


@query("load_column_mapping", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer")
def load_column_mapping(spark, folder):
    table = new_table(spark, "mapped", "customer_id bigint, customer_name string, segment string")
    mapping = TableMapping(_by_path(folder, "customer"), table, columns={"customer_id": "c_custkey", "customer_name": "c_name", "segment": "c_mktsegment"})
    load.run_load(spark, MoveSettings((mapping,), source_catalog="parquet"))
    return spark.table(table)


@query("load_replace", "SELECT p_partkey, p_name, p_retailprice FROM part")
def load_replace(spark, folder):
    table = new_table(spark, "replaced", "p_partkey bigint, p_name string, p_retailprice double")
    mapping = TableMapping(_by_path(folder, "part"), table, columns={c: c for c in ("p_partkey", "p_name", "p_retailprice")})
    settings = MoveSettings((mapping,), mode="replace", source_catalog="parquet")
    load.run_load(spark, settings)
    load.run_load(spark, settings)  # the second run leaves the same rows
    return spark.table(table)


@query("load_filtered", """
SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 5000""")
def load_filtered(spark, folder):
    table = new_table(spark, "filtered", "s_suppkey bigint, s_name string")
    columns = {"s_suppkey": "s_suppkey", "s_name": "s_name"}
    every = TableMapping(_by_path(folder, "supplier"), table, columns=columns)
    some = TableMapping(_by_path(folder, "supplier"), table, columns=columns, where="s_acctbal >= 5000")
    for mapping in (every, some):  # in replace mode too, a filtered load only adds
        load.run_load(spark, MoveSettings((mapping,), mode="replace", source_catalog="parquet"))
    return spark.table(table)


@query("load_cast_to_target", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_comment FROM orders""")
def load_cast_to_target(spark, folder):
    table = new_table(spark, "typed", "o_orderkey int, o_totalprice decimal(12,2), o_orderdate date, o_comment string")
    source = read(spark, folder, "orders")
    load.replace_by_name(files.cast_to_target(source, spark.table(table).schema), table)
    return spark.table(table).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))


def _three_loads(spark, folder):
    """Orders loaded, a part load that cannot work, a compare-only supplier table."""
    orders = new_table(spark, "t_orders", read(spark, folder, "orders").schema)
    part = new_table(spark, "t_part", "p_partkey bigint, p_unknown string")
    supplier = new_table(spark, "t_supplier", read(spark, folder, "supplier").schema)
    labels = {orders: "orders", part: "part", supplier: "supplier"}
    settings = MoveSettings((TableMapping(_by_path(folder, "orders"), orders, where=""),
                             TableMapping(_by_path(folder, "part"), part),
                             TableMapping(_by_path(folder, "supplier"), supplier, load=False)), mode="replace", source_catalog="parquet")
    return settings, labels


def _named(df, labels):
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn("target", names[F.col("target")])


@query("load_summary", """
SELECT 'orders' AS target, 'loaded' AS status, (SELECT count(*) FROM orders) AS rows UNION ALL
SELECT 'part', 'failed', NULL UNION ALL SELECT 'supplier', 'reset', NULL""")
def load_summary(spark, folder):
    settings, labels = _three_loads(spark, folder)
    return _named(load.run_load(spark, settings), labels).select("target", "status", "rows")


@query("load_plan", """
SELECT 'orders' AS target, 'replace' AS action, (SELECT count(*) FROM orders) AS rows UNION ALL
SELECT 'part', 'replace', (SELECT count(*) FROM part) UNION ALL SELECT 'supplier', 'reset', NULL""")
def load_plan(spark, folder):
    settings, labels = _three_loads(spark, folder)
    planned = load.plan_frame(spark, settings).join(load.preflight(spark, settings).select("target", "rows"), "target", "left")
    return _named(planned, labels).select("target", "action", "rows")


@query("copy_again_targets", "SELECT 'part' AS target FROM part GROUP BY 1 UNION ALL SELECT 'supplier' FROM supplier GROUP BY 1")
def copy_again_targets(spark, folder):
    settings, labels = _three_loads(spark, folder)
    loads = load.run_load(spark, settings)
    compared = load.table_results(load.run_reconcile(spark, settings))  # the reset supplier table is empty, so it differs
    return _named(load.copy_again(loads, compared), labels)


@query("preflight_counts", f"""
SELECT 'lineitem' AS target, TRUE AS target_exists, count(*) AS rows, round(count(*) / 1000000.0, 1)::DOUBLE AS minutes
FROM lineitem WHERE l_shipdate < TIMESTAMP '{AS_OF}'
UNION ALL SELECT 'orders', FALSE, count(*), round(count(*) / 1000000.0, 1)::DOUBLE FROM orders""")
def preflight_counts(spark, folder):
    target = new_table(spark, "lines", read(spark, folder, "lineitem").schema)
    settings = MoveSettings((TableMapping(_by_path(folder, "lineitem"), target, where=f"l_shipdate < TIMESTAMP_NTZ '{AS_OF} 00:00:00'"),
                             TableMapping(_by_path(folder, "orders"), "no_such_orders")), source_catalog="parquet")
    return _named(load.preflight(spark, settings), {target: "lineitem", "no_such_orders": "orders"}).select("target", "target_exists", "rows", "minutes")
