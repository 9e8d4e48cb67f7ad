"""Projections, filters, joins, aggregations, ranked picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove.functions import scalar
from datamove.operators import latest, lists, patterns
from datamove.queries.base import AS_OF, CANCELLED, dbl, money, query, read
from datamove.queries.patterns import _FACT_SQL, fact_of
from datamove.session import broadcast_if_small


@query("project_derived", """
SELECT c_custkey AS customer_id, upper(c_name) AS name, c_mktsegment || '/' || c_nationkey AS segment_nation, c_custkey + 1000 AS customer_key FROM customer""")
def project_derived(spark, folder):
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.upper("c_name").alias("name"),
        F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("segment_nation"), (F.col("c_custkey") + 1000).alias("customer_key"))


@query("project_except", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def project_except(spark, folder):
    return read(spark, folder, "customer").drop("c_acctbal")


@query("filter_predicates", """
SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1998-01-01' AND (o_orderpriority IS NOT NULL AND (o_totalprice > 400000 OR o_orderpriority = '1-URGENT'))""")
def filter_predicates(spark, folder):
    return read(spark, folder, "orders").where(
        (F.col("o_orderstatus") != CANCELLED) & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        & F.col("o_orderpriority").isNotNull() & ((F.col("o_totalprice") > 400000) | (F.col("o_orderpriority") == "1-URGENT"))
    ).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("orders_clean_tax", """
SELECT o_orderkey, o_custkey, o_orderdate, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) * 1.18, 2) AS DOUBLE) AS amount_with_tax, upper(trim(' ' || o_orderstatus || ' ')) AS status
FROM orders WHERE o_orderstatus <> 'P'""")
def orders_clean_tax(spark, folder):
    open_orders = read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED)
    taxed = F.round(F.col("o_totalprice").cast("decimal(12,2)") * F.lit("1.18").cast("decimal(3,2)"), 2)
    return open_orders.select("o_orderkey", "o_custkey", "o_orderdate", dbl(taxed).alias("amount_with_tax"),
                              F.upper(F.trim(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))).alias("status"))


@query("join_inner3", """
SELECT c_name, n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def join_inner3(spark, folder):
    spend = (read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED).groupBy("o_custkey")  # summed before the joins
             .agg(F.count(F.lit(1)).alias("orders"), F.sum(money("o_totalprice")).alias("total")))
    named = read(spark, folder, "customer").join(read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = spend.join(named, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_name", "n_name").agg(F.sum("orders").alias("orders"), dbl(F.sum("total")).alias("total"))


@query("join_left_on_filter", f"""
SELECT c_custkey, c_name, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_spend, count(o_orderkey) AS order_count,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= DATE '{AS_OF}' - 90 GROUP BY 1, 2""")
def join_left_on_filter(spark, folder):
    recent = (read(spark, folder, "orders").where(F.col("o_orderdate") >= F.lit(patterns.last_days(AS_OF, 90)).cast("timestamp_ntz")).groupBy("o_custkey")
              .agg(F.sum(money("o_totalprice")).alias("spend"), F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("last")))
    joined = read(spark, folder, "customer").join(recent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "c_name", dbl(F.coalesce("spend", F.lit(0))).alias("total_spend"), F.coalesce("n", F.lit(0)).alias("order_count"),
                         scalar.iso_date(F.col("last")).alias("last_order"))


@query("join_left_plain", """
SELECT c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey""")
def join_left_plain(spark, folder):
    big = read(spark, folder, "orders").where("o_totalprice > 450000")
    return read(spark, folder, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_name", "o_orderkey", "o_totalprice")


@query("anti_missing", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.05)")
def anti_missing(spark, folder):
    used = read(spark, folder, "lineitem").where("l_quantity > 45 and l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, folder, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("cross_join_values", "SELECT o_orderkey, k AS line_no FROM orders, (VALUES (1), (2), (3), (4)) v(k) WHERE k <= o_orderkey % 4 + 1")
def cross_join_values(spark, folder):
    # each order makes its own lines: no pairing of rows that the filter would drop again
    lines = F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, folder, "orders").select("o_orderkey", F.explode(lines).alias("line_no"))


@query("agg_customer_sales", """
SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(max(o_orderdate) AS DATE) AS last_order FROM orders GROUP BY 1""")
def agg_customer_sales(spark, folder):
    return read(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), dbl(F.sum(money("o_totalprice"))).alias("amount"), F.to_date(F.max("o_orderdate")).alias("last_order"))


@query("agg_monthly_band", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mth, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CASE WHEN sum(CAST(o_totalprice AS DECIMAL(18,2))) > 30000000 THEN 'High' ELSE 'Normal' END AS band FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def agg_monthly_band(spark, folder):
    total = F.sum(money("o_totalprice"))
    return (read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED).groupBy(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mth"))
            .agg(dbl(total).alias("revenue"), scalar.iif(total > 30_000_000, F.lit("High"), F.lit("Normal")).alias("band")))


@query("monthly_revenue", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS mth, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders
WHERE year(o_orderdate) = 1998 AND o_orderstatus <> 'P' GROUP BY 1""")
def monthly_revenue(spark, folder):
    # a parameterised report as a SQL table function
    read(spark, folder, "orders").createOrReplaceTempView("dm_orders")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION dm_monthly_revenue(wanted INT) RETURNS TABLE (mth INT, revenue DOUBLE) RETURN
        SELECT month(o_orderdate), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM dm_orders
        WHERE o_orderdate >= CAST(make_date(wanted, 1, 1) AS TIMESTAMP_NTZ) AND o_orderdate < CAST(make_date(wanted + 1, 1, 1) AS TIMESTAMP_NTZ)
          AND o_orderstatus <> 'P' GROUP BY month(o_orderdate)""")
    return spark.sql("SELECT mth, revenue FROM dm_monthly_revenue(1998)")


@query("agg_ordered_array", """
SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS order_ids, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def agg_ordered_array(spark, folder):
    kept = read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED)
    ids = lists.ordered_text(kept, ["o_custkey"], None, ["o_orderdate", "o_orderkey"], F.col("o_orderkey"), sums={"total": money("o_totalprice")})
    return ids.select("o_custkey", F.col("joined").alias("order_ids"), dbl("total").alias("total"))


@query("agg_listagg", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS order_ids, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def agg_listagg(spark, folder):
    read(spark, folder, "orders").createOrReplaceTempView("dm_orders")
    # LISTAGG in two steps: runs of keys first, then each customer's runs
    return spark.sql("""
        SELECT o_custkey, listagg(part, ',') WITHIN GROUP (ORDER BY run) AS order_ids, sum(n) AS orders FROM (
          SELECT o_custkey, o_orderkey DIV 100000 AS run, listagg(CAST(o_orderkey AS STRING), ',') WITHIN GROUP (ORDER BY o_orderkey) AS part, count(*) AS n
          FROM dm_orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderkey DIV 100000) GROUP BY o_custkey""")


@query("monthly_sales_fiscal", f"""
SELECT CAST(year(order_date) + CASE WHEN month(order_date) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
       monthname(order_date) AS month_name, CAST(sum(order_count) AS BIGINT) AS orders, CAST(sum(total_amount) AS DOUBLE) AS amount FROM ({_FACT_SQL}) GROUP BY 1, 2, 3, 4""")
def monthly_sales_fiscal(spark, folder):
    fact = fact_of(spark, folder).groupBy("order_date").agg(F.sum("order_count").alias("orders"), F.sum("total_amount").alias("amount"))
    first, last = read(spark, folder, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    days = patterns.dim_date(spark, first, last)
    return (fact.join(broadcast_if_small(days), fact["order_date"] == days["date"]).groupBy("fiscal_year", "year", "month", "month_name")
            .agg(F.sum("orders").alias("orders"), dbl(F.sum("amount")).alias("amount")))


@query("pivot_status", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS cancelled
FROM orders GROUP BY 1""")
def pivot_status(spark, folder):
    orders = read(spark, folder, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderstatus")
    return (orders.groupBy("yr").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
            .select("yr", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("F", "closed"), ("O", "open"), ("P", "cancelled"))]))


@query("latest_per_customer", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_customer(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("top_customers", """
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_customers(spark, folder):
    kept = read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED)
    return latest.top_by_total(kept, ["o_custkey"], F.sum(money("o_totalprice")), 3).withColumn("total", dbl("total"))


@query("first_rows", "SELECT c_custkey, c_name, CASE WHEN c_custkey > 3 THEN 'NEW' ELSE 'EARLY' END AS cohort FROM customer ORDER BY c_custkey LIMIT 10")
def first_rows(spark, folder):
    cohort = scalar.iif(F.col("c_custkey") > 3, F.lit("NEW"), F.lit("EARLY"))
    return latest.first_rows(read(spark, folder, "customer").select("c_custkey", "c_name", cohort.alias("cohort")), ["c_custkey"], 10)


@query("hierarchy_levels", """
WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey >= 5 THEN c_custkey // 5 END AS p FROM customer),
t AS (SELECT k, k AS root, 1 AS level FROM n WHERE p IS NULL UNION ALL SELECT n.k, t.root, t.level + 1 FROM n JOIN t ON n.p = t.k)
SELECT k AS c_custkey, root, level FROM t""")
def hierarchy_levels(spark, folder):
    k = F.col("c_custkey")
    nodes = read(spark, folder, "customer").select(k, F.when(k >= 5, F.floor(k / 5)).alias("parent"))
    return patterns.hierarchy_levels(nodes, "c_custkey", "parent")


@query("hierarchy_chain", """
WITH k AS (SELECT o_orderkey, o_orderkey % 4096 AS pos, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS nth FROM orders)
SELECT o_orderkey, o_orderkey - pos AS root, CAST(nth AS INTEGER) AS level FROM k WHERE nth = pos + 1""")
def hierarchy_chain(spark, folder):
    """Chains of up to 4,096 orders, each order's parent the one before it; behind a gap in the numbers a chain has no root."""
    k = F.col("o_orderkey")
    nodes = read(spark, folder, "orders").select(k, F.when(k % 4096 != 0, k - 1).alias("parent"))
    return patterns.hierarchy_levels(nodes, "o_orderkey", "parent")
