"""Warehouse load patterns and generated rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from datamove.functions import scalar
from datamove.operators import generate, patterns
from datamove.operators.typing import map_types
from datamove.plans import warehouse
from datamove.queries.base import AS_OF, CANCELLED, CLOSED, OPEN, dbl, money, new_table, query, read
from datamove.session import scratch_path

# ---------------------------------------------------------------- merge

_MERGE_SQL = """
WITH t AS (SELECT c_custkey + 1000 AS customer_key, c_custkey AS customer_id, c_name AS full_name, CASE WHEN c_custkey % 7 = 0 THEN 'OLD' ELSE c_mktsegment END AS segment,
                  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation, DATE '2000-01-01' AS updated FROM customer WHERE c_custkey % 10 <> 0),
s AS (SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 9 = 0 THEN lower(c_name) ELSE c_name END AS full_name, c_mktsegment AS segment, c_nationkey AS nation
      FROM customer WHERE c_custkey % 13 <> 0)
SELECT t.customer_key, t.customer_id, CASE WHEN hit THEN s.full_name ELSE t.full_name END AS full_name, CASE WHEN hit THEN s.segment ELSE t.segment END AS segment,
       CASE WHEN hit THEN s.nation ELSE t.nation END AS nation, CASE WHEN hit THEN DATE '2001-08-01' ELSE t.updated END AS updated
FROM (SELECT t.*, coalesce(t.full_name <> s.full_name OR t.segment <> s.segment OR t.nation <> s.nation, FALSE) AS hit FROM t LEFT JOIN s USING (customer_id)) t
LEFT JOIN s USING (customer_id)
UNION ALL SELECT s.customer_id + 1000, s.customer_id, s.full_name, s.segment, s.nation, NULL FROM s WHERE s.customer_id NOT IN (SELECT customer_id FROM t)"""


def _merge(limit=None):
    def run(spark, folder):
        customer = read(spark, folder, "customer")
        k = F.col("c_custkey")
        target = customer.where(k % 10 != 0).select(
            (k + 1000).alias("customer_key"), k.alias("customer_id"), F.col("c_name").alias("full_name"), F.when(k % 7 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("segment"),
            F.when(k % 11 != 0, F.col("c_nationkey")).alias("nation"), F.lit("2000-01-01").cast("date").alias("updated"))
        source = customer.where(k % 13 != 0).select(
            k.alias("customer_id"), F.when(k % 9 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("full_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
        tracked = ["full_name", "segment", "nation"]
        s = {c: F.col(f"s.{c}") for c in tracked}
        extra = {} if limit is None else {"limit": limit}
        return patterns.merge_upsert(target, source, ["customer_id"], tracked, update={**s, "updated": F.lit(AS_OF)},
                                     insert={**s, "customer_id": F.col("s.customer_id"), "customer_key": F.col("s.customer_id") + 1000}, **extra)
    return run


query("merge_upsert", _MERGE_SQL)(_merge())
query("merge_upsert_shuffled", _MERGE_SQL)(_merge(limit=0))


_HOT_TARGET = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders"
_HOT_SOURCE = """SELECT o_orderkey AS k, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT CAST(0 AS BIGINT), CAST(1 AS DOUBLE)"""


@query("merge_hot_key", f"""
WITH t AS ({_HOT_TARGET}), s AS ({_HOT_SOURCE})
SELECT t.k, coalesce(s.price, t.price) AS price, CASE WHEN s.k IS NULL THEN t.priority ELSE 'merged' END AS priority FROM t LEFT JOIN s ON t.k = s.k
UNION ALL SELECT k, price, 'added' FROM s WHERE NOT EXISTS (SELECT * FROM t WHERE t.k = s.k)""")
def merge_hot_key(spark, folder):
    """A third of the target's rows have one key; the source is too large to broadcast."""
    orders = read(spark, folder, "orders")
    target, source = (spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders) for sql in (_HOT_TARGET, _HOT_SOURCE))
    price = F.col("s.price")
    return patterns.merge_upsert(target, source, ["k"], ["price"], {"price": price, "priority": F.lit("merged")},
                                 {"k": F.col("s.k"), "price": price, "priority": F.lit("added")}, limit=0)


@query("merge_update_from_agg", """
WITH v AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS lifetime FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, CASE WHEN lifetime > 1500000 THEN lower(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def merge_update_from_agg(spark, folder):
    value = read(spark, folder, "orders").where(F.col("o_orderstatus") != CANCELLED).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(money("o_totalprice")).alias("lifetime"))
    customer = read(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return patterns.update_from(customer, value, ["c_custkey"], F.col("lifetime") > 1_500_000, {"c_name": F.lower("c_name")})


def _stale(days=30):
    return (F.col("o_orderstatus") == OPEN) & (scalar.days_between(F.col("o_orderdate"), F.lit(AS_OF)) > days)


@query("update_close_stale", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') > 30 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def update_close_stale(spark, folder):
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return patterns.update_where(orders, _stale(), {"o_orderstatus": F.lit(CLOSED)}).select("o_orderkey", "o_orderstatus")


@query("update_rowcount", f"SELECT count(*) AS rows_affected FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') > 30")
def update_rowcount(spark, folder):
    return patterns.rows_affected(read(spark, folder, "orders"), _stale())


@query("update_in_subquery", f"""
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders""")
def update_in_subquery(spark, folder):
    chosen = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return patterns.update_from(orders, chosen, ["o_custkey"], F.col("c_mktsegment") == "BUILDING", {"o_orderstatus": F.lit(CLOSED)}).drop("o_custkey")


# ---------------------------------------------------------------- facts

_AMOUNT_SQL = "CAST(l_quantity AS DECIMAL(10,0)) * CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,4)))"
_FACT_SQL = f"""SELECT CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id, count(DISTINCT o_orderkey) AS order_count,
       CAST(sum(l_quantity) AS BIGINT) AS total_quantity, CAST(sum(CAST({_AMOUNT_SQL} AS DECIMAL(27,6))) AS DECIMAL(38,4)) AS total_amount
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""


def fact_of(spark, folder):
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                                                  F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"))
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"),
                                                   scalar.line_amount(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")).alias("amount"))
    return patterns.daily_sales(orders, lines, CANCELLED)


@query("fact_daily_sales", f"SELECT order_date, customer_id, order_count, total_quantity, CAST(total_amount AS DOUBLE) AS total_amount FROM ({_FACT_SQL})")
def fact_daily_sales(spark, folder):
    return fact_of(spark, folder).withColumn("total_amount", dbl("total_amount"))


_ORDER_DAY_SQL = "SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders{} GROUP BY 1"


def _order_days(orders):
    return orders.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count(F.lit(1)).alias("orders"), dbl(F.sum(money("o_totalprice"))).alias("amount"))


@query("rolling_reload", f"""
SELECT * FROM ({_ORDER_DAY_SQL.format('')}) WHERE order_date < DATE '{AS_OF}' - 90
UNION ALL SELECT * FROM ({_ORDER_DAY_SQL.format(" WHERE o_orderstatus <> 'P'")}) WHERE order_date >= DATE '{AS_OF}' - 90""")
def rolling_reload(spark, folder):
    orders = read(spark, folder, "orders")
    return patterns.rolling_reload(_order_days(orders), _order_days(orders.where(F.col("o_orderstatus") != CANCELLED)), "order_date", patterns.last_days(AS_OF, 90))


@query("archive_old", f"""
SELECT *, CASE WHEN order_date < DATE '{AS_OF}' - 730 THEN DATE '{AS_OF}' END AS archived_at FROM ({_ORDER_DAY_SQL.format('')})""")
def archive_old(spark, folder):
    kept, archived = patterns.archive_old(_order_days(read(spark, folder, "orders")), "order_date", patterns.last_days(AS_OF, 730), F.lit(AS_OF))
    return kept.withColumn("archived_at", F.lit(None).cast("date")).unionByName(archived)


def _dim_customer(spark, folder):
    nation = read(spark, folder, "nation")
    return (read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") + 1000).alias("customer_key"), F.col("c_name").alias("full_name"),
                    F.when(F.col("n_nationkey") != 24, F.col("n_name")).alias("country")))


def _keyed_fact(spark, folder):
    fact = patterns.lookup(fact_of(spark, folder), _dim_customer(spark, folder), ["customer_id"], ["customer_key"])
    return fact.select("order_date", "customer_key", "order_count", "total_quantity", "total_amount")


@query("refresh_summary", f"""
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start, CASE WHEN n_nationkey = 24 THEN 'Unknown' ELSE n_name END AS country, count(DISTINCT customer_id) AS customers,
       CAST(sum(order_count) AS BIGINT) AS orders, CAST(sum(total_amount) AS DOUBLE) AS amount
FROM ({_FACT_SQL}) JOIN customer ON c_custkey = customer_id JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def refresh_summary(spark, folder):
    return patterns.sales_summary(_keyed_fact(spark, folder), _dim_customer(spark, folder)).withColumn("amount", dbl("amount"))


@query("stage_customer", f"""
SELECT c_custkey AS customer_id, trim(' ' || c_name) || ' ' || trim(c_mktsegment || ' ') AS full_name, lower(c_name || '@' || c_mktsegment || '.com') AS email,
       lower(c_mktsegment || '.com') AS email_domain, DATE '{AS_OF}' AS load_date FROM customer WHERE c_acctbal > 0""")
def stage_customer(spark, folder):
    email = F.concat(F.col("c_name"), F.lit("@"), F.col("c_mktsegment"), F.lit(".com"))
    return read(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("customer_id"), scalar.full_name(F.concat(F.lit(" "), "c_name"), F.concat("c_mktsegment", F.lit(" "))).alias("full_name"),
        F.lower(email).alias("email"), F.lower(scalar.text_after(email, "@")).alias("email_domain"), F.lit(AS_OF).alias("load_date"))


@query("dim_date", """
WITH d AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)
SELECT CAST(year(date) * 10000 + month(date) * 100 + day(date) AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name, CAST(year(date) + CASE WHEN month(date) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year
FROM d WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE month(o_orderdate) % 2 = 0)""")
def dim_date(spark, folder):
    days = read(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"))
    first, last = days.agg(F.min("date"), F.max("date")).first()
    return patterns.missing_dates(days.where(F.month("date") % 2 == 0).distinct(), patterns.dim_date(spark, first, last))


@query("surrogate_keys", """
SELECT c_custkey, (SELECT max(c_custkey + 500) FROM customer WHERE c_custkey % 3 = 0) + row_number() OVER (ORDER BY c_custkey) AS customer_key FROM customer WHERE c_custkey % 3 <> 0""")
def surrogate_keys(spark, folder):
    customer = read(spark, folder, "customer")
    existing = customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 500).alias("customer_key"))
    return patterns.surrogate_keys(customer.where("c_custkey % 3 <> 0").select("c_custkey"), ["c_custkey"], "customer_key", existing)


@query("load_all_totals", f"""
WITH f AS (SELECT * FROM ({_FACT_SQL}) JOIN customer ON c_custkey = customer_id),
s AS (SELECT date_trunc('month', order_date) AS m, CASE WHEN n_nationkey = 24 THEN 'Unknown' ELSE n_name END AS c, sum(order_count) AS o, sum(total_amount) AS a
      FROM f JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT 'customers' AS check_name, count(*) AS rows, CAST(count(DISTINCT c_nationkey) FILTER (c_nationkey <> 24) AS DOUBLE) AS total_1, CAST(sum(c_custkey) AS DOUBLE) AS total_2 FROM customer
UNION ALL SELECT 'daily sales', count(*), CAST(sum(order_count) AS DOUBLE), CAST(sum(total_amount) AS DOUBLE) FROM f
UNION ALL SELECT 'summary', count(*), CAST(sum(o) AS DOUBLE), CAST(sum(a) AS DOUBLE) FROM s""")
def load_all_totals(spark, folder):
    customers, fact = _dim_customer(spark, folder), _keyed_fact(spark, folder)
    summary = patterns.sales_summary(fact, customers)

    def total(df, name, first, second):
        return df.agg(F.count(F.lit(1)).alias("rows"), dbl(first).alias("total_1"), dbl(second).alias("total_2")).select(F.lit(name).alias("check_name"), "rows", "total_1", "total_2")
    return (total(customers, "customers", F.countDistinct("country"), F.sum("customer_id"))
            .unionByName(total(fact, "daily sales", F.sum("order_count"), F.sum("total_amount")))
            .unionByName(total(summary, "summary", F.sum("orders"), F.sum("amount"))))


@query("full_load_log", f"""
WITH f AS (SELECT f.* FROM ({_FACT_SQL}) f JOIN customer ON c_custkey = customer_id), m AS (SELECT DISTINCT date_trunc('month', order_date) AS m, c_nationkey AS n FROM f JOIN customer ON c_custkey = customer_id)
SELECT 1 AS step, 'dim_date' AS name, CAST(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS BIGINT) AS rows_loaded FROM orders
UNION ALL SELECT 2, 'dim_product', count(*) FROM part UNION ALL SELECT 3, 'dim_customer', count(*) FROM customer
UNION ALL SELECT 4, 'fact_daily_sales', count(*) FROM f UNION ALL SELECT 5, 'sales_summary', count(*) FROM m""")
def full_load_log(spark, folder):
    """The steps of a full load that was broken off in its third step and run again."""
    orders = read(spark, folder, "orders")
    first, last = orders.agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    failures = [RuntimeError("broken off")]

    def customers():
        if failures:
            raise failures.pop()
        return read(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") + 1000).alias("customer_key"), F.col("c_nationkey").cast("string").alias("country"))
    sources = {
        "customer": customers, "product": lambda: read(spark, folder, "part"),
        "orders": lambda: orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status")),
        "lines": lambda: read(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), scalar.line_amount(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")).alias("amount"))}
    places = {n: (f"dm_{n}_{uuid.uuid4().hex[:12]}", scratch_path(spark, n)) for n in ("dim_date", "dim_product", "dim_customer", "fact_daily_sales", "sales_summary")}
    log = new_table(spark, "load_log", warehouse.LOG_COLUMNS)
    load = lambda: warehouse.full_load(spark, sources, places, log, "night", first, last, CANCELLED)
    try:
        load()
    except RuntimeError:
        pass
    return load().select("step", "name", "rows_loaded")


@query("lookup_matched", """
SELECT o_orderkey, c_custkey + 1000 AS customer_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def lookup_matched(spark, folder):
    return patterns.lookup(*_lookup_sides(spark, folder)).select("o_orderkey", "customer_key")


@query("lookup_unmatched", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0")
def lookup_unmatched(spark, folder):
    return patterns.lookup_unmatched(*_lookup_sides(spark, folder)).select("o_orderkey")


def _lookup_sides(spark, folder):
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    reference = read(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") + 1000).alias("customer_key"))
    return orders, reference, ["customer_id"], ["customer_key"]


# ---------------------------------------------------------------- generated rows

_COLUMNS = [
    generate.ColumnSpec("CustomerId", "int", "INT", None, False), generate.ColumnSpec("FullName", "nvarchar", "STRING", 10, False),
    generate.ColumnSpec("Email", "varchar", "STRING", 12), generate.ColumnSpec("StartDate", "date", "DATE"), generate.ColumnSpec("EndDate", "date", "DATE"),
    generate.ColumnSpec("Rate", "decimal", "DECIMAL(4,2)"), generate.ColumnSpec("IsActive", "bit", "BOOLEAN", None, False), generate.ColumnSpec("Score", "int", "INT"),
]
_GENERATED_SQL = """
WITH g AS (SELECT i, i = n - 1 AS last FROM (SELECT count(*) AS n FROM customer), LATERAL (SELECT unnest(range(n)) AS i))
SELECT CAST(i + 1 AS INTEGER) AS "CustomerId", substr(['Asha Patil','Rahul Sharma','Maria Garcia','John Smith','Wei Chen'][i % 5 + 1], 1, 10) AS "FullName",
       CASE WHEN NOT last THEN substr('user' || (i + 1) || '@example.com', 1, 12) END AS "Email", CASE WHEN NOT last THEN DATE '2024-01-15' + CAST(i * 37 AS INTEGER) END AS "StartDate",
       CASE WHEN NOT last THEN DATE '2024-01-15' + CAST(i * 37 + 90 AS INTEGER) END AS "EndDate", CASE WHEN NOT last THEN [99.99, 99.99, 99.99, 7.25, 99.99][i % 5 + 1]::DOUBLE END AS "Rate",
       i % 2 = 0 AS "IsActive", CASE WHEN NOT last THEN [10, 250, 42, 120, 5][i % 5 + 1] END AS "Score" FROM g"""


def _generated(spark, folder):
    return generate.generate(spark, "Customer", _COLUMNS, read(spark, folder, "customer").count())


@query("generate_rows", _GENERATED_SQL)
def generate_rows(spark, folder):
    return _generated(spark, folder).withColumn("Rate", dbl("Rate"))


_INVENTORY = """table_name,column_name,ordinal,data_type,max_length,precision,scale,is_nullable
Orders,OrderId,1,int,4,10,0,NO
Orders,CustomerId,2,int,4,10,0,YES
Orders,Note,3,nvarchar,16,,,YES
Customers,CustomerId,1,int,4,10,0,NO
Customers,FullName,2,nvarchar,12,,,NO
OrderLines,LineId,1,int,4,10,0,NO
OrderLines,OrderId,2,int,4,10,0,NO"""


@query("generate_tables", """
WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l)
SELECT 1 AS nth, 'Customers' AS name, c AS rows, CAST(NULL AS BIGINT) AS parents, CAST(NULL AS BIGINT) AS orphans, 6 AS longest FROM n
UNION ALL SELECT 2, 'Orders', o, least(c, o), 0, 8 FROM n UNION ALL SELECT 3, 'OrderLines', l, least(o, l), 0, NULL FROM n""")
def generate_tables(spark, folder):
    """As many made-up rows as the given tables have, parents first; keys that refer to a parent all exist there, texts fit their declared bytes."""
    size = {n: read(spark, folder, t).count() for n, t in (("Customers", "customer"), ("Orders", "orders"), ("OrderLines", "lineitem"))}
    lines = [r.split(",") for r in _INVENTORY.splitlines()]
    inventory = spark.createDataFrame([dict(zip(lines[0], [v or None for v in r])) for r in lines[1:]], ", ".join(f"{c} string" for c in lines[0]))
    typed = map_types(inventory.select("table_name", "column_name", F.col("ordinal").cast("int"), "data_type", F.col("max_length").cast("double"), "precision", "scale",
                                       (F.col("is_nullable") == "YES").alias("nullable")), "sqlserver")
    made = generate.generate_tables(spark, typed, "sqlserver", size)
    key, text = {"Orders": ("CustomerId", "Customers"), "OrderLines": ("OrderId", "Orders")}, {"Customers": "FullName", "Orders": "Note"}
    rows = []
    for nth, (name, df) in enumerate(made.items(), 1):
        longest = F.max(F.length(text[name])) if name in text else F.lit(None)
        one = df.agg(F.count(F.lit(1)).alias("rows"), longest.cast("int").alias("longest"), *([F.countDistinct(key[name][0]).alias("parents")] if name in key else []))
        one = one if name in key else one.withColumn("parents", F.lit(None).cast("bigint"))
        orphans = F.lit(None).cast("bigint")
        if name in key:
            column, parent = key[name]
            orphans = F.lit(df.where(F.col(column).isNotNull()).join(made[parent], column, "left_anti").count()).cast("bigint")
        rows.append(one.select(F.lit(nth).alias("nth"), F.lit(name).alias("name"), "rows", "parents", orphans.alias("orphans"), "longest"))
    return reduce(DataFrame.unionByName, rows)


@query("insert_literals", """
SELECT o_orderkey, '(' || o_orderkey || ', DATE''' || strftime(o_orderdate, '%Y-%m-%d') || ''', ''' || replace(CASE WHEN o_orderkey % 5 = 0 THEN 'O''Hara \\ ' || o_orderpriority ELSE o_orderpriority END, '\\', '\\\\')
         .replace('''', '\\''') || ''', ' || CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'FALSE' END || ', ' || CASE WHEN o_orderkey % 7 = 0 THEN 'NULL' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END || ')' AS literal
FROM orders""")
def insert_literals(spark, folder):
    k = F.col("o_orderkey")
    rows = read(spark, folder, "orders").select(
        k, F.to_date("o_orderdate").alias("d"), F.when(k % 5 == 0, F.concat(F.lit("O'Hara \\ "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("p"),
        (F.col("o_orderstatus") == OPEN).alias("b"), F.when(k % 7 != 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("a"))
    types = {"o_orderkey": "BIGINT", "d": "DATE", "p": "STRING", "b": "BOOLEAN", "a": "DECIMAL(12,2)"}
    return rows.select("o_orderkey", generate.insert_literals(rows, types).alias("literal"))


_DEMO_AS_OF = datetime(2026, 10, 14, 12, 0)


@query("demo_sales_totals", f"""
WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM part) AS p),
cu AS (SELECT unnest(range(1, c + 1)) AS i FROM n), pr AS (SELECT unnest(range(1, p + 1)) AS i FROM n),
od AS (SELECT i, (i * 37) % c + 1 AS customer, CASE i % 40 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Open' ELSE 'Shipped' END AS status FROM n, LATERAL (SELECT unnest(range(1, o + 1)) AS i)),
li AS (SELECT i + 100000 AS order_id, customer, status, k, (((i + 100000) * 7 + k * 13) % (SELECT p FROM n)) + 1 AS product FROM od, (VALUES (1), (2), (3), (4)) l(k) WHERE k <= (i + 100000) % 4 + 1)
SELECT (SELECT count(*) FROM cu WHERE i % 25 <> 0) AS customers, (SELECT CAST(sum(i) AS BIGINT) FROM cu WHERE i % 25 <> 0) AS customer_ids,
       (SELECT count(*) FROM pr) AS products, (SELECT CAST(sum(10 + (i * 37) % 990 + 0.99) AS DOUBLE) FROM pr) AS list_price,
       count(DISTINCT order_id) AS orders, CAST(sum(((order_id + k) % 5 + 1) * (10 + (product * 37) % 990 + 0.99) * (1 - CASE WHEN (order_id + k) % 10 = 0 THEN 0.1 ELSE 0.0 END)) AS DOUBLE) AS amount
FROM li WHERE status <> 'Cancelled' AND customer % 25 <> 0""")
def demo_sales_totals(spark, folder):
    size = lambda t: read(spark, folder, t).count()
    made = generate.demo_warehouse(generate.demo_sales(spark, _DEMO_AS_OF, size("customer"), size("part"), size("orders")))
    customers = made["dim_customer"].agg(F.count(F.lit(1)).alias("customers"), F.sum("customer_id").alias("customer_ids"))
    products = made["dim_product"].agg(F.count(F.lit(1)).alias("products"), dbl(F.sum("list_price")).alias("list_price"))
    fact = made["fact_daily_sales"].agg(F.sum("order_count").alias("orders"), dbl(F.sum("total_amount")).alias("amount"))
    parts = customers.unionByName(products, allowMissingColumns=True).unionByName(fact, allowMissingColumns=True)  # one row each
    return parts.agg(*[F.max(c).alias(c) for c in ("customers", "customer_ids", "products", "list_price", "orders", "amount")])
