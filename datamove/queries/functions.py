"""Scalar functions as legacy dialects use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove.functions import scalar
from datamove.queries.base import AS_OF, OPEN, dbl, query, read


@query("fn_string", """
SELECT c_custkey, trim('  ' || c_name || ' ') AS trimmed, upper(c_name) AS up, lower(c_name) AS low, c_name || '-' || c_mktsegment AS joined,
       CAST(instr(c_name, '#') AS INTEGER) AS at, substr(c_name, instr(c_name, '#') + 1) AS after, CAST(length(c_name) AS INTEGER) AS len FROM customer""")
def fn_string(spark, folder):
    name = F.col("c_name")
    return read(spark, folder, "customer").select(
        "c_custkey", F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.upper(name).alias("up"), F.lower(name).alias("low"),
        F.concat(name, F.lit("-"), "c_mktsegment").alias("joined"), scalar.find_text(name, "#").alias("at"), scalar.text_after(name, "#").alias("after"), F.length(name).alias("len"))


@query("fn_null", "SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END, 'n/a') AS segment FROM customer")
def fn_null(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_nationkey") >= 5, F.col("c_mktsegment")), F.lit("n/a")).alias("segment"))


@query("fn_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CASE WHEN sign(o_custkey - 300) = 1 THEN 'NEW' ELSE 'EARLY' END AS cohort,
       CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS choice, CASE o_orderkey % 40 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Open' ELSE 'Shipped' END AS status FROM orders""")
def fn_conditional(spark, folder):
    k = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        k, scalar.iif(F.col("o_totalprice") > 100000, F.lit("big"), F.lit("small")).alias("size"),
        F.expr("decode(CAST(sign(o_custkey - 300) AS INT), 1, 'NEW', 'EARLY')").alias("cohort"), scalar.choose(k % 5 + 1, ["a", "b", "c"]).alias("choice"),
        F.when(k % 40 == 0, "Cancelled").when(k % 40 == 1, "Open").otherwise("Shipped").alias("status"))


@query("fn_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, monthname(o_orderdate) AS month_name,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS first_of_month, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(o_orderdate AS DATE) AS day FROM orders""")
def fn_date_parts(spark, folder):
    d = F.col("o_orderdate")
    return read(spark, folder, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.date_format(d, "MMMM").alias("month_name"),
        scalar.month_start(d).alias("first_of_month"), scalar.date_key(d).alias("date_key"), F.to_date(d).alias("day"))


@query("fn_date_arith", f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS due, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS age_days,
       o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AS stale, CAST(o_orderdate AS DATE) - 7 AS week_before FROM orders""")
def fn_date_arith(spark, folder):
    d, as_of = F.col("o_orderdate"), F.lit(AS_OF)
    return read(spark, folder, "orders").select(
        "o_orderkey", F.date_add(d, 30).alias("due"), scalar.days_between(d, as_of).alias("age_days"),
        (d < as_of.cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")).alias("stale"), F.date_sub(d, 7).alias("week_before"))


@query("fn_date_format", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second FROM events")
def fn_date_format(spark, folder):
    return read(spark, folder, "events").select("event_id", scalar.iso_date(F.col("ts")).alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"))


@query("fn_math", """
SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * 1.18, 1) AS DOUBLE) AS rounded,
       CAST(CAST(l_quantity AS DECIMAL(10,0)) * CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,4))) AS DOUBLE) AS amount, l_partkey % 7 AS remainder FROM lineitem""")
def fn_math(spark, folder):
    taxed = F.col("l_extendedprice").cast("decimal(12,2)") * F.lit("1.18").cast("decimal(3,2)")
    return read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", dbl(F.round(taxed, 1)).alias("rounded"),
        dbl(scalar.line_amount(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"))).alias("amount"), (F.col("l_partkey") % 7).alias("remainder"))


@query("fn_cast", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, CAST(o_orderkey AS VARCHAR) AS key_text,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number FROM orders""")
def fn_cast(spark, folder):
    return read(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("o_orderkey").cast("string").alias("key_text"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderpriority").try_cast("int").alias("not_a_number"))


@query("fn_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def fn_json_path(spark, folder):
    return read(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"), F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("fn_explode", "SELECT event_id, j.key AS name, CAST(j.value AS INTEGER) AS number FROM events, json_each(CAST(props AS JSON)) j")
def fn_explode(spark, folder):
    return read(spark, folder, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "number"))


@query("fn_bool_flag", "SELECT o_orderkey, o_orderstatus = 'O' AS is_open FROM orders WHERE (o_orderstatus = 'O') = TRUE OR o_totalprice < 5000")
def fn_bool_flag(spark, folder):
    flagged = read(spark, folder, "orders").withColumn("is_open", F.col("o_orderstatus") == OPEN)
    return flagged.where((F.col("is_open") == F.lit(True)) | (F.col("o_totalprice") < 5000)).select("o_orderkey", "is_open")


@query("fn_text_search", """
SELECT doc_id, text ILIKE '%THE%' AS has_the, regexp_matches(text, '(^|[^A-Za-z0-9_])[Ii]s [a-z]+ [0-9]') AS number_after_is FROM documents WHERE text ILIKE '%on%' OR regexp_matches(text, '[0-9]{3}')""")
def fn_text_search(spark, folder):
    text = F.col("text")
    return read(spark, folder, "documents").where(text.ilike("%on%") | text.rlike("[0-9]{3}")).select(
        "doc_id", text.ilike("%THE%").alias("has_the"), text.rlike("(^|[^A-Za-z0-9_])[Ii]s [a-z]+ [0-9]").alias("number_after_is"))


@query("fn_fiscal_year", """
SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS by_column,
       CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS by_function FROM orders""")
def fn_fiscal_year(spark, folder):
    scalar.register_sql_functions(spark)
    return read(spark, folder, "orders").select("o_orderkey", scalar.fiscal_year(F.col("o_orderdate")).alias("by_column"),
                                                F.expr("fiscal_year(CAST(o_orderdate AS DATE))").alias("by_function"))
