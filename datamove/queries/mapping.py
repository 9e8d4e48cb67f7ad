"""Schema mapping and typing. The table and column lists are derived from the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove.operators import mapping, typing
from datamove.queries.base import query, read
from datamove.session import scratch_path
from datamove.sources import tables

# Source type names given out in turn to the part rows, each with the SQL Server mapping expected for it.
_TYPES = [
    ("bit", "BOOLEAN"), ("tinyint", "SMALLINT"), ("smallint", "SMALLINT"), ("int", "INT"), ("bigint", "BIGINT"), ("real", "FLOAT"),
    ("float", "DOUBLE"), ("float(24)", "FLOAT"), ("float(53)", "DOUBLE"), ("money", "DECIMAL(19,4)"), ("smallmoney", "DECIMAL(10,4)"),
    ("date", "DATE"), ("DateTime2", "TIMESTAMP"), ("datetimeoffset(3)", "TIMESTAMP"), ("time(7)", "STRING"), ("timestamp", "BINARY"),
    ("NVARCHAR(50)", "STRING"), ("uniqueidentifier", "STRING"), ("xml", "STRING"), ("varbinary(max)", "BINARY"), ("rowversion", "BINARY"),
    ("timestamp with time zone", "TIMESTAMP"), ("interval year", "STRING"), ("weirdtype", "STRING"), ("decimal", None), ("Numeric ( 12 , 4 )", "DECIMAL(12,4)"),
]
_TYPE_LIST = ", ".join(f"'{t}'" for t, _ in _TYPES)
_TYPED_SQL = f"""
  SELECT p_partkey, list_extract([{_TYPE_LIST}], CAST(p_partkey % {len(_TYPES)} AS BIGINT) + 1) AS data_type,
         CASE WHEN p_partkey % {len(_TYPES)} = 24 THEN p_size ELSE NULL END AS prec, p_partkey % 7 AS sc FROM part"""
_TYPE_CASES = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in _TYPES if m)


def _typed_parts(spark, folder):
    nth = F.element_at(F.array(*[F.lit(t) for t, _ in _TYPES]), (F.col("p_partkey") % len(_TYPES) + 1).cast("int"))
    is_decimal = F.col("p_partkey") % len(_TYPES) == 24
    return read(spark, folder, "part").select("p_partkey", "p_brand", nth.alias("data_type"), F.when(is_decimal, F.col("p_size")).alias("precision"),
                                              F.when(is_decimal, F.col("p_partkey") % 7).alias("scale"))


_TARGET_SQL = f"""CASE WHEN data_type = 'decimal' THEN CASE WHEN coalesce(prec, 0) = 0 THEN 'DECIMAL(38,10)'
         ELSE 'DECIMAL(' || least(prec, 38) || ',' || least(sc, least(prec, 38)) || ')' END ELSE CASE data_type {_TYPE_CASES} END END"""


@query("type_map", f"WITH t AS ({_TYPED_SQL})\nSELECT p_partkey, data_type, {_TARGET_SQL} AS target_type, data_type <> 'weirdtype' AS known FROM t")
def type_map(spark, folder):
    return typing.map_types(_typed_parts(spark, folder), "sqlserver").select("p_partkey", "data_type", "target_type", "known")


@query("ddl_from_inventory", f"""
WITH t AS ({_TYPED_SQL}), d AS (SELECT *, {_TARGET_SQL} AS target_type, 'T' || CAST(p_partkey // 20 AS BIGINT) AS table_name FROM t)
SELECT table_name, 'CREATE TABLE IF NOT EXISTS main.dev.`' || table_name || '` (' ||
       string_agg('`c' || p_partkey || '` ' || target_type || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' NOT NULL' END, ', ' ORDER BY p_partkey) || ')' AS statement,
       coalesce(string_agg('c' || p_partkey || ' (' || data_type || ')', ', ' ORDER BY p_partkey) FILTER (data_type = 'weirdtype'), '') AS review
FROM d WHERE CAST(p_partkey // 20 AS BIGINT) NOT IN (SELECT n_nationkey FROM nation) GROUP BY table_name""")
def ddl_from_inventory(spark, folder):
    typed = typing.map_types(_typed_parts(spark, folder), "sqlserver")
    columns = typed.select(F.lit("dbo").alias("schema_name"), F.concat(F.lit("T"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("table_name"),
                           F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"), F.col("p_partkey").alias("ordinal"),
                           "data_type", (F.col("p_partkey") % 2 == 0).alias("nullable"), "target_type", "known")
    existing = read(spark, folder, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("table_name"))
    return typing.table_definitions(columns, "main.dev", existing).select("table_name", "statement", "review")


def _inventory(spark, folder):
    """An inventory file written from the part rows, read back."""
    rows = read(spark, folder, "part").selectExpr(
        "'s' || p_size % 3 AS Schema_Name", "p_brand || '_' || p_partkey DIV 100 AS Table_Name", "p_name || ' ' || p_partkey AS Column_Name", "p_partkey AS Ordinal",
        "CASE WHEN p_partkey % 4 = 0 THEN 'bit' ELSE 'int' END AS Data_Type", "p_size AS Max_Length", "10 AS Precision", "0 AS Scale",
        "CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'NO' END AS Is_Nullable", "'1,' || lpad(CAST(p_size AS STRING), 3, '0') AS Row_Count",
        "p_retailprice AS Size_MB")
    place = scratch_path(spark, "inventory")
    rows.write.option("header", "true").option("sep", ";").csv(place)
    return tables.read_inventory(spark, place)


@query("inventory_tables", """
SELECT 's' || p_size % 3 AS schema_name, p_brand || '_' || p_partkey // 100 AS table_name, CAST(max(1000 + p_size) AS DOUBLE) AS rows, max(p_retailprice) AS size_mb, count(*) AS columns,
       arg_min(p_name || ' ' || p_partkey, p_partkey) AS first_column, count(*) FILTER (p_partkey % 2 = 0) AS nullable_columns
FROM part GROUP BY 1, 2""")
def inventory_tables(spark, folder):
    return tables.inventory_tables(_inventory(spark, folder)).select(
        "schema_name", "table_name", "rows", "size_mb", F.size("columns").cast("bigint").alias("columns"), F.col("columns")[0]["column_name"].alias("first_column"),
        F.size(F.filter("columns", lambda c: c["nullable"])).cast("bigint").alias("nullable_columns"))


@query("inventory_summary", """
WITH t AS (SELECT 's' || p_size % 3 AS s, p_brand || '_' || p_partkey // 100 AS tab, count(*) AS n, max(1000 + p_size) AS r, max(p_retailprice) AS m FROM part GROUP BY 1, 2)
SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS columns, CAST(sum(r) AS BIGINT) AS rows, CAST(round(sum(CAST(m AS DECIMAL(18,2))), 1) AS DOUBLE) AS size_mb,
       string_agg(DISTINCT s, ',' ORDER BY s) AS schemas FROM t""")
def inventory_summary(spark, folder):
    return tables.inventory_summary(_inventory(spark, folder))


@query("catalog_inventory", """
SELECT * FROM (VALUES ('r_regionkey', 1), ('r_name', 2)) v(column_name, ordinal), (SELECT 'region' AS table_name, count(*) AS row_count FROM region) UNION ALL
SELECT * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) v(column_name, ordinal), (SELECT 'nation' AS table_name, count(*) AS row_count FROM nation) UNION ALL
SELECT * FROM (VALUES ('c_custkey', 1), ('c_name', 2), ('c_nationkey', 3), ('c_acctbal', 4), ('c_mktsegment', 5)) v(column_name, ordinal), (SELECT 'customer' AS table_name, count(*) AS row_count FROM customer)""")
def catalog_inventory(spark, folder):
    return tables.catalog_inventory({f"sales.{t}": read(spark, folder, t) for t in ("region", "nation", "customer")}).select(
        "column_name", "ordinal", "table_name", "row_count")


_TARGETS_SQL = """
  SELECT lower('main.dev.' || c_name) AS target FROM customer WHERE c_custkey % 3 = 0 UNION ALL
  SELECT 'main.other.' || c_name FROM customer WHERE c_custkey % 3 = 1 UNION ALL
  SELECT 'main.a.' || c_name FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 2 = 0 UNION ALL
  SELECT 'main.b.' || c_name FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 2 = 0"""


@query("pair_tables", """
SELECT 'sales.' || c_name AS source, CASE c_custkey % 3 WHEN 0 THEN lower('main.dev.' || c_name) WHEN 1 THEN 'main.other.' || c_name ELSE 'main.dev.' || c_name END AS target,
       c_custkey % 3 <> 2 AS "exists" FROM customer""")
def pair_tables(spark, folder):
    customer = read(spark, folder, "customer")
    sources = customer.selectExpr("'sales.' || c_name AS source", "'main.dev.' || c_name AS default_target")
    made = lambda prefix, keep, name="c_name": customer.where(keep).selectExpr(f"'{prefix}' || {name} AS target")
    two = "c_custkey % 3 = 2 AND c_custkey % 2 = 0"
    targets = (made("main.dev.", "c_custkey % 3 = 0", "lower(c_name)").unionByName(made("main.other.", "c_custkey % 3 = 1"))
               .unionByName(made("main.a.", two)).unionByName(made("main.b.", two)))
    return mapping.pair_tables(sources, targets)


_COLUMNS_SQL = """
  s AS (SELECT 't' || c_nationkey AS table_name, 'col_' || c_custkey AS name FROM customer WHERE c_custkey % 5 <> 0),
  t AS (SELECT 't' || c_nationkey AS table_name, 'col_' || c_custkey AS name,
               CASE WHEN c_custkey % 11 = 0 THEN 'old_' || c_custkey ELSE 'col_' || c_custkey END AS wanted FROM customer WHERE c_custkey % 7 <> 0),
  s2 AS (SELECT * FROM s UNION ALL SELECT 't' || c_nationkey, 'old_' || c_custkey FROM customer WHERE c_custkey % 22 = 0),
  pairs AS (SELECT coalesce(t.table_name, s2.table_name) AS table_name, t.name AS target_column, s2.name AS source_column,
                   CASE WHEN s2.name IS NULL THEN 'target_without_source' WHEN t.name IS NULL THEN 'source_not_copied' ELSE 'paired' END AS pairing
            FROM t FULL JOIN s2 ON t.table_name = s2.table_name AND t.wanted = s2.name)"""


def _column_sides(spark, folder):
    customer = read(spark, folder, "customer")
    side = lambda keep, prefix, table="'T' || c_nationkey": customer.where(keep).selectExpr(f"{table} AS table_name", f"'{prefix}' || c_custkey AS column_name")
    source = side("c_custkey % 5 <> 0", "COL_").unionByName(side("c_custkey % 22 = 0", "OLD_"))
    saved = customer.where("c_custkey % 11 = 0").selectExpr("'t' || c_nationkey AS table_name", "'Col_' || c_custkey AS target_column", "'old_' || c_custkey AS source_column")
    return source, side("c_custkey % 7 <> 0", "Col_"), saved


@query("pair_columns", f"WITH {_COLUMNS_SQL}\nSELECT table_name, target_column, source_column, pairing FROM pairs")
def pair_columns(spark, folder):
    return mapping.pair_columns(*_column_sides(spark, folder))


@query("mapping_status", f"""
WITH {_COLUMNS_SQL}, n AS (SELECT table_name, count(*) FILTER (pairing = 'paired') AS p, count(*) FILTER (pairing = 'target_without_source') AS m,
       count(*) FILTER (pairing = 'source_not_copied') AS u FROM pairs GROUP BY 1)
SELECT 't' || s_suppkey AS table_name,
       CASE WHEN s_suppkey % 7 = 6 THEN 'no target table' WHEN s_suppkey % 5 = 4 THEN 'compare only' WHEN s_suppkey % 6 = 5 THEN 'no source table'
            WHEN coalesce(p, 0) = 0 THEN 'no matching columns' WHEN m > 0 OR u > 0 THEN 'check columns' ELSE 'ready' END AS status,
       coalesce(p, 0) AS paired, coalesce(m, 0) AS target_without_source, coalesce(u, 0) AS source_not_copied
FROM supplier LEFT JOIN n ON n.table_name = 't' || s_suppkey""")
def mapping_status(spark, folder):
    lists = read(spark, folder, "supplier").selectExpr("'t' || s_suppkey AS table_name", "s_suppkey % 5 <> 4 AS load",
                                                       "s_suppkey % 7 <> 6 AS target_exists", "s_suppkey % 6 <> 5 AS source_exists")
    return mapping.mapping_status(lists, mapping.pair_columns(*_column_sides(spark, folder)))


@query("schema_map", """
SELECT DISTINCT p_brand AS schema_name, CASE WHEN n_nationkey IS NULL THEN 'main.dev' ELSE 'main.n' || n_nationkey END AS target_schema
FROM part LEFT JOIN nation ON upper(p_brand) = 'BRAND#' || n_nationkey""")
def schema_map(spark, folder):
    explicit = read(spark, folder, "nation").selectExpr("'BRAND#' || n_nationkey AS source_schema", "'main.n' || n_nationkey AS target_schema")
    return mapping.schema_map(read(spark, folder, "part").selectExpr("p_brand AS schema_name").distinct(), explicit, "main.dev")


@query("column_differences", f"""
WITH {_COLUMNS_SQL}
SELECT table_name, name AS column_name, 'source' AS only_in FROM s2 WHERE (table_name, name) NOT IN (SELECT (table_name, name) FROM t)
UNION ALL SELECT table_name, name, 'target' FROM t WHERE (table_name, name) NOT IN (SELECT (table_name, name) FROM s2)""")
def column_differences(spark, folder):
    source, target, _ = _column_sides(spark, folder)
    return mapping.column_differences(source, target)


@query("boolean_columns", "SELECT DISTINCT lower(p_name || ' ' || p_partkey) AS column_name FROM part WHERE p_partkey % 4 = 0")
def boolean_columns(spark, folder):
    return mapping.boolean_columns(_inventory(spark, folder))


@query("doubled_targets", "SELECT 't' || o_custkey AS target, count(*) AS sources FROM orders GROUP BY 1 HAVING count(*) > 1")
def doubled_targets(spark, folder):
    return mapping.doubled_targets(read(spark, folder, "orders").selectExpr("'s' || o_orderkey AS source", "'T' || o_custkey AS target"))
