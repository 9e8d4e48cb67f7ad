"""Map source column types onto Spark types, and build table definitions from an inventory of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datamove import fixed_values as fixed


def decimal_type(precision: Column, scale: Column) -> Column:
    """decimal(p,s) as text: no precision -> decimal(38,10); p at most 38; s kept within 0..p."""
    p = F.least(precision, F.lit(fixed.MAX_PRECISION))
    s = F.greatest(F.lit(0), F.least(F.coalesce(scale, F.lit(0)), p))
    return F.when(F.coalesce(precision, F.lit(0)) == 0, fixed.DECIMAL_DEFAULT).otherwise(
        F.concat(F.lit("DECIMAL("), p.cast("string"), F.lit(","), s.cast("string"), F.lit(")")))


def type_rules(spark: SparkSession, db: str) -> DataFrame:
    """The rule table (name, mapped) of one database: shared names with that database's own meanings on top."""
    rules = {**fixed.TYPE_NAMES, **fixed.TYPE_PHRASES}
    for name in fixed.DECIMAL_NAMES:
        rules[name] = "DECIMAL"
    rules.update(fixed.TYPE_OVERRIDES.get(db, {}))
    if db == "teradata":  # catalog codes are upper case; names are looked up in lower case
        rules.update({f"code:{code}": target for code, target in fixed.TERADATA_CODES.items()})
        rules.update({f"code:{code}": "DECIMAL" for code in fixed.TERADATA_DECIMAL_CODES})
    return spark.createDataFrame(sorted(rules.items()), "rule_name string, mapped string")


def _whole(col: Column) -> Column:
    return F.floor(F.trim(col.cast("string")).try_cast("double")).cast("int")


def map_types(columns: DataFrame, db: str) -> DataFrame:
    """Add `target_type` and `known` to rows with data_type, precision, scale. Unknown types become STRING, known = false."""
    raw = F.trim(F.coalesce(F.col("data_type"), F.lit("")))
    arguments = r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
    argument = lambda i: F.regexp_extract(raw, arguments, i).try_cast("int")
    declared = F.nullif(F.trim(F.col("precision").cast("string")), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(raw, r"\s*\(.*$", "")), r"\s+", " "))
    zoned = F.lower(raw).contains("time zone") & plain.startswith("timestamp")
    name = (F.when(zoned & F.lower(raw).contains("without"), "timestamp without time zone")
            .when(zoned, "timestamp with time zone").otherwise(plain))
    prepared = (columns
                .withColumn("_p", F.when(declared.isNull(), argument(1)).otherwise(_whole(F.col("precision"))))
                .withColumn("_s", F.when(declared.isNull(), argument(2)).otherwise(_whole(F.col("scale"))))
                .withColumn("_name", name).withColumn("_code", F.concat(F.lit("code:"), F.upper(raw))))
    rules = F.broadcast(type_rules(columns.sparkSession, db))  # a fixed table of about a hundred rows
    by_code = rules.select(F.col("rule_name").alias("_code"), F.col("mapped").alias("_by_code"))
    by_name = rules.select(F.col("rule_name").alias("_name"), F.col("mapped").alias("_by_name"))
    joined = prepared.join(by_code, "_code", "left").join(by_name, "_name", "left")
    mapped = F.coalesce("_by_code", "_by_name")
    target = F.when(mapped == "DECIMAL", decimal_type(F.col("_p"), F.col("_s")))
    if db in fixed.SINGLE_FLOAT_DATABASES:
        target = target.when((F.col("_name") == "float") & F.col("_p").between(1, fixed.SINGLE_FLOAT_BITS), "FLOAT")
    target = target.when(mapped.isNotNull(), mapped).otherwise("STRING")
    known = mapped.isNotNull() | F.col("_name").startswith("interval")
    return (joined.withColumn("target_type", target).withColumn("known", known)
            .select(*columns.columns, "target_type", "known"))


def quote(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def table_definitions(typed: DataFrame, target_schema: str, defined: DataFrame | None = None) -> DataFrame:
    """One CREATE TABLE per inventory table from typed columns (schema_name, table_name, column_name, ordinal, nullable,
    target_type, known, data_type). Tables named in `defined` (table_name) already exist and are left out."""
    if defined is not None:
        taken = defined.select(F.lower("table_name").alias("_taken")).distinct()
        typed = typed.join(taken, F.lower("table_name") == F.col("_taken"), "left_anti")
    line = F.concat(quote(F.col("column_name")), F.lit(" "), F.col("target_type"),
                    F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    review = F.when(~F.col("known"), F.concat(F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")")))
    grouped = typed.groupBy("schema_name", "table_name").agg(  # a table's columns: a bounded group
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("_lines"),
        F.array_sort(F.collect_list(F.when(review.isNotNull(), F.struct("ordinal", review.alias("note"))))).alias("_review"))
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), ", ")
    return grouped.select(
        "schema_name", "table_name",
        F.concat(F.lit(f"CREATE TABLE IF NOT EXISTS {target_schema}."), quote(F.col("table_name")), F.lit(" ("), body,
                 F.lit(")")).alias("statement"),
        F.array_join(F.transform("_review", lambda x: x["note"]), ", ").alias("review"))
