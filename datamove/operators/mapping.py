"""Pair source tables and columns with target tables and columns, and say which tables are ready to copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datamove import fixed_values as fixed


def short_name(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"`?([^.`]*)`?$", 1))


def pair_tables(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, default_target) against (target): the default if it exists, else the only target of the same name,
    else the default with exists = false."""
    named = targets.select("target", F.lower("target").alias("_lower"), short_name(F.col("target")).alias("_short"))
    by_full = named.groupBy(F.col("_lower").alias("_full")).agg(F.min("target").alias("_exact"))
    only = named.groupBy("_short").agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("_only")).where("_n = 1")
    found = (sources.withColumn("_full", F.lower("default_target")).withColumn("_short", short_name(F.col("source")))
             .join(by_full, "_full", "left").join(only, "_short", "left"))
    target = F.coalesce("_exact", "_only")
    return found.select("source", F.coalesce(target, F.col("default_target")).alias("target"),
                        target.isNotNull().alias("exists"))


def pair_columns(source_columns: DataFrame, target_columns: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Pair (table_name, column_name) rows of both sides: a saved mapping (table_name, target_column, source_column)
    first, then the same name. One row per pair or unpaired column, with `pairing` = paired | target_without_source |
    source_not_copied."""
    norm = lambda df: df.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("name"))
    target, source = norm(target_columns), norm(source_columns)
    if mapping is not None:
        saved = mapping.select(F.lower("table_name").alias("table_name"), F.lower("target_column").alias("name"),
                               F.lower(F.coalesce("source_column", F.lit(""))).alias("saved"))
        target = target.join(saved, ["table_name", "name"], "left")
    else:
        target = target.withColumn("saved", F.lit(None).cast("string"))
    target = target.select("table_name", F.col("name").alias("target_column"),
                           F.coalesce("saved", "name").alias("wanted"))
    source = source.select(F.col("table_name").alias("_st"), F.col("name").alias("source_column"))
    joined = target.join(source, (F.col("table_name") == F.col("_st")) & (F.col("wanted") == F.col("source_column")), "full")
    pairing = (F.when(F.col("source_column").isNull(), "target_without_source")
               .when(F.col("target_column").isNull(), "source_not_copied").otherwise("paired"))
    return joined.select(F.coalesce("table_name", "_st").alias("table_name"), "target_column", "source_column",
                         pairing.alias("pairing"))


def mapping_status(tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Status per table of (table_name, load, target_exists, source_exists) with its column pairs."""
    n = lambda kind: F.count_if(F.col("pairing") == kind)
    counts = pairs.groupBy(F.col("table_name").alias("_t")).agg(
        n("paired").alias("_paired"), n("target_without_source").alias("_missing"), n("source_not_copied").alias("_unused"))
    joined = tables.join(counts, F.lower("table_name") == F.col("_t"), "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (F.when(~F.col("target_exists"), "no target table").when(~F.col("load"), "compare only")
              .when(~F.col("source_exists"), "no source table").when(value("_paired") == 0, "no matching columns")
              .when((value("_missing") > 0) | (value("_unused") > 0), "check columns").otherwise("ready"))
    return joined.select("table_name", status.alias("status"), value("_paired").alias("paired"),
                         value("_missing").alias("target_without_source"), value("_unused").alias("source_not_copied"))


def schema_map(schemas: DataFrame, explicit: DataFrame, default: str) -> DataFrame:
    """Target schema of every source schema: its explicit entry (any case) first, else the default."""
    entries = explicit.select(F.lower("source_schema").alias("_key"), "target_schema").dropDuplicates(["_key"])
    return (schemas.join(entries, F.lower("schema_name") == F.col("_key"), "left")
            .select("schema_name", F.coalesce("target_schema", F.lit(default)).alias("target_schema")))


def column_differences(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Columns on one side only, names compared in any case: (table_name, column_name, only_in)."""
    norm = lambda df: df.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    left, right = norm(source_columns), norm(target_columns)
    keys = ["table_name", "column_name"]
    return (left.join(right, keys, "left_anti").withColumn("only_in", F.lit("source"))
            .unionByName(right.join(left, keys, "left_anti").withColumn("only_in", F.lit("target"))))


def boolean_columns(inventory: DataFrame) -> DataFrame:
    """Names of the columns whose source type is a flag."""
    return (inventory.where(F.lower(F.trim("data_type")).isin(fixed.BOOLEAN_TYPE_NAMES))
            .select(F.lower("column_name").alias("column_name")).distinct())


def doubled_targets(mappings: DataFrame) -> DataFrame:
    """Targets fed by more than one source (a warning, not an error)."""
    return (mappings.groupBy(F.lower("target").alias("target")).agg(F.count(F.lit(1)).alias("sources"))
            .where("sources > 1"))
