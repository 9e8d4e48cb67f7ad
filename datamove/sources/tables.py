"""Read tables by name, list them, and describe them as an inventory."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamove import fixed_values as fixed
from datamove.spec import MoveError

_INVENTORY_SCHEMA = ("schema_name string, table_name string, column_name string, ordinal int, data_type string, "
                     "max_length double, precision double, scale double, nullable boolean")


def read_source(spark: SparkSession, table: str, catalog: str = "") -> DataFrame:
    """The source table by name, `catalog.schema.table` when a catalog is given."""
    return spark.table(f"{catalog}.{table}" if catalog else table)


def list_tables(spark: SparkSession, schemas: list[str]) -> list[str]:
    """`schema.table` of every table in the schemas; a schema that does not exist yet, or the catalog's own, is skipped."""
    found = []
    for schema in dict.fromkeys(schemas):
        if schema.split(".")[-1].lower() == "information_schema":
            continue
        try:
            rows = spark.sql(f"SHOW TABLES IN {schema}").where("not isTemporary").select("tableName").collect()
        except AnalysisException as e:
            if e.getCondition() not in ("SCHEMA_NOT_FOUND", "DATABASE_NOT_FOUND"):  # no permission is not the same as no schema
                raise
            continue
        found += [f"{schema}.{r.tableName}" for r in sorted(rows)]
    return found


def _declared_length(f: T.StructField) -> float | None:
    """Characters that a char or varchar column may hold."""
    found = re.search(r"char\((\d+)\)", f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "") or f.dataType.simpleString())
    return float(found[1]) if found else None


def file_megabytes(df: DataFrame) -> float | None:
    """Size of the files that a frame reads, from their listing alone; null where it reads none."""
    files = df.inputFiles()
    if not files:
        return None
    sc = df.sparkSession.sparkContext
    path, conf = sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration()
    return round(sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files) / 1048576, 6)


def catalog_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of live tables (`schema.table` -> frame) in the inventory's layout, with declared lengths and each table's row count and size. Rows of parquet tables
    are counted from file footers."""
    rows, counts = [], []
    for name, df in tables.items():
        schema, _, table = name.rpartition(".")
        for i, f in enumerate(df.schema.fields, 1):
            p, s = (float(f.dataType.precision), float(f.dataType.scale)) if isinstance(f.dataType, T.DecimalType) else (None, None)
            rows.append((schema, table, f.name, i, f.dataType.simpleString(), _declared_length(f), p, s, f.nullable))
        counts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "row_count", F.lit(file_megabytes(df)).cast("double").alias("size_mb")))
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(rows, _INVENTORY_SCHEMA)  # metadata only
    return columns.join(reduce(DataFrame.unionByName, counts), ["schema_name", "table_name"], "left")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The inventory CSV as typed rows: any of the usual delimiters, header in any case, numbers with thousands commas."""
    header = spark.read.text(path).first()
    line = header[0].lstrip("\ufeff") if header else ""
    if not line:
        raise MoveError("The inventory file has no rows.")
    delimiter = max(fixed.INVENTORY_DELIMITERS, key=line.count)
    raw = spark.read.csv(path, header=True, sep=delimiter, multiLine=False)
    names = {c: c.lstrip("\ufeff").strip().lower() for c in raw.columns}
    raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    missing = [c for c in fixed.INVENTORY_REQUIRED if c not in raw.columns]
    if missing:
        raise MoveError(f"The inventory file has no {', '.join(missing)} column; it needs: {', '.join(fixed.INVENTORY_COLUMNS)}.")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    number = lambda c: F.replace(text(c), F.lit(","), F.lit("")).try_cast("double")
    return raw.select(
        *[text(c).alias(c) for c in ("schema_name", "table_name", "column_name", "data_type")],
        number("ordinal").cast("int").alias("ordinal"),
        *[number(c).alias(c) for c in ("max_length", "precision", "scale", "row_count", "size_mb")],
        F.upper(text("is_nullable")).isin(fixed.YES_WORDS).alias("nullable"),
    ).where("table_name <> ''")


def inventory_tables(inventory: DataFrame) -> DataFrame:
    """One row per table with its columns (in order), rows and size; biggest first."""
    columns = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "precision", "scale", "nullable")))
    return (inventory.groupBy("schema_name", "table_name")
            .agg(F.max("row_count").alias("rows"), F.max("size_mb").alias("size_mb"), columns.alias("columns"))
            .orderBy(F.desc(F.coalesce("size_mb", F.lit(0.0))), F.desc(F.coalesce("rows", F.lit(0.0))),
                     "schema_name", "table_name"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """One row: tables, columns, rows, size and the schemas. Two small aggregations: per table, then over the tables."""
    per_table = inventory.groupBy("schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("rows"), F.max("size_mb").alias("size_mb"))
    return per_table.agg(
        F.count(F.lit(1)).alias("tables"), F.sum("columns").alias("columns"),
        F.sum(F.coalesce("rows", F.lit(0.0))).cast("bigint").alias("rows"),
        F.round(F.sum(F.coalesce("size_mb", F.lit(0.0))), 1).alias("size_mb"),
        F.array_join(F.array_sort(F.collect_set("schema_name")), ",").alias("schemas"))


def create_table(spark: SparkSession, name: str, schema: T.StructType | str, location: str, partitioned_by: str = "") -> str:
    """A parquet table with a declared schema at a location. Returns its name."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parts = f" PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet{parts} LOCATION '{location}'")
    return name


def save_as_table(df: DataFrame, name: str, location: str) -> DataFrame:
    """CREATE TABLE ... AS SELECT."""
    df.write.format("parquet").option("path", location).saveAsTable(name)
    return df.sparkSession.table(name)
