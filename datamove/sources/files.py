"""Exported folders: read them, read them as the target table would, write exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamove.spec import FILE_FORMATS, MoveError

# Fixed value: a reader's column for unparsable input; never part of the data.
RESCUED = "_rescued_data"


def export_folder(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table.split('.')[-1]}"


def read_export(spark: SparkSession, root: str, table: str, file_format: str = "PARQUET",
                schema: T.StructType | None = None) -> DataFrame:
    """The files of one table's folder. CSV columns are text unless `schema` is given; JSON without it is inferred, a pass over the files."""
    fmt = file_format.upper()
    if fmt not in FILE_FORMATS:
        raise MoveError(f"File format must be one of {', '.join(FILE_FORMATS)}, not {file_format!r}.")
    folder = export_folder(root, table)
    reader = spark.read.format(fmt.lower())
    if fmt == "CSV":
        reader = reader.option("header", "true")  # without a schema every column is text: inference would change values such as 00123
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(folder)
    except AnalysisException as e:
        condition = e.getCondition() if hasattr(e, "getCondition") else e.getErrorClass()
        if condition in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise MoveError(f"No exported files in {folder}: the table was not exported, or it is empty.") from e
        if fmt == "AVRO" and "avro" in str(e).lower():
            raise MoveError("Reading AVRO needs the spark-avro package on the session's classpath.") from e
        raise
    return df.drop(RESCUED)


def cast_to_target(df: DataFrame, target: T.StructType, columns: dict[str, str] | None = None,
                   keep_missing: bool = True) -> DataFrame:
    """Every target column the frame has, cast to the target's type and name (names in any case, `columns` maps target ->
    source). Extra columns are dropped; absent ones are NULL, or left out with keep_missing=False."""
    have = {c.lower(): c for c in df.columns}
    source_for = {k.lower(): v.lower() for k, v in (columns or {}).items()}
    out = []
    for f in target.fields:
        source = have.get(source_for.get(f.name.lower(), f.name.lower()))
        if source is not None:
            out.append(F.col(f"`{source}`").cast(f.dataType).alias(f.name))
        elif keep_missing:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def as_target_reads_it(df: DataFrame, target: T.StructType, columns: dict[str, str] | None = None, where: str = "") -> DataFrame:
    """Exported files filtered, mapped and cast as the load would: what the loaded table is compared with."""
    return cast_to_target(df.where(where) if where else df, target, columns, keep_missing=False)


def write_export(df: DataFrame, root: str, table: str, file_format: str = "PARQUET") -> str:
    """Export a frame to its table folder, timestamps in microseconds and decimals exact. Returns the folder."""
    folder = export_folder(root, table)
    writer = df.write.mode("overwrite").format(file_format.lower())
    if file_format.upper() == "CSV":
        writer = writer.option("header", "true")
    writer.save(folder)
    return folder


def unload(df: DataFrame, folder: str) -> str:
    """UNLOAD: the query's result as parquet files in a directory."""
    df.sparkSession.sql("INSERT OVERWRITE DIRECTORY '" + folder.replace("'", "\\'") + "' USING PARQUET SELECT * FROM {rows}", rows=df)
    return folder
