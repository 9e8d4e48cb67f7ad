"""Copy export files into a table exactly once, however often the job runs."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from datamove.sources.files import cast_to_target, read_export
from datamove.spec import FILE_FORMATS, MoveError

# The table's partition columns: the ledger (a stream's lasting id) and the number of its batch that wrote a row.
LEDGER_COLUMN, BATCH_COLUMN = "load_ledger", "load_batch"
LOAD_COLUMNS = f"{LEDGER_COLUMN} string, {BATCH_COLUMN} bigint"
LOAD_PARTITION = f"{LEDGER_COLUMN}, {BATCH_COLUMN}"


def ingest_files(spark: SparkSession, folder: str, table: str, checkpoint: str, file_format: str = "PARQUET",
                 columns: dict[str, str] | None = None, where: str = "", source_schema: T.StructType | None = None, with_ledger: bool = False) -> int | tuple[int, str]:
    """Copy the files in `folder` not copied before and return the rows added (with_ledger: and the ledger's id).

    The stream's checkpoint is the ledger that remembers the files. The table must be partitioned by `load_ledger` and `load_batch`: a batch
    that is repeated after a failure overwrites its own partition, so nothing is copied twice, and several sources or ledgers that fill one
    table never touch each other's rows. A new ledger copies all files again.
    """
    fmt = file_format.upper()
    if fmt not in FILE_FORMATS:
        raise MoveError(f"File format must be one of {', '.join(FILE_FORMATS)}, not {file_format!r}.")
    target = spark.table(table).schema
    if not {LEDGER_COLUMN, BATCH_COLUMN} <= set(target.fieldNames()):
        raise MoveError(f"{table} must be partitioned by {LOAD_PARTITION} to take files exactly once.")
    wanted = T.StructType([f for f in target.fields if f.name not in (LEDGER_COLUMN, BATCH_COLUMN)])
    if source_schema is None:
        root, _, name = folder.rstrip("/").rpartition("/")
        source_schema = read_export(spark, root, name, fmt).schema
    reader = spark.readStream.format(fmt.lower()).schema(source_schema)
    reader = reader.option("header", "true") if fmt == "CSV" else reader
    stream = reader.load(folder)
    stream = stream.where(where) if where else stream
    added, ledger = {}, Future()  # the query's id: kept in its checkpoint, the same after every restart

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        rows = cast_to_target(batch, wanted, columns).observe(seen, F.count(F.lit(1)).alias("rows"))
        batch.sparkSession.sql(  # a static partition: replaces this batch's rows and no others
            f"INSERT OVERWRITE TABLE {table} PARTITION ({LEDGER_COLUMN} = '{ledger.result()}', {BATCH_COLUMN} = {int(batch_id)}) "
            "BY NAME SELECT * FROM {rows}", rows=rows)
        added[batch_id] = int(seen.get["rows"])

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ledger.set_result(query.id)
    query.awaitTermination()
    return (sum(added.values()), query.id) if with_ledger else sum(added.values())
