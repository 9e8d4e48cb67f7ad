"""Plan and run the load of many tables: append, replace, filtered, compare-only; one failure never stops the others."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from datamove import fixed_values as fixed
from datamove.operators import reconcile
from datamove.sources import jdbc
from datamove.sources.files import as_target_reads_it, export_folder, read_export
from datamove.sources.tables import read_source
from datamove.spec import MoveError, MoveSettings, TableMapping, refuse_production
from datamove.streaming.ingest import BATCH_COLUMN, LEDGER_COLUMN, ingest_files

RESULT_SCHEMA = ("source string, target string, status string, rows bigint, error string, compare_only boolean, "
                 "started timestamp, finished timestamp")
PARALLEL_TABLES = 4  # independent tables share the session's executors


@dataclass(frozen=True)
class Step:
    mapping: TableMapping
    action: str  # append | replace | reset | compare only
    statement: str


def _message(e: Exception) -> str:
    """The whole text of any error: one table's failure is that table's result and never stops the others."""
    return str(e) or type(e).__name__


# ---------------------------------------------------------------- writing one table

def append_by_name(df: DataFrame, table: str) -> None:
    """INSERT ... BY NAME: column order does not matter."""
    df.sparkSession.sql(f"INSERT INTO {table} BY NAME SELECT * FROM {{rows}}", rows=df)


def replace_by_name(df: DataFrame, table: str) -> None:
    """Replace the table's rows in one overwrite; running it twice leaves the same rows."""
    df.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} BY NAME SELECT * FROM {{rows}}", rows=df)


def empty_table(spark: SparkSession, table: str) -> None:
    replace_by_name(spark.createDataFrame([], spark.table(table).schema), table)


def mapped_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select target <- source columns; without a mapping, all columns under their own names."""
    return df.select(*[F.col(f"`{s}`").alias(t) for t, s in columns.items()]) if columns else df


def _write_counted(df: DataFrame, table: str, replace: bool) -> int:
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    (replace_by_name if replace else append_by_name)(counted, table)
    return int(seen.get["rows"])  # counted by the write itself, no second scan


# ---------------------------------------------------------------- plan

def plan_load(settings: MoveSettings, only: list[str] | None = None) -> list[Step]:
    """What a load would do, table by table. A filtered copy adds rows: it never empties the table."""
    if not settings.tables:
        raise MoveError("No tables to load.")
    if settings.method == "files" and not settings.files_root:
        raise MoveError("Loading files needs files_root, the folder with one folder per table.")
    if settings.method == "jdbc" and settings.connection is None:
        raise MoveError("Loading from the database needs a connection.")
    wanted = {x.lower() for x in only} if only else None
    steps = []
    for t in settings.tables:
        if wanted is not None and (t.target.lower() not in wanted or not t.load):
            continue
        if not t.load:
            action = "reset" if settings.mode == "replace" else "compare only"
            steps.append(Step(t, action, f"TRUNCATE TABLE {t.target}" if action == "reset" else ""))
            continue
        replace = settings.mode == "replace" and not t.where
        verb = "INSERT OVERWRITE TABLE" if replace else "INSERT INTO"
        chosen = ", ".join(f"`{s}` AS `{c}`" for c, s in t.columns.items()) or "*"
        place = (f"{settings.file_format.lower()}.`{export_folder(settings.files_root, t.source)}`" if settings.method == "files"
                 else f"{settings.source_catalog}.{t.source}" if settings.source_catalog and settings.method == "catalog" else t.source)
        where = f" WHERE {t.where}" if t.where else ""
        steps.append(Step(t, "replace" if replace else "append", f"{verb} {t.target} BY NAME SELECT {chosen} FROM {place}{where}"))
    return steps


def plan_frame(spark: SparkSession, settings: MoveSettings) -> DataFrame:
    rows = [(s.mapping.source, s.mapping.target, s.action, s.statement) for s in plan_load(settings)]
    return spark.createDataFrame(rows, "source string, target string, action string, statement string")


# ---------------------------------------------------------------- run

def source_frame(spark: SparkSession, settings: MoveSettings, t: TableMapping) -> DataFrame:
    """The source rows of one mapping as its target reads them: filtered, renamed and, from files, cast."""
    if settings.method == "files":
        raw = read_export(spark, settings.files_root, t.source, settings.file_format)
        return as_target_reads_it(raw, target_frame(spark, settings, t).schema, t.columns, t.where)
    if settings.method == "jdbc":  # filtered in the database, read in even key ranges
        raw = jdbc.read_jdbc(spark, settings.connection, t.source, t.where, t.key, t.parts)
        return as_target_reads_it(raw, target_frame(spark, settings, t).schema, t.columns)
    df = read_source(spark, t.source, settings.source_catalog)
    return mapped_columns(df.where(t.where) if t.where else df, t.columns)


def target_frame(spark: SparkSession, settings: MoveSettings, t: TableMapping) -> DataFrame:
    """The target's rows; of a table filled from files, without the columns that say which batch wrote a row."""
    df = spark.table(t.target)
    return df.drop(LEDGER_COLUMN, BATCH_COLUMN) if settings.method == "files" and {LEDGER_COLUMN, BATCH_COLUMN} <= set(df.columns) else df


GENERATION = "datamove.ledger_generation"


def _generation(spark: SparkSession, table: str) -> int:
    """How often the table was replaced: each replace starts new ledgers, which know nothing of the files copied before."""
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == GENERATION).first()
    return int(found["value"]) if found else 0


def _start_ledgers(spark: SparkSession, table: str, generation: int) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{GENERATION}' = '{generation}')")


def _from_files(spark: SparkSession, settings: MoveSettings, t: TableMapping, ledger: str | None, replace: bool) -> int:
    """Files not copied before; a replace copies all and removes all other rows, after the new ones are there. Run again after a failure, it goes on."""
    generation = _generation(spark, t.target) + replace
    folder = f"{ledger or settings.files_root.rstrip('/') + '/_ledger'}/{quote(t.source, safe='')}/{quote(t.target, safe='')}"
    folder += f"/{generation}" if generation else ""
    rows, own = ingest_files(spark, export_folder(settings.files_root, t.source), t.target, folder, settings.file_format, t.columns, t.where, with_ledger=True)
    if replace:
        table = spark.table(t.target)
        none = spark.createDataFrame([], table.drop(LEDGER_COLUMN).schema)
        for other in table.select(LEDGER_COLUMN).distinct().where(~F.col(LEDGER_COLUMN).eqNullSafe(own)).collect():  # one for each source of the table
            written_by = "NULL" if other[0] is None else "'" + other[0].replace("'", "\\'") + "'"
            spark.sql(f"INSERT OVERWRITE TABLE {t.target} PARTITION ({LEDGER_COLUMN} = {written_by}, {BATCH_COLUMN}) BY NAME SELECT * FROM {{none}}", none=none)
        _start_ledgers(spark, t.target, generation)
    return rows


def _load_one(spark: SparkSession, settings: MoveSettings, step: Step, ledger: str | None) -> tuple:
    started, t, target = datetime.now(timezone.utc), step.mapping, step.mapping.target
    rows, error = None, None
    try:
        if step.action == "compare only":
            status = "compare only"
        elif step.action == "reset":
            empty_table(spark, target)
            status = "reset"
        else:
            df = source_frame(spark, settings, t)
            if settings.method == "files" and df.isEmpty():  # an empty export carries no column types
                if step.action == "replace":
                    empty_table(spark, target)
                    _start_ledgers(spark, target, _generation(spark, target) + 1)
                rows = 0
            elif settings.method == "files" and (step.action == "append" or LEDGER_COLUMN in spark.table(target).columns):
                rows = _from_files(spark, settings, t, ledger, step.action == "replace")
            else:
                rows = _write_counted(df, target, step.action == "replace")
            status = "loaded"
    except Exception as e:  # noqa: BLE001 - Java and database errors too
        status, error = "failed", _message(e)
    return (t.source, target, status, rows, error, not t.load, started, datetime.now(timezone.utc))


def run_load(spark: SparkSession, settings: MoveSettings, only: list[str] | None = None, previous: DataFrame | None = None,
             ledger: str | None = None, allow_production: bool = False) -> DataFrame:
    """Load the tables and return one result row each. `only` copies just those targets again and keeps the `previous`
    results of the others. Appending from files skips files copied before: `ledger` is the folder that remembers them by source and
    target, `_ledger` beside the exports if none is given."""
    steps = plan_load(settings, only)
    refuse_production([s.mapping.target for s in steps], allow_production)
    turns = {}  # two writes into one table at a time would remove each other's unfinished files
    for i, s in enumerate(steps):
        turns.setdefault(s.mapping.target.lower(), []).append(i)
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        done = pool.map(lambda turn: [(i, _load_one(spark, settings, steps[i], ledger)) for i in turn], turns.values())
        results = [row for _, row in sorted((x for turn in done for x in turn), key=lambda x: x[0])]
    now = spark.createDataFrame(results, RESULT_SCHEMA)
    if only and previous is not None:
        again = now.select(F.lower("target").alias("_again"))
        now = previous.join(again, F.lower("target") == F.col("_again"), "left_anti").unionByName(now)
    return now


def load_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(~F.col("compare_only")).alias("tables"), F.count_if(F.col("status") == "loaded").alias("loaded"),
                       F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("compare_only").alias("compare_only"))


# ---------------------------------------------------------------- before and after

def _rows_to_copy(spark: SparkSession, settings: MoveSettings, t: TableMapping) -> int | None:
    """Counted by the database itself where there is a connection; null for a table that cannot be read."""
    try:
        if settings.method == "jdbc":
            return jdbc.source_count(spark, settings.connection, t.source, t.where)
        df = (read_export(spark, settings.files_root, t.source, settings.file_format) if settings.method == "files"
              else read_source(spark, t.source, settings.source_catalog))
        return (df.where(t.where) if t.where else df).count()
    except Exception:  # noqa: BLE001 - a damaged file or a database error is that table's result
        return None


def preflight(spark: SparkSession, settings: MoveSettings) -> DataFrame:
    """Per table to load: whether the target exists, the rows to copy (filter applied) and minutes at the planning speed. Each table is
    counted apart, several at a time, so one that cannot be read leaves the others their numbers."""
    tables = [t for t in settings.tables if t.load]
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        counts = list(pool.map(lambda t: _rows_to_copy(spark, settings, t), tables))
    rows = [(t.source, t.target, t.where, spark.catalog.tableExists(t.target), n) for t, n in zip(tables, counts, strict=True)]
    found = spark.createDataFrame(rows, "source string, target string, filter string, target_exists boolean, rows bigint")
    return found.withColumn("minutes", F.round(F.col("rows") / fixed.ROWS_PER_MINUTE, 1))


def preflight_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum(F.coalesce("rows", F.lit(0))).alias("total_rows"),
                    F.round(F.sum(F.coalesce("rows", F.lit(0))) / fixed.ROWS_PER_MINUTE, 1).alias("minutes"),
                    (F.min((F.col("target_exists") & F.col("rows").isNotNull()).cast("int")) == 1).alias("ready"))


def copy_again(loads: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Targets to copy again: the last copy failed, or the comparison did not match."""
    return (loads.where("status = 'failed'").select("target")
            .union(comparisons.where("status <> 'match'").select("target")).distinct())


def compare_in_database(spark: SparkSession, settings: MoveSettings, t: TableMapping) -> DataFrame:
    """Check rows of counts and sums. The source's are computed in its database, and no row of it is read."""
    target, types = target_frame(spark, settings, t), {f.name.lower(): f for f in jdbc.source_schema(spark, settings.connection, t.source).fields}
    source_for = {k.lower(): v.lower() for k, v in t.columns.items()}
    number = lambda f: f is not None and isinstance(f.dataType, T.NumericType)
    numeric = [c for c, kind in reconcile.lower_columns(target).items() if isinstance(kind, T.NumericType) and number(types.get(source_for.get(c, c)))]
    integral = {c for c in numeric if isinstance(reconcile.lower_columns(target)[c], T.IntegralType)}
    source = jdbc.source_sums(spark, settings.connection, t.source, [types[source_for.get(c, c)].name for c in numeric], t.where)
    checks = {"row_count": "row_count", **{f"sum({c})": f"sum_{i}" for i, c in enumerate(numeric)}}
    return reconcile.check_rows(source, reconcile.profile(target, numeric, [], integral), checks)


def _columns_check(t: TableMapping, source: list[str], target: DataFrame) -> list[tuple]:
    """A row that names the columns on one side only; it fails where the target lacks a column of the source."""
    have = {c.lower() for c in target.columns}
    given = {c.lower() for c in (t.columns or source)}
    lost, more = sorted(given - have), sorted(have - given)
    if not lost and not more:
        return []
    told = "; ".join(f"only in {side}: {', '.join(names)}" for side, names in (("source", lost), ("target", more)) if names)
    return [(t.target, -1, "columns", Decimal(len(given)), Decimal(len(have)), not lost, None, told)]


def _compare_one(spark: SparkSession, settings: MoveSettings, t: TableMapping, checksum: bool) -> list[tuple]:
    try:
        target = target_frame(spark, settings, t)
        if settings.method == "jdbc" and not checksum:
            names, checks = jdbc.source_schema(spark, settings.connection, t.source).names, compare_in_database(spark, settings, t)
        else:
            source = source_frame(spark, settings, t)
            names = source.columns
            if settings.method == "jdbc":
                names = jdbc.source_schema(spark, settings.connection, t.source).names
            elif settings.method == "files":
                names = read_export(spark, settings.files_root, t.source, settings.file_format).columns
            checks = reconcile.compare_table(source, target, checksum)
        return [*_columns_check(t, names, target), *[(t.target, r.check_no, r["check"], r.source, r.target, r.match, None, None) for r in checks.collect()]]
    except Exception as e:  # noqa: BLE001 - Java and database errors too
        return [(t.target, -1, "error", None, None, False, _message(e), None)]


def run_reconcile(spark: SparkSession, settings: MoveSettings, checksum: bool = True) -> DataFrame:
    """Check rows of every mapped table; a table that cannot be compared is an `error` row, and one whose columns differ from the source's has a `columns` row.
    checksum=False compares counts and sums only, over a connection by the database's own. Column mappings and filters are applied to the source, so a
    filtered load compares like with like."""
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        rows = [r for t in pool.map(lambda t: _compare_one(spark, settings, t, checksum), settings.tables) for r in t]
    return spark.createDataFrame(rows, "table_name string, check_no int, check string, source decimal(38,6), "
                                       "target decimal(38,6), match boolean, error string, detail string")


def table_results(checks: DataFrame) -> DataFrame:
    status = (F.when(F.max(F.col("error").isNotNull().cast("int")) == 1, "error")
              .when(F.min(F.col("match").cast("int")) == 1, "match").otherwise("mismatch"))
    return checks.groupBy(F.col("table_name").alias("target")).agg(status.alias("status"))


def reconcile_summary(checks: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return table_results(checks).agg(F.count(F.lit(1)).alias("tables"), n("match").alias("matched"),
                                     n("mismatch").alias("mismatched"), n("error").alias("errors"))


def migration_summary(loads: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: tables copied, rows copied, failed, and tables equal to their source."""
    loaded = loads.where("not compare_only").select(
        (F.col("status") == "loaded").alias("copied"), F.when(F.col("status") == "loaded", F.col("rows")).alias("rows"),
        (F.col("status") == "failed").alias("failed"), F.lit(False).alias("matching"))
    compared = comparisons.select(F.lit(False).alias("copied"), F.lit(None).cast("bigint").alias("rows"),
                                  F.lit(False).alias("failed"), (F.col("status") == "match").alias("matching"))
    return loaded.unionByName(compared).agg(
        F.count_if("copied").alias("tables_copied"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_copied"),
        F.count_if("failed").alias("tables_failed"), F.count_if("matching").alias("tables_matching"))


def log_step(spark: SparkSession, table: str, step: str, started: datetime, rows: int | None = None, message: str | None = None) -> None:
    """Append one row to the load log table (step_name, rows_loaded, started_at, finished_at, message)."""
    row = [(step, rows, started, datetime.now(timezone.utc), message)]
    append_by_name(spark.createDataFrame(
        row, "step_name string, rows_loaded bigint, started_at timestamp, finished_at timestamp, message string"), table)
