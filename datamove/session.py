"""Session helpers: one place that knows where shared scratch data may live and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when the planner's size for it is known to be at most this (32 MiB of file data).
BROADCAST_LIMIT = 32 * 1024 * 1024


def build_session(app: str = "datamove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",  # split a hot key even where that costs a shuffle later
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`. Only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        root = tempfile.mkdtemp(prefix="datamove-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/datamove/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives executor loss, and a recomputation cannot change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame's rows, written once in the shared folder: later jobs read the files, whose size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a frame, or None where it cannot be read (for example over Spark Connect)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no estimate means "do not broadcast"
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only behind a size check; above the limit the join is left to the shuffle-based strategies."""
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


SPREAD_BYTES = 8 * 1024 * 1024  # of the planner's size: a row made longer or repeated by the plan before may be many times that


def spread_over_cores(df: DataFrame, key: str, partition_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Hash-partition CPU-bound work whose input is too small to fill the cores: a scan makes about one task per 128 MiB.
    Partitions grow in number with the planner's size, so that what one task reads does not grow; larger inputs have tasks enough and are left where they are."""
    size, cores = planned_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)), key) if size is not None and size < cores * partition_bytes else df
