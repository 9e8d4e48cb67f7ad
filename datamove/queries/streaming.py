"""File ingest and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove.plans import load
from datamove.queries.base import new_table, query, read
from datamove.session import scratch_path
from datamove.sources.files import write_export
from datamove.spec import MoveSettings, TableMapping
from datamove.streaming import changes
from datamove.streaming.ingest import BATCH_COLUMN, LEDGER_COLUMN, LOAD_COLUMNS, LOAD_PARTITION, ingest_files


@query("ingest_files", "SELECT event_id, ts, user_id, event_type, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS value FROM events")
def ingest(spark, folder):
    events, inbox, ledger = read(spark, folder, "events"), scratch_path(spark, "inbox"), scratch_path(spark, "ledger")
    table = new_table(spark, "events", f"event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value decimal(12,2), {LOAD_COLUMNS}", LOAD_PARTITION)
    clicks = F.col("event_type") == "click"
    for part in (events.where(clicks), events.where(~clicks)):  # a second delivery arrives between the runs
        part.write.mode("append").parquet(inbox)
        ingest_files(spark, inbox, table, ledger)
    ingest_files(spark, inbox, table, ledger)  # nothing new: adds nothing
    return spark.table(table).drop(LEDGER_COLUMN, BATCH_COLUMN).withColumn("value", F.col("value").cast("double"))


@query("ingest_two_sources", "SELECT event_id, user_id, event_type FROM events")
def ingest_two_sources(spark, folder):
    """Two exports fill one table, each loaded twice: every event is there once."""
    events, root = read(spark, folder, "events").select("event_id", "user_id", "event_type"), scratch_path(spark, "exports")
    table = new_table(spark, "events", f"event_id bigint, user_id bigint, event_type string, {LOAD_COLUMNS}", LOAD_PARTITION)
    clicks = F.col("event_type") == "click"
    write_export(events.where(clicks), root, "clicks")
    write_export(events.where(~clicks | clicks.isNull()), root, "others")
    settings = MoveSettings((TableMapping("clicks", table), TableMapping("others", table)), method="files", files_root=root)
    for _ in range(2):
        load.run_load(spark, settings).collect()
    return spark.table(table).drop(LEDGER_COLUMN, BATCH_COLUMN)


_OLD_SQL = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 11 <> 0"
_NEW_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice
  FROM part WHERE p_partkey % 13 <> 0"""


@query("snapshot_changes", f"""
WITH o AS ({_OLD_SQL}), n AS ({_NEW_SQL}), u AS (SELECT o.p_partkey FROM o JOIN n USING (p_partkey) WHERE (o.p_name, o.p_size, o.p_retailprice) IS DISTINCT FROM (n.p_name, n.p_size, n.p_retailprice))
SELECT 'insert' AS change, * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o) UNION ALL SELECT 'delete', * FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)
UNION ALL SELECT 'update_preimage', o.* FROM o JOIN u USING (p_partkey) UNION ALL SELECT 'update_postimage', n.* FROM n JOIN u USING (p_partkey)""")
def snapshot_changes(spark, folder):
    return changes.snapshot_changes(*_snapshots(spark, folder), ["p_partkey"])


@query("feed_round_trip", _NEW_SQL)
def feed_round_trip(spark, folder):
    """The old snapshot and the changes to the new one, applied as a stream, give the new one."""
    old, new = _snapshots(spark, folder)
    feed = (old.select(F.lit("insert").alias("change"), "*").withColumn("version", F.lit(0))
            .unionByName(changes.snapshot_changes(old, new, ["p_partkey"]).withColumn("version", F.lit(1))))
    inbox = scratch_path(spark, "feed")
    feed.write.parquet(inbox)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 4).parquet(inbox)
    return changes.apply_changes(spark, stream, scratch_path(spark, "state"), scratch_path(spark, "checkpoint"), ["p_partkey"], ["version"]).drop("version")


def _snapshots(spark, folder):
    part, k = read(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), F.col("p_partkey")
    new = part.where(k % 13 != 0).withColumn("p_name", F.when(k % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).withColumn("p_size", F.when(k % 9 != 0, F.col("p_size")))
    return part.where(k % 11 != 0), new


@query("apply_changes", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def apply_changes(spark, folder):
    events, inbox = read(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value"), scratch_path(spark, "changes")
    for late_first in ("event_id % 3 = 0", "event_id % 3 = 2", "event_id % 3 = 1"):  # deliveries in no particular order of time
        events.where(late_first).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(inbox)
    return changes.apply_changes(spark, stream, scratch_path(spark, "state"), scratch_path(spark, "checkpoint"), ["user_id"], ["ts", "event_id"])
