"""Changes between two snapshots, and applying a stream of changes to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from datamove.operators.keys import complete, single_rows
from datamove.operators.latest import latest_per_key
from datamove.session import cut_lineage
from datamove.spec import MoveError


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows between two snapshots with unique keys (a repeated or NULL key fails): insert, delete, update_preimage and update_postimage, each with
    the row's columns. One join on the keys; equal rows are dropped before anything is emitted."""
    columns = old.columns
    values = [c for c in columns if c not in keys]
    named = F.when(complete(keys), F.lit(True)).otherwise(F.raise_error(F.lit("A row has NULL in its key.")).cast("boolean"))
    side = lambda df, name: single_rows(df.where(named), keys).select(*keys, F.struct(F.col("_single").alias("_here"), *values).alias(name))
    joined = side(old, "old").join(side(new, "new"), keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))

    def change(kind: str, name: str) -> Column:
        row = [F.col(c) if c in keys else F.col(f"{name}.{c}") for c in columns]
        return F.struct(F.lit(kind).alias("change"), *[r.alias(c) for r, c in zip(row, columns)])
    rows = (F.when(F.col("old").isNull(), F.array(change("insert", "new")))
            .when(F.col("new").isNull(), F.array(change("delete", "old")))
            .otherwise(F.array(change("update_preimage", "old"), change("update_postimage", "new"))))
    return joined.select(F.inline(rows))


def merge_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newer of the current and the changed row of every key; a change older than the current row is ignored."""
    return latest_per_key(current.unionByName(changes), keys, order)


BUCKETS = 256


class State:
    """A keyed table in hash buckets. Every batch writes new contents of the buckets that it touches, and a manifest: which batch wrote each bucket's
    present contents. A batch counts once its manifest is complete, so that a batch repeated after a failure starts from the manifest before it again."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, folder: str) -> list[tuple[int, str]]:
        place = self._path(f"{self.root}/{folder}")
        names = [s.getPath() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return sorted((int(p.getName().split("=")[1]), p.toString()) for p in names if p.getName().startswith("batch="))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it, after the last complete batch; one entry a bucket at most."""
        done = [(b, p) for b, p in self._batches("manifest") if (before is None or b < before) and self._fs.exists(self._path(p + "/_SUCCESS"))]
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, batch bigint, buckets int").parquet(done[-1][1]).collect()
        if any(r.buckets != self.buckets for r in rows):
            raise MoveError(f"The state in {self.root} has {rows[0].buckets} buckets, not {self.buckets}.")
        return {r.bucket: r.batch for r in rows}

    def rows(self, manifest: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/batch={batch}/bucket={bucket}" for bucket, batch in manifest.items() if only is None or bucket in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, batch: int, order: list[str]) -> None:
        """Bring the latest change of each key into its bucket; other buckets are neither read nor written."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        latest = cut_lineage(latest_per_key(changes, self.keys, order))
        touched = {r.bucket for r in latest.select(bucket).distinct().collect()}  # at most one for each bucket
        before = self.manifest(batch)
        merged = merge_latest(self.rows(before, touched), latest, self.keys, order).select("*", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={batch}")
        after = before | dict.fromkeys(touched, batch)
        frame = self.spark.createDataFrame([(k, v, self.buckets) for k, v in after.items()], "bucket int, batch bigint, buckets int")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")

    def expire(self, keep: int = 2) -> list[int]:
        """Delete the data of batches that none of the last `keep` manifests names, and the manifests before them; returns those batches."""
        kept = [b for b, p in self._batches("manifest") if self._fs.exists(self._path(p + "/_SUCCESS"))][-keep:]
        needed = {v for b in kept for v in self.manifest(b + 1).values()}
        gone = [(b, p) for b, p in self._batches("data") if kept and b < kept[0] and b not in needed]
        for _, p in [*gone, *[(b, p) for b, p in self._batches("manifest") if kept and b < kept[0]]]:
            self._fs.delete(self._path(p), True)
        return [b for b, _ in gone]


def apply_changes(spark: SparkSession, stream: DataFrame, state_root: str, checkpoint: str, keys: list[str],
                  order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Run the available changes into the table under `state_root` and return the table.

    With a `change` column, as snapshot_changes gives it, `delete` removes its key and preimages are ignored (a NULL there is a row like any other); a deleted key
    stays in the state, so that a late change does not bring it back, and is left out of the returned table, as is the column. `order` (for example
    event time, then event id) decides which change of a key is the latest.
    """
    feed = "change" in stream.columns
    stream = stream.where(~F.col("change").eqNullSafe("update_preimage")) if feed else stream
    state = State(spark, state_root, stream.schema, keys, buckets)
    query = (stream.writeStream.foreachBatch(lambda batch, number: state.apply(batch, number, order))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = state.rows(state.manifest())
    return rows.where(~F.col("change").eqNullSafe("delete")).drop("change") if feed else rows
