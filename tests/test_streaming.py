import uuid

import pytest
from pyspark.sql import functions as F

from datamove.session import scratch_path
from datamove.sources.tables import create_table
from datamove.spec import MoveError
from datamove.streaming.changes import State, apply_changes, snapshot_changes
from datamove.streaming.ingest import LOAD_COLUMNS, LOAD_PARTITION, ingest_files


def test_files_are_copied_once(spark):
    inbox, ledger, name = scratch_path(spark, "in"), scratch_path(spark, "ledger"), "t_" + uuid.uuid4().hex[:8]
    create_table(spark, name, f"a int, b string, {LOAD_COLUMNS}", scratch_path(spark, name), LOAD_PARTITION)
    spark.range(10).selectExpr("CAST(id AS STRING) AS A", "'x' AS b", "1 AS extra").write.mode("append").parquet(inbox)
    assert ingest_files(spark, inbox, name, ledger) == 10
    assert ingest_files(spark, inbox, name, ledger) == 0
    spark.range(10, 15).selectExpr("CAST(id AS STRING) AS A", "'y' AS b", "1 AS extra").write.mode("append").parquet(inbox)
    assert ingest_files(spark, inbox, name, ledger) == 5
    assert sorted(r.a for r in spark.table(name).collect()) == list(range(15))
    assert spark.table(name).select("load_batch").distinct().count() == 2
    # another ledger starts at batch 0 too and leaves the rows of this one alone
    other = scratch_path(spark, "other")
    spark.range(100, 103).selectExpr("CAST(id AS STRING) AS A", "'z' AS b").write.parquet(other)
    assert ingest_files(spark, other, name, scratch_path(spark, "fresh")) == 3
    assert sorted(r.a for r in spark.table(name).collect()) == [*range(15), 100, 101, 102]
    create_table(spark, name + "p", "a int", scratch_path(spark, name + "p"))
    with pytest.raises(MoveError, match="load_batch"):
        ingest_files(spark, inbox, name + "p", ledger)


def test_late_changes_are_ignored(spark):
    inbox, state, check = (scratch_path(spark, n) for n in ("changes", "state", "check"))
    schema = "k int, t int, v string"
    run = lambda: {r.k: r.v for r in apply_changes(spark, spark.readStream.schema(schema).parquet(inbox), state, check, ["k"], ["t"]).collect()}
    spark.createDataFrame([(1, 5, "new"), (2, 1, "a"), (1, 4, "older")], schema).write.mode("append").parquet(inbox)
    assert run() == {1: "new", 2: "a"}
    spark.createDataFrame([(1, 3, "late"), (2, 2, "b"), (3, 1, "c")], schema).write.mode("append").parquet(inbox)
    assert run() == {1: "new", 2: "b", 3: "c"}
    assert run() == {1: "new", 2: "b", 3: "c"}


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", 1), (4, "d", 1)], "k int, v string, n int")
    rows = {(r.change, r.k, r.v) for r in snapshot_changes(old, new, ["k"]).collect()}
    assert rows == {("update_preimage", 2, "b"), ("update_postimage", 2, "B"), ("delete", 3, "c"), ("insert", 4, "d")}
    with pytest.raises(Exception, match="More than one source row for key 2"):
        snapshot_changes(old.union(old.where("k = 2")), new, ["k"]).collect()
    with pytest.raises(Exception, match="NULL in its key"):
        snapshot_changes(old.unionByName(old.where("k = 2").withColumn("k", F.lit(None).cast("int"))), new, ["k"]).collect()


def test_feed_with_deletes(spark):
    inbox, state, check = (scratch_path(spark, n) for n in ("feed", "state", "check"))
    schema = "change string, k int, t int, v string"
    run = lambda: {r.k: r.v for r in apply_changes(spark, spark.readStream.schema(schema).parquet(inbox), state, check, ["k"], ["t"]).collect()}
    spark.createDataFrame([("insert", 1, 1, "a"), ("insert", 2, 1, "b"), ("update_preimage", 1, 2, "a"), ("update_postimage", 1, 2, "A")],
                          schema).write.mode("append").parquet(inbox)
    assert run() == {1: "A", 2: "b"}
    spark.createDataFrame([("delete", 2, 3, "b"), ("insert", 3, 3, "c")], schema).write.mode("append").parquet(inbox)
    assert run() == {1: "A", 3: "c"}
    spark.createDataFrame([("update_postimage", 2, 2, "late")], schema).write.mode("append").parquet(inbox)
    assert run() == {1: "A", 3: "c"}


def test_only_touched_buckets_are_rewritten(spark):
    schema = spark.createDataFrame([], "k int, t int, v string").schema
    state = State(spark, scratch_path(spark, "state"), schema, ["k"])
    rows = lambda ks, t, v: spark.createDataFrame([(k, t, v) for k in ks], schema)
    table = lambda: {r.k: r.v for r in state.rows(state.manifest()).collect()}
    state.apply(rows(range(3000), 1, "a"), 0, ["t"])
    assert len(state.manifest()) == 256 and table() == dict.fromkeys(range(3000), "a")
    state.apply(rows(range(10), 2, "b"), 1, ["t"])
    first = table()
    rewritten = [k for k, b in state.manifest().items() if b == 1]
    assert 1 <= len(rewritten) <= 10 and first == {k: "b" if k < 10 else "a" for k in range(3000)}
    # the batch fails behind its data, before its manifest is complete, and is repeated
    place = state._path(f"{state.root}/manifest/batch=1/_SUCCESS")
    state._fs.delete(place, False)
    assert table() == dict.fromkeys(range(3000), "a")
    state.apply(rows(range(10), 2, "b"), 1, ["t"])
    assert table() == first and sorted(k for k, b in state.manifest().items() if b == 1) == sorted(rewritten)
    state.apply(rows(range(3000), 3, "c"), 2, ["t"])
    state.apply(rows([5, 9999], 4, "d"), 3, ["t"])
    want = table()
    assert want == {**dict.fromkeys(range(3000), "c"), 5: "d", 9999: "d"}
    assert state.expire() == [0, 1] and table() == want and state.expire() == []
    with pytest.raises(MoveError, match="buckets"):
        State(spark, state.root, schema, ["k"], 8).manifest()


def test_changes_without_a_kind_are_kept(spark):
    inbox = scratch_path(spark, "feed")
    schema = "change string, k int, t int"
    spark.createDataFrame([(None, 1, 1), ("delete", 2, 1), (None, None, 1)], schema).write.parquet(inbox)
    got = apply_changes(spark, spark.readStream.schema(schema).parquet(inbox), scratch_path(spark, "s"), scratch_path(spark, "c"), ["k"], ["t"], buckets=4)
    assert sorted((r.k or 0, r.t) for r in got.collect()) == [(0, 1), (1, 1)]
