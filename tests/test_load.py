"""Load plans and runs."""

import uuid

import pytest
from pyspark.sql import functions as F

from datamove.plans import load
from datamove.session import scratch_path
from datamove.sources import files, tables
from datamove.spec import MoveError, MoveSettings, TableMapping, looks_like_production
from datamove.streaming.ingest import LOAD_COLUMNS, LOAD_PARTITION


def make(spark, schema, rows=(), partitioned_by=""):
    name = "t_" + uuid.uuid4().hex[:10]
    tables.create_table(spark, name, schema, scratch_path(spark, name), partitioned_by)
    if rows:
        load.append_by_name(spark.createDataFrame(list(rows), schema), name)
    return name


def values(spark, table):
    return sorted(tuple(r) for r in spark.table(table).collect())


def settings(*mappings, **more):
    return MoveSettings(tuple(mappings), **more)


def test_plan_statements():
    s = settings(TableMapping("dbo.A", "main.dev.a", columns={"customer_name": "cust_name", "id": "id"}), TableMapping("dbo.B", "main.dev.b"),
                 TableMapping("dbo.C", "main.dev.c", where="x > 1"), TableMapping("dbo.D", "main.dev.d", load=False), source_catalog="fed", mode="replace")
    plan = {p.mapping.source: (p.action, p.statement) for p in load.plan_load(s)}
    assert plan["dbo.A"] == ("replace", "INSERT OVERWRITE TABLE main.dev.a BY NAME SELECT `cust_name` AS `customer_name`, `id` AS `id` FROM fed.dbo.A")
    assert plan["dbo.C"] == ("append", "INSERT INTO main.dev.c BY NAME SELECT * FROM fed.dbo.C WHERE x > 1")  # a filter never empties
    assert plan["dbo.D"] == ("reset", "TRUNCATE TABLE main.dev.d")
    assert [p.mapping.source for p in load.plan_load(s, only=["MAIN.DEV.b", "main.dev.d"])] == ["dbo.B"]
    with pytest.raises(MoveError):
        load.plan_load(settings())


def test_target_names():
    s = MoveSettings(target_schema="main.dev", schema_map={"DBO": "main.sales"})
    assert s.target_for("dbo.Orders") == "main.sales.Orders" and s.target_for("x.Y") == "main.dev.Y" and s.target_for("Z") == "main.dev.Z"


@pytest.mark.parametrize("name,want", [("main.prod.t", True), ("production_x", True), ("my-prod", True), ("main.products.t", False), ("reproduce", False)])
def test_production_names(name, want):
    assert looks_like_production(name) is want


def test_production_targets_are_refused(spark):
    s = settings(TableMapping("a", "prod.t"))
    with pytest.raises(MoveError, match="production"):
        load.run_load(spark, s)


def test_append_replace_filter_and_compare_only(spark):
    source = make(spark, "b string, a int", [("x", 1), ("y", 2)])
    target, kept = make(spark, "a int, b string"), make(spark, "a int", [(9,)])
    run = lambda **m: load.run_load(spark, settings(TableMapping(source, target, **{k: v for k, v in m.items() if k == "where"}),
                                                    TableMapping(source, kept, load=False), mode=m["mode"]))
    assert {r.target: (r.status, r.rows) for r in run(mode="append").collect()} == {target: ("loaded", 2), kept: ("compare only", None)}
    assert values(spark, target) == [(1, "x"), (2, "y")]
    run(mode="append")
    assert len(values(spark, target)) == 4
    run(mode="replace")
    run(mode="replace")
    assert values(spark, target) == [(1, "x"), (2, "y")] and values(spark, kept) == []
    run(mode="replace", where="a = 2")
    assert values(spark, target) == [(1, "x"), (2, "y"), (2, "y")]


def test_one_failure_does_not_stop_the_others_and_copy_again(spark):
    good = make(spark, "a int", [(1,)])
    t1, t2 = make(spark, "a int"), make(spark, "a int")
    s = settings(TableMapping("no_such_table", t1), TableMapping(good, t2))
    first = load.run_load(spark, s)
    assert {r.target: r.status for r in first.collect()} == {t1: "failed", t2: "loaded"}
    assert tuple(load.load_summary(first).first()) == (2, 1, 1, 0)
    checks = load.run_reconcile(spark, s)
    assert {r.target: r.status for r in load.table_results(checks).collect()} == {t1: "error", t2: "match"}
    assert tuple(load.reconcile_summary(checks).first()) == (2, 1, 0, 1)
    again = [r.target for r in load.copy_again(first, load.table_results(checks)).collect()]
    assert again == [t1]
    fixed = settings(TableMapping(good, t1), TableMapping(good, t2))
    second = load.run_load(spark, fixed, only=again, previous=first)
    assert {r.target: r.status for r in second.collect()} == {t1: "loaded", t2: "loaded"} and values(spark, t2) == [(1,)]


def test_preflight(spark):
    source, target = make(spark, "a int", [(1,), (2,)]), make(spark, "a int")
    rows = {r.target: r for r in load.preflight(spark, settings(TableMapping(source, target, where="a > 1"), TableMapping("missing", "gone"))).collect()}
    assert (rows[target].rows, rows[target].target_exists, rows["gone"].rows, rows["gone"].target_exists) == (1, True, None, False)
    frame = load.preflight(spark, settings(TableMapping(source, target)))
    assert tuple(load.preflight_totals(frame).first()) == (2, 0.0, True)


def test_missing_export_folder_is_named(spark, tmp_path):
    with pytest.raises(MoveError, match=r"No exported files in .*/orders"):
        files.read_export(spark, str(tmp_path), "sales.orders")
    with pytest.raises(MoveError):
        files.read_export(spark, str(tmp_path), "orders", "XLSX")


def test_avro_needs_its_package(spark, tmp_path):
    (tmp_path / "t").mkdir()
    with pytest.raises(MoveError, match="avro"):
        files.read_export(spark, str(tmp_path), "t", "AVRO")


def test_cast_to_target_drops_adds_and_renames(spark):
    df = spark.createDataFrame([("7", "x", 1)], "ID string, extra string, old int")
    target = spark.createDataFrame([], "id int, new bigint, gone date").schema
    out = files.cast_to_target(df, target, {"NEW": "Old"})
    assert out.schema == target or [f.dataType for f in out.schema.fields] == [f.dataType for f in target.fields]
    assert tuple(out.first()) == (7, 1, None)
    assert files.cast_to_target(df, target, keep_missing=False).columns == ["id"]


def test_empty_export_only_empties_the_target(spark, tmp_path):
    target = make(spark, "a int", [(1,)])
    files.write_export(spark.createDataFrame([], "a string"), str(tmp_path), "t")
    s = settings(TableMapping("dbo.t", target), method="files", files_root=str(tmp_path), mode="replace")
    result = load.run_load(spark, s).first()
    assert (result.status, result.rows, values(spark, target)) == ("loaded", 0, [])


def test_file_loads_skip_files_copied_before(spark, tmp_path):
    target = make(spark, f"a int, {LOAD_COLUMNS}", partitioned_by=LOAD_PARTITION)
    root, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    s = settings(TableMapping("dbo.t", target, columns={"a": "x"}, where="x <> '3'"), method="files", files_root=root)
    spark.createDataFrame([("1",), ("3",)], "x string").write.mode("append").parquet(root + "/t")
    assert load.run_load(spark, s, ledger=ledger).first().rows == 1
    spark.createDataFrame([("2",)], "x string").write.mode("append").parquet(root + "/t")
    assert load.run_load(spark, s, ledger=ledger).first().rows == 1
    assert load.run_load(spark, s, ledger=ledger).first().rows == 0
    assert [v[0] for v in values(spark, target)] == [1, 2]
    assert load.run_reconcile(spark, s).where("not match").isEmpty()


def test_a_ledger_is_kept_by_default(spark, tmp_path):
    target = make(spark, f"a int, {LOAD_COLUMNS}", partitioned_by=LOAD_PARTITION)
    for table, rows in (("one", [(1,), (2,)]), ("two", [(3,)])):
        files.write_export(spark.createDataFrame(rows, "a int"), str(tmp_path), table)
    s = settings(TableMapping("one", target), TableMapping("two", target), method="files", files_root=str(tmp_path))
    assert [r.rows for r in load.run_load(spark, s).collect()] == [2, 1]
    assert [r.rows for r in load.run_load(spark, s).collect()] == [0, 0]
    assert [v[0] for v in values(spark, target)] == [1, 2, 3]
    plain = make(spark, "a int")
    failed = load.run_load(spark, settings(TableMapping("one", plain), method="files", files_root=str(tmp_path))).first()
    assert failed.status == "failed" and "load_ledger" in failed.error


def test_lists_tables_and_skips_missing_schemas(spark):
    name = make(spark, "a int")
    found = tables.list_tables(spark, ["default", "no_such_schema", "information_schema"])
    assert f"default.{name}" in found and all(f.startswith("default.") for f in found)


def test_load_log(spark):
    from datetime import datetime

    log = make(spark, "step_name string, rows_loaded bigint, started_at timestamp, finished_at timestamp, message string")
    load.log_step(spark, log, "facts", datetime(2024, 1, 1), rows=3)
    load.log_step(spark, log, "facts", datetime(2024, 1, 2), message="boom")
    assert [(r.rows_loaded, r.message) for r in spark.table(log).orderBy("started_at").collect()] == [(3, None), (None, "boom")]


def test_inventory_file(spark, tmp_path):
    path = tmp_path / "inv.csv"
    path.write_text("Schema_Name|TABLE_NAME|Column_Name|Ordinal|Data_Type|Max_Length|Precision|Scale|Is_Nullable|Row_Count|Size_MB\n"
                    "dbo|Orders|OrderId|1|int|4|10|0|NO|1,100|1.5\ndbo|Orders|Note|2|nvarchar|-1|0|0|y|1,100|1.5\ndbo|Customers|Id|1|int|4|10|0|NO|5|NULL\n")
    inventory = tables.read_inventory(spark, str(path))
    rows = tables.inventory_tables(inventory).collect()
    assert [(r.table_name, r.rows, r.size_mb, [c.column_name for c in r.columns], [c.nullable for c in r.columns]) for r in rows] == [
        ("Orders", 1100.0, 1.5, ["OrderId", "Note"], [False, True]), ("Customers", 5.0, None, ["Id"], [False])]
    assert tuple(tables.inventory_summary(inventory).first()) == (2, 3, 1105, 1.5, "dbo")
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(MoveError, match="schema_name"):
        tables.read_inventory(spark, str(bad))


def test_exports_round_trip_in_every_bundled_format(spark, tmp_path):
    df = spark.range(5).select(F.col("id"), (F.col("id") / 4).cast("decimal(9,2)").alias("amount"), F.lit("a,b").alias("s"))
    for fmt in ("PARQUET", "ORC", "JSON", "CSV"):
        files.write_export(df, str(tmp_path), f"t_{fmt}", fmt)
        back = files.cast_to_target(files.read_export(spark, str(tmp_path), f"t_{fmt}", fmt), df.schema)
        assert sorted(back.collect()) == sorted(df.collect()), fmt


def test_csv_text_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "codes").mkdir()
    (tmp_path / "codes" / "a.csv").write_text("id,zip\n1,00123\n")
    df = files.cast_to_target(files.read_export(spark, str(tmp_path), "codes", "CSV"), spark.createDataFrame([], "id int, zip string").schema)
    assert [tuple(r) for r in df.collect()] == [(1, "00123")]


def test_replace_enters_its_files_in_the_ledger(spark):
    root = scratch_path(spark, "replaced")
    frame = spark.range(10).selectExpr("CAST(id AS INT) AS a", "'x' AS b")
    files.write_export(frame, root, "t")
    target = make(spark, f"a int, b string, {LOAD_COLUMNS}", partitioned_by=LOAD_PARTITION)
    run = lambda mode: load.run_load(spark, settings(TableMapping("dbo.t", target), method="files", files_root=root, mode=mode)).first()
    for mode, added in (("replace", 10), ("append", 0), ("replace", 10), ("append", 0)):
        done = run(mode)
        assert (done.status, done.rows, spark.table(target).count()) == ("loaded", added, 10)
    frame.limit(3).write.mode("append").parquet(f"{root}/t")
    assert run("append").rows == 3 and spark.table(target).count() == 13
    assert run("replace").rows == 13 and spark.table(target).count() == 13
    assert run("append").rows == 0 and spark.table(target).count() == 13
    load.append_by_name(spark.createDataFrame([(1, "by hand", None, None)], spark.table(target).schema), target)
    assert spark.table(target).count() == 14 and run("replace").rows == 13 and spark.table(target).count() == 13


def test_columns_on_one_side_are_told(spark):
    source, narrow, wide = make(spark, "a int, b string", [(1, "x")]), make(spark, "a int", [(1,)]), make(spark, "a int, b string, made date")
    load.append_by_name(spark.createDataFrame([(1, "x")], "a int, b string"), wide)
    checks = load.run_reconcile(spark, settings(TableMapping(source, narrow), TableMapping(source, wide), TableMapping(source, source)))
    told = {r.table_name: (r.match, r.detail) for r in checks.where("check = 'columns'").collect()}
    assert told == {narrow: (False, "only in source: b"), wide: (True, "only in target: made")}
    assert {r.target: r.status for r in load.table_results(checks).collect()} == {narrow: "mismatch", wide: "match", source: "match"}


def test_preflight_counts_the_others_beside_a_bad_file(spark):
    root = scratch_path(spark, "bad")
    files.write_export(spark.range(4), root, "good")
    target = make(spark, "id bigint")
    spark.range(1).selectExpr("'no parquet at all' AS value").write.text(f"{root}/bad")
    rows = load.preflight(spark, settings(TableMapping("bad", target), TableMapping("good", target), method="files", files_root=root)).collect()
    assert [(r.source, r.rows) for r in rows] == [("bad", None), ("good", 4)]
